"""Target schemas of the data model (see README)."""

from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DoubleType, FloatType,
                               IntegerType, LongType, MapType, StringType,
                               StructField, StructType, TimestampNTZType,
                               TimestampType)

PROMPTS = StructType([
    StructField("conv_id", LongType()), StructField("turn", LongType()),
    StructField("cohort", StringType()), StructField("purpose", StringType()),
    StructField("text", StringType())])

RESPONSES = StructType([
    StructField("model_id", StringType()), StructField("conv_id", LongType()),
    StructField("turn", LongType()), StructField("response", StringType())])

LOGPROBS = StructType([
    StructField("model_id", StringType()), StructField("prompt_id", LongType()),
    StructField("lp", ArrayType(DoubleType()))])

VECTORS = StructType([
    StructField("vec_id", LongType()), StructField("cohort", StringType()),
    StructField("layer", IntegerType()), StructField("vec", ArrayType(FloatType()))])

PARAMS = MapType(StringType(), MapType(StringType(), DoubleType()))

TRIALS = StructType([
    StructField("study", StringType()), StructField("trial_number", IntegerType()),
    StructField("state", StringType()), StructField("divergence", DoubleType()),
    StructField("hits", IntegerType()), StructField("total", IntegerType()),
    StructField("params", PARAMS), StructField("direction_index", DoubleType()),
    StructField("started_at", TimestampNTZType()),
    StructField("finished_at", TimestampNTZType())])

STEPS = StructType([
    StructField("run", StringType()), StructField("step", IntegerType()),
    StructField("train_loss", DoubleType()), StructField("eval_loss", DoubleType())])

BENCH_LOG = StructType([
    StructField("config", StringType()), StructField("batch_size", IntegerType()),
    StructField("elapsed_s", DoubleType()), StructField("tokens", LongType()),
    StructField("ok", BooleanType())])

# Schema of Spark's ``binaryFile`` source (needed for streaming reads).
BINARY_FILE = StructType([
    StructField("path", StringType()), StructField("modificationTime", TimestampType()),
    StructField("length", LongType()), StructField("content", BinaryType())])
