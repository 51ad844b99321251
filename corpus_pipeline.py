"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept, and returns a DataFrame; it is written as Parquet in the
shared scratch folder and read again as the next stage's ``docs``.  All but
the last return the columns of ``documents``.

Defined cases, as the operators state them: null and empty texts are rejected by
the quality rules; rows of one id with different words are told apart, rows equal
in id and words become one; a row with a null id is kept by every stage that does
not reject its text; an empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.dart_minhash import keep_first
from tessera.llm.decontaminate import drop_leaks
from tessera.llm.mixing import apply_mix
from tessera.llm.quality import keep_good
from tessera.llm.queries import END_ID, tokenizer_path
from tessera.llm.token_output import token_output
from tessera.session import drop_scratch, scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rANS files; per document what the files hold."""
    return token_output(docs, tokenizer_path(), END_ID)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Tokens and the similarity of texts are beyond SQL; tests/llm/test_brute_force.py has the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_scratch(spark, last)
        last = path
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
