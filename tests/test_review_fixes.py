"""Cases that a review found wrong: masked log-softmax, NULL groups, wide frames."""

import math

from pyspark.sql import functions as F

from tessera.functions.vectors import log_softmax
from tessera.operators.index import cumulative, with_halo


def test_log_softmax_with_masked_values(spark):
    inf = float("-inf")
    rows = [([inf, 0.0, 0.0],), ([0.0, inf, 0.0],), ([0.0, 0.0, inf],)]
    for (v,), r in zip(rows, spark.createDataFrame(rows, "v array<double>").select(log_softmax("v")).collect()):
        for x, y in zip(v, r[0]):
            assert y == inf if x == inf else abs(y + math.log(2)) < 1e-12


def test_halo_wider_than_a_bucket(spark):
    df = spark.range(1, 20).select(F.lit("a").alias("g"), F.col("id").alias("seq"))
    assert with_halo(df, "seq", 9, bucket_size=4).where(~F.col("_halo")).count() == 19


def test_running_sum_of_a_null_group_over_buckets(spark):
    df = spark.range(1, 11).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("seq"))
    out = cumulative(df, "g", "seq", [("n", "sum", F.lit(1))], bucket_size=4)
    assert {r["seq"]: r["n"] for r in out.collect()} == {i: i for i in range(1, 11)}


def test_null_study_in_pareto_top_and_eta(spark):
    from tessera.operators import trials as TR
    from tessera.operators.skyline import dominated, pareto_front
    rows = [(s, i, "COMPLETE", float(9 - i), i, 100, "2024-01-01 00:00:00", "2024-01-01 00:01:00")
            for s in (None, "a") for i in range(1, 8)]
    df = spark.createDataFrame(rows, "study string, trial_number int, state string, divergence double, hits int, "
                                     "total int, started_at string, finished_at string")
    df = df.withColumn("started_at", df.started_at.cast("timestamp_ntz")).withColumn("finished_at", df.finished_at.cast("timestamp_ntz"))
    for frame, n in ((pareto_front(df), 7), (dominated(df), 0), (TR.top_trials(df, 3), 3), (TR.eta(df, 10), 7),
                     (TR.plateau(df, bucket_size=3), 7)):
        got = {r["study"]: r["count"] for r in frame.groupBy("study").count().collect()}
        assert got == ({None: n, "a": n} if n else {})


def test_vectors_keep_their_tail(spark):
    from tessera.sources.bindings import vectors
    df = spark.createDataFrame([(1, 3, [float(i) for i in range(20)]), (2, 7, [1.0] * 8), (3, 7, []), (4, 7, None)],
                               "vec_id long, label int, embedding array<float>")
    got = {(r.vec_id, r.layer): len(r.vec) for r in vectors(df).collect()}
    assert got == {(1, 0): 16, (1, 1): 4, (2, 0): 8}


def test_token_chunks_decode_ids(spark):
    from tessera.functions.udfs import token_chunks

    class Numbers:
        def encode(self, text):
            return [int(w[1:]) for w in text.split()]

        def decode(self, ids):
            return " ".join(f"w{i}" for i in ids)

    long = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, long), (2, "w5  w6"), (3, None), (4, "")], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_no): (r.start_token, r.n_tokens, r.text)
           for r in token_chunks(df, "text", Numbers, 10, 2, 1, ["doc_id"]).collect()}
    words = long.split()
    want = {(1, k): (8 * k, len(words[8 * k:8 * k + 10]), " ".join(words[8 * k:8 * k + 10])) for k in range(3)}
    assert got == want | {(2, 0): (0, 2, "w5  w6")}


def test_match_report_counts(spark):
    from tessera.operators.evaluate import match_report
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "prompt_id long")
    b = spark.createDataFrame([(2,), (3,), (3,), (4,)], "prompt_id long")
    assert match_report(a, b).first().asDict() == {"matched": 2, "left_only": 1, "right_only": 1,
                                                   "left_repeated": 1, "right_repeated": 1}


def test_token_chunks_hold_the_tokens_of_a_bounded_piece_of_a_batch(spark):
    from tessera.functions import udfs

    class Careful:
        def encode_batch(self, texts):
            if len(texts) > 1 and (len(texts) > udfs.TEXTS_AT_ONCE or sum(map(len, texts)) > udfs.CHARS_AT_ONCE):
                raise MemoryError(f"{len(texts)} texts at once")
            return [t.split() for t in texts]

        def decode_batch(self, windows):
            if sum(map(len, windows)) > udfs.CHARS_AT_ONCE:
                raise MemoryError(f"{len(windows)} windows at once")
            return [" ".join(w) for w in windows]

    rows = [(i, None if i % 7 == 0 else f"w{i} " * (i % 5 * 10)) for i in range(1500)] + [(1500, "ab " * 400_000), (None, "x y"), (1501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(map(tuple, udfs.token_chunks(df, "text", Careful, 20, 5, 1, ["doc_id"]).collect()), key=str)
    want = []
    for i, t in rows:
        w = (t or "").split()
        for k, at in enumerate([0] if 0 < len(w) <= 20 else range(0, len(w) - 5, 15)):
            want.append((i, k, at, len(w[at:at + 20]), t if len(w) <= 20 else " ".join(w[at:at + 20])))
    assert got == sorted(want, key=str)


def test_staging_and_reading_hold_one_file_and_a_small_batch(spark, tmp_path):
    import pyarrow as pa

    from tessera.plans.corpus_queries import DOC_END, store_files
    from tessera.sources import text_files as tf

    texts = [(k, f"{k} {i} " + "x" * 3000) for k in range(40) for i in range(50)]
    asked = []

    def batches():
        for at in range(0, len(texts), 30):
            asked.append((at, len(tf.list_files(str(tmp_path), [".txt", ".md", ".markdown"]))))
            k, t = zip(*texts[at:at + 30])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(t)], ["file", "text"])
    assert [k for b in store_files(batches(), str(tmp_path)) for k in b.column(0).to_pylist()] == list(range(40))
    assert all(written >= max(at - 1, 0) // 50 for at, written in asked)            # a whole file is written before the next batch
    files = tf.list_files(str(tmp_path), [".txt", ".md", ".markdown"])
    found = list(tf.read_files(str(tmp_path), files, DOC_END, "raise"))
    assert sorted(t for b in found for t in b.column(2).to_pylist()) == sorted(t for _, t in texts)
    assert max(b.nbytes for b in found) <= 2 * tf.BYTES_PER_BATCH
