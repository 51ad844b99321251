"""Operator 1: token ids of a corpus in rANS files, in ascending doc_id order.

Plan: one range shuffle by id, tokenise each text once into a narrow table of
ids, count the shared frequency table over all ids (at most one row per
vocabulary entry reaches the driver), write one file per task, read the files
back.  Rows with a null id come first; rows of equal id are ordered by text.
Null and empty texts hold the end id alone; repeated rows are kept.  Only the
id and text columns are read, so other columns cannot clash.  An empty table
gives no file and no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import as_text, fresh_name, open_bytes, write_bytes

TEXTS_PER_STEP = 256


def tokenise_in_order(docs: DataFrame, tokenizer_path: str, end_id: int, vocab_size: int, id_col: str, text_col: str) -> DataFrame:
    """(shard, shard_start, doc_id, n, ids, counts): shards follow one another in
    id order.  The last row of a shard holds only the occurrences of every id
    in it (``counts``), which is null in all others."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = (rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", "text"))

    def tokenise(batches):
        from pyspark import TaskContext

        from .tokenize import WordCacheTokenizer
        tok, shard, at = WordCacheTokenizer.of_worker(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u2").tobytes()
        total = np.zeros(vocab_size, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS_PER_STEP):
                part = b.slice(i, TEXTS_PER_STEP)
                ids = [x + end for x in tok.encode(as_text(part.column(1)))]
                n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
                starts = at + np.concatenate(([0], np.cumsum(n)[:-1]))
                at += int(n.sum())
                total += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=vocab_size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), shard, np.int64)), pa.array(starts), part.column(0), pa.array(n),
                     pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if at:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([shard]), none, none, none, pa.nulls(1, pa.binary()),
                                              pa.array([total.astype("<i8").tobytes()], pa.binary())], names)
    names = ["shard", "shard_start", "doc_id", "n", "ids", "counts"]
    return rows.mapInArrow(tokenise, "shard long, shard_start long, doc_id long, n long, ids binary, counts binary")


def count_ids(tokens: DataFrame, vocab_size: int) -> np.ndarray:
    """Occurrences of every id over all documents, from the shards' counts."""
    def count(batches):
        total = np.zeros(vocab_size, np.int64)
        for b in batches:
            for counts in b.column(0).to_pylist():
                total += np.frombuffer(counts, "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])
    rows = tokens.where("counts is not null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocab_size, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 2, vocab_size: int = 49408,
                  id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Write the corpus.  Returns the manifest (path, n_docs, n_tokens, bytes)
    and the path of the table of frequencies."""
    from . import rans
    spark = docs.sparkSession
    tokens_at = scratch_path(spark, "ids")
    tokenise_in_order(docs, tokenizer_path, end_id, vocab_size, id_col, text_col).write.option("compression", "lz4").parquet(tokens_at)
    tokens = spark.read.parquet(tokens_at)
    freq = rans.normalise(count_ids(tokens, vocab_size))
    tokens = tokens.where("counts is null").drop("counts")
    folder = scratch_path(spark, "rans")
    table_at, _ = write_bytes(folder, "table.u4", [freq.astype("<u4").tobytes()])
    # one row per shard: the ids of all shards before it
    shards = tokens.groupBy("shard").agg(F.sum("n").alias("total"))
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    bases = {r["shard"]: r["base"] for r in shards.collect()}
    freq_b = spark.sparkContext.broadcast(freq)          # at most vocab_size numbers

    def write(batches):
        table = rans.Table(freq_b.value)
        state = {"shard": None}

        def rows():
            for b in batches:
                d = b.to_pydict()
                yield from zip(d["shard"], d["shard_start"], d["doc_id"], d["n"], d["ids"])
        stream = rows()
        row = next(stream, None)
        done = []
        while row is not None:
            shard, docs_, n_tokens = row[0], [], 0

            def runs():
                nonlocal row, n_tokens
                while row is not None and row[0] == shard:
                    docs_.append((row[2] is not None, row[2] or 0, bases[shard] + row[1], row[3]))
                    n_tokens += row[3]
                    yield np.frombuffer(row[4], "<u2")
                    row = next(stream, None)
            path, size = write_bytes(folder, fresh_name(f"part-{shard:06d}", ".rans"), rans.write_file(table, runs(), docs_))
            done.append((path, len(docs_), n_tokens, size))
        del state
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "n_docs", "n_tokens", "bytes"])
    manifest_at = scratch_path(spark, "rans-manifest")
    tokens.mapInArrow(write, "path string, n_docs long, n_tokens long, bytes long").write.parquet(manifest_at)
    return spark.read.parquet(manifest_at), table_at


def read_corpus(manifest: DataFrame, table_at: str) -> DataFrame:
    """Decode every file of the manifest: one row per document with its place
    and the crc32 of its ids as little-endian unsigned 32-bit integers."""
    n_files = max(1, manifest.count())

    def read(batches):
        from . import rans
        table = None
        for b in batches:
            for path in b.column(0).to_pylist():
                if table is None:
                    table = rans.Table(np.frombuffer(open_bytes(table_at).read(), "<u4"))
                rows = []
                with open_bytes(path) as source:
                    for has, doc, start, ids in rans.read_file(table, source):
                        rows.append((doc if has else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                     ["doc_id", "start", "n_tokens", "ids_crc32"])
    return (manifest.select("path").repartition(n_files)
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, vocab_size: int = 49408) -> DataFrame:
    """Encode ``docs`` to files and return what the files hold per document."""
    manifest, table_at = encode_corpus(docs, tokenizer_path, end_id, vocab_size)
    return read_corpus(manifest, table_at)
