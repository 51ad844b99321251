"""Text-file source (batch and stream), append-stable index, slices."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.append_index import append_batches, append_indexed, read_indexed, segments
from tessera.sources.corpus import load_slice, parse_slice
from tessera.sources.text_files import dealt, parts_of, read_text_files, stream_text_files
from tessera.streaming.responses_stream import stream_corpus
from tessera.streaming.sinks import run_append, stream_session


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "a" / "b").mkdir(parents=True)
    (d / "one.txt").write_bytes(b"first\r\nline\rend\n\n  second  ")
    (d / "a" / "two.MD").write_bytes("é\fü\f".encode())
    (d / "a" / "b" / "_three.markdown").write_bytes(b"")
    (d / "a" / "bad.txt").write_bytes(b"ok\fno\xff\f")
    (d / "a" / "skip.log").write_bytes(b"not a corpus file")
    return str(d)


def rows(df):
    return sorted(((os.path.basename(r.path), r.part, r.text, r.reason) for r in df.collect()), key=str)


def test_texts_and_reasons(spark, folder):
    got = rows(read_text_files(spark, folder, "\f"))
    assert got == sorted([("one.txt", 0, "first\nline\nend\n\n  second  ", None), ("two.MD", 0, "é", None), ("two.MD", 1, "ü", None),
                          ("_three.markdown", 0, "", None), ("bad.txt", None, None, "invalid utf-8 at byte 5")], key=str)
    assert rows(read_text_files(spark, folder, extensions=[".log"])) == [("skip.log", 0, "not a corpus file", None)]
    assert rows(read_text_files(spark, f"{folder}/one.txt")) == [("one.txt", 0, "first\nline\nend\n\n  second  ", None)]
    with pytest.raises(Exception, match="invalid utf-8"):
        read_text_files(spark, folder, on_error="raise").collect()
    for bad, why in ((f"{folder}/a/skip.log", "unsupported"), (f"{folder}/none", "none")):
        with pytest.raises(Exception, match=why):
            read_text_files(spark, bad).collect()
    os.makedirs(f"{folder}/empty")
    assert read_text_files(spark, f"{folder}/empty").count() == 0


def test_small_files_share_a_task():
    files = [(f"f{i:03d}", 100) for i in range(500)] + [("large", 10_000_000), ("z", 5)]
    tasks = [t.files for t in dealt(files, 100 * 1024)]
    assert sum(tasks, []) == files and len(tasks) == 7
    assert [("large", 10_000_000)] in tasks and max(map(len, tasks)) == 100
    assert dealt([], 10) == []


def test_parts():
    assert parts_of(b"", "\f") == [""] and parts_of(b"\f", "\f") == [""] and parts_of(b"a\f\fb", "\f") == ["a", "", "b"]


def test_stream_sees_each_file_once_and_its_rejects(spark, folder, tmp_path):
    def run():
        q = run_append(stream_text_files(spark, folder, f"{tmp_path}/log", "\f"), f"{tmp_path}/out", f"{tmp_path}/ck")
        return q.lastProgress and q.lastProgress["numInputRows"]
    run()
    with open(f"{folder}/new.txt", "wb") as f:
        f.write(b"x\fy\f")
    os.utime(f"{folder}/new.txt", (1, 1))                  # older than what was read before
    run()
    run()
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == rows(read_text_files(spark, folder, "\f")) and len(got) == 7
    # another stream over the same folder has its own log
    with open(f"{folder}/long.txt", "w") as f:
        f.write(" ".join(f"w{i}" for i in range(60)))
    run_append(stream_corpus(spark, folder, f"{tmp_path}/log2"), f"{tmp_path}/chunks", f"{tmp_path}/ck2")
    assert [(os.path.basename(r.doc_path), r.n_tokens) for r in spark.read.parquet(f"{tmp_path}/chunks").collect()] == [("long.txt", 60)]
    run_append(stream_corpus(spark, folder, f"{tmp_path}/log3", rejects=True), f"{tmp_path}/rejects", f"{tmp_path}/ck3")
    assert [(os.path.basename(r.path), r.reason) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()] == [("bad.txt", "invalid utf-8 at byte 5")]


def test_numbers_stay_under_appends(spark, tmp_path):
    path, r = f"{tmp_path}/ix", random.Random(2)
    given, at = {}, 0
    for part in range(4):
        keys = [f"k{part}-{r.randrange(10**6):06d}" for _ in range(r.randrange(1, 400))] if part != 2 else []
        df = spark.createDataFrame([(k, len(k)) for k in dict.fromkeys(keys)], "key string, x int")
        first, n = append_indexed(df, path, "key")
        assert (first, n) == (at, df.count())
        at += n
        now = {row.key: row.idx for row in read_indexed(spark, path).collect()}
        assert all(now[k] == i for k, i in given.items()) and sorted(now.values()) == list(range(at))
        mine = sorted(k for k in now if k not in given)
        assert [now[k] for k in mine] == list(range(first, at))
        given = now
    assert append_indexed(df, path, "key", segment=3) == (first, n)      # again: nothing changes
    assert segments(spark, path).count() == 4 and read_indexed(spark, path).count() == at
    with pytest.raises(ValueError):
        append_indexed(df, path, "key", segment=-1)


def test_rows_of_a_broken_append_do_not_count(spark, tmp_path):
    path = f"{tmp_path}/ix"
    df = spark.range(10).select(F.col("id").alias("k"))
    append_indexed(df, path, "k", segment=0)
    df.withColumn("idx", F.col("k") + 10).write.parquet(f"{path}/rows/segment=1")      # stopped before its log row
    assert read_indexed(spark, path).count() == 10
    assert append_indexed(spark.range(100, 105).select(F.col("id").alias("k")), path, "k", segment=1) == (10, 5)
    assert sorted(r.idx for r in read_indexed(spark, path).collect()) == list(range(15))


def test_micro_batches_as_segments(spark, tmp_path):
    for part in range(2):
        spark.range(part * 50, part * 50 + 50).write.parquet(f"{tmp_path}/in/{part}")
        stream = stream_session(spark, 2).readStream.schema("id long").parquet(f"{tmp_path}/in/*")
        q = (stream.writeStream.foreachBatch(append_batches("id", f"{tmp_path}/ix")).option("checkpointLocation", f"{tmp_path}/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    assert {r.id: r.idx for r in read_indexed(spark, f"{tmp_path}/ix").collect()} == {i: i for i in range(100)}


@pytest.mark.parametrize("spec", ["a", "a[:5]", "a[3:7]", "a[10%:50%]", "a[-4:]", "a[:-30]", "a[95%:]", "a[:0]", "a[40:50]", "a[:50%]", "a[-200:5]", "b[:]"])
def test_slices_like_a_list(spark, spec):
    values = {"a": [f"t{i:02d}" for i in range(33)], "b": [], "c": ["x"]}
    df = spark.createDataFrame([(s, i, t) for s, v in values.items() for i, t in enumerate(v)], "split string, pos int, text string")
    name, lo, hi = parse_slice(spec)
    at = lambda b: None if b is None else round(b[0] * len(values[name]) / 100) if b[1] else b[0]
    got = [r.text for r in load_slice(df, spec, "text", "pos", "split").orderBy("pos").collect()]
    assert got == values[name][at(lo):at(hi)]
    for bad in ("a[1]", "[1:2]", "a[x:2]", ""):
        with pytest.raises(ValueError):
            parse_slice(bad)
