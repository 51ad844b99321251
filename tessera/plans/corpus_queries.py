"""Registered corpus-preparation queries (documents -> chunks -> examples)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from tessera.functions.text import strip_ws, tokens, training_columns
from tessera.functions.udfs import WhitespaceTokenizer, batch_score, length_model, token_chunks, tokenize
from tessera.operators.append_index import append_indexed, read_indexed
from tessera.operators.chunking import chunk_tokens, min_tokens, with_tokens
from tessera.operators.examples import TEMPLATES, assign_template, preview, rendered, to_examples
from tessera.operators.index import with_global_index
from tessera.operators.scoring import score_missing
from tessera.operators.split import split_train_val
from tessera.operators.training import count_while_chunking, observed_stats, split_step_plan
from tessera.plans.common import (CHUNKS_CTE, PROMPTS_CTE, T, L, examples_cte, sql_strip,
                                  sql_tokens, sql_topic)
from tessera.session import materialize, scratch_path
from tessera.sources import bindings as B
from tessera.sources.corpus import cohort_counts, load_prompts, load_slice, pick_text_column, to_segments
from tessera.sources.sinks import write_examples
from tessera.sources.text_files import open_path, read_text_files
from tessera.streaming.responses_stream import stream_corpus
from tessera.streaming.sinks import run_append, session_like

ORDER = ["doc_id", "segment_no", "chunk_no"]


def doc_segments(spark, sf):
    """Whole documents as single stripped segments."""
    return T(spark, sf, "documents").select("doc_id", F.lit(0).alias("segment_no"),
                                            strip_ws("text").alias("text"))


def chunks(spark, sf, size=1024, overlap=128):
    return chunk_tokens(with_tokens(doc_segments(spark, sf)), size, overlap,
                        keep=["doc_id", "segment_no"], min_n=50)


def stored_chunks(spark, sf):
    """Chunks written once to the shared folder: the global index then scans
    only the key columns and tokenisation runs a single time."""
    return materialize(chunks(spark, sf), "chunks")


def examples(spark, sf):
    return split_train_val(to_examples(stored_chunks(spark, sf), ORDER, keep=ORDER), "example_id")


FILE_DOCS = 50          # documents in one staged file
DOC_END = "\f"          # stands after each document; the tables' texts hold none
_SUFFIX = [".txt", ".MD", ".markdown"]


def store_files(batches, path: str, odd: bool = False):
    """Write (file, text) rows, which come in the order of the files, as files of
    texts; yields the number of each file when it is written."""
    def store(k, texts):
        data = "".join(t + DOC_END for t in texts).encode()
        suffix = ".log" if odd and k % 5 == 4 else _SUFFIX[k % 3]
        if odd and k % 6 == 5:
            data = data[:10] + b"\xff" + data[10:]
        files, root = open_path(path)
        files.create_dir(f"{root}/d{k % 7}", recursive=True)
        with files.open_output_stream(f"{root}/d{k % 7}/f{k}{suffix}", compression=None) as f:
            f.write(data)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["file"])
    at, texts = None, []
    for b in batches:
        for k, text in zip(b.column(0).to_pylist(), b.column(1)):
            if texts and k != at:
                yield store(at, texts)
                texts = []
            at = k
            texts.append(text.as_py())
    if texts:
        yield store(at, texts)


def stage_documents_as_files(spark, sf, odd: bool = False):
    """The documents as a folder tree of text files, ``FILE_DOCS`` in each; every
    task writes its own files, in turn: it holds a small batch and the file that
    it is at.  With ``odd`` some files are not UTF-8 and some have a suffix that a
    corpus does not take."""
    path = scratch_path(spark, "docs_as_files")
    n = F.col("doc_id").cast("long")
    file = F.floor(n / FILE_DOCS).alias("file")
    own = session_like(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": 4 * FILE_DOCS})
    docs = T(own, sf, "documents").where("text is not null").select(file, "doc_id", "text")
    docs = docs.repartition("file").sortWithinPartitions("file", "doc_id", "text").select("file", "text")
    docs.mapInArrow(lambda batches: store_files(batches, path, odd), "file long").write.format("noop").mode("overwrite").save()
    return path


# ---------------------------------------------------------------- queries --
def q_src_text_corpus(spark, sf):
    docs = read_text_files(spark, stage_documents_as_files(spark, sf), DOC_END).where("reason is null")
    return docs.select("text", L(F.length("text")).alias("n_chars"))


def q_src_corpus_files(spark, sf):
    """Per file of a mixed folder: its texts, or the reason why it was refused."""
    rows = read_text_files(spark, stage_documents_as_files(spark, sf, odd=True), DOC_END, bytes_per_task=1 << 20)
    file = F.regexp_extract("path", "/f([0-9]+)[.][a-zA-Z]+$", 1).cast("long").alias("file")
    return rows.groupBy(file).agg(F.count("part").alias("n_texts"), L(F.coalesce(F.sum(F.length("text")), F.lit(0))).alias("n_chars"),
                                  F.regexp_replace(F.max("reason"), " at byte.*", "").alias("reason"))


def q_src_paragraphs(spark, sf):
    d = T(spark, sf, "documents")
    return to_segments(d, sep="\n").select(L("doc_id").alias("doc_id"), L("segment_no").alias("segment_no"), "text")


def q_src_text_column(spark, sf):
    a = pick_text_column(T(spark, sf, "documents"), keep=[F.col("doc_id").alias("id")])
    b = pick_text_column(T(spark, sf, "pages"), keep=[F.col("page_id").alias("id")])
    return (a.select(F.lit("documents").alias("source"), "id", "text")
            .unionByName(b.select(F.lit("pages").alias("source"), "id", "text")))


def q_src_prompt_slice(spark, sf):
    p = B.prompts(T(spark, sf, "conversations"))
    s = load_prompts(p, "text", B.PROMPT_KEY, split_col="cohort", split="good", limit=100)
    return s.select("conv_id", L("turn").alias("turn"), "text")


SLICES = ["good[100:250]", "good[10%:20%]", "bad[-30:]", "bad[95%:]", "good[:1%]"]


def q_src_prompt_range(spark, sf):
    """Slices by position and by share, from both ends."""
    p = materialize(B.prompts(T(spark, sf, "conversations")), "prompts")
    out = None
    for s in SLICES:
        rows = load_slice(p, s, "text", B.PROMPT_KEY, split_col="cohort").select(F.lit(s).alias("slice"), "conv_id", L("turn").alias("turn"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def q_src_cohort_union(spark, sf):
    p = B.prompts(T(spark, sf, "conversations"))
    return cohort_counts(p)  # the cohort is a column of one table: no union of four scans


def q_snk_split_dataset(spark, sf):
    path = scratch_path(spark, "split_dataset")
    write_examples(examples(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select(L("example_id").alias("example_id"), "split", "instruction", "response")


def q_flt_min_tokens(spark, sf):
    segs = to_segments(T(spark, sf, "documents"), sep="\n")
    kept = min_tokens(with_tokens(segs), 50)
    return kept.select(L("doc_id").alias("doc_id"), L("segment_no").alias("segment_no"),
                       L(F.size("tokens")).alias("n_tokens"))


def q_seq_sliding_chunks(spark, sf):
    c = chunks(spark, sf)
    return c.select(L("doc_id").alias("doc_id"), L("chunk_no").alias("chunk_no"),
                    L("start_token").alias("start_token"), L("n_tokens").alias("n_tokens"), "text")


def q_idx_global(spark, sf):
    g = with_global_index(stored_chunks(spark, sf), ORDER, "idx")
    return g.select(L("doc_id").alias("doc_id"), L("chunk_no").alias("chunk_no"), "idx")


def q_idx_append(spark, sf):
    """Chunks arrive in three appends (by doc_id modulo 3); each takes the
    numbers that follow, and the templates go on from there."""
    path, rows = scratch_path(spark, "indexed"), stored_chunks(spark, sf).select(*ORDER)
    for part in range(3):
        append_indexed(rows.where(F.pmod("doc_id", F.lit(3)) == part), path, ORDER, segment=part)
    got = read_indexed(spark, path)
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("idx") % len(TEMPLATES)).cast("int") + 1)
    return got.select(L("doc_id").alias("doc_id"), L("chunk_no").alias("chunk_no"), "segment", "idx", template.alias("template"))


def q_txt_template_cycle(spark, sf):
    a = assign_template(stored_chunks(spark, sf), ORDER)
    return a.select("example_id", "template")


def q_txt_topic(spark, sf):
    from tessera.functions.text import topic
    return chunks(spark, sf).select(L("doc_id").alias("doc_id"), L("chunk_no").alias("chunk_no"),
                                    topic("text").alias("topic"))


def q_txt_instruction(spark, sf):
    e = to_examples(stored_chunks(spark, sf), ORDER)
    return e.select("example_id", "instruction", "response")


def q_split_train_val(spark, sf):
    return examples(spark, sf).select("example_id", "split")


def q_split_exact(spark, sf):
    """Exactly floor(fraction * n) training documents, keyed by doc_id."""
    d = T(spark, sf, "documents").select("doc_id")
    return split_train_val(d, "doc_id", exact=True).select("doc_id", "split")


def q_top_preview(spark, sf):
    return preview(examples(spark, sf), 3)


def q_txt_render(spark, sf):
    return rendered(to_examples(stored_chunks(spark, sf), ORDER)).select("example_id", "prompt")


def q_txt_truncate_tokens(spark, sf):
    r = rendered(to_examples(stored_chunks(spark, sf), ORDER))
    cols = training_columns(tokens("prompt"), 2048)
    return r.select("example_id", *[v.alias(k) for k, v in cols.items()]).select(
        "example_id", L(F.size("input_ids")).alias("n_input"),
        L(F.size("labels")).alias("n_labels"),
        F.element_at("input_ids", -1).alias("last_token"))


def q_agg_ingest_stats(spark, sf):
    """Segments and chunks are counted while the chunks are written, once."""
    chunked, seen, made = count_while_chunking(doc_segments(spark, sf), lambda s: chunk_tokens(
        with_tokens(s), 1024, 128, keep=["doc_id", "segment_no"], min_n=50))
    stored = materialize(chunked, "chunks")
    ex = split_train_val(to_examples(stored, ORDER, keep=ORDER), "example_id")
    return observed_stats(spark, seen.get, made.get, ex).select("metric", L("value").alias("value"))


def q_num_step_plan(spark, sf):
    p = split_step_plan(examples(spark, sf))
    return p.select("split", L("n_rows").alias("n_rows"), L("total_steps").alias("total_steps"),
                    L("warmup_steps").alias("warmup_steps"), L("effective_batch").alias("effective_batch"))


def q_udf_tokenizer(spark, sf):
    d = tokenize(T(spark, sf, "documents"), "text", WhitespaceTokenizer)
    return d.select("doc_id", L(F.size("tokens")).alias("n_tokens"))


def q_udf_token_chunks(spark, sf):
    c = token_chunks(doc_segments(spark, sf), "text", WhitespaceTokenizer, min_n=50, keep=["doc_id"])
    return c.select(L("doc_id").alias("doc_id"), "chunk_no", "start_token", "n_tokens", "text")


def q_udf_batch_score(spark, sf):
    d = batch_score(T(spark, sf, "documents"), "text", length_model, IntegerType(), batch_size=64)
    return d.select("doc_id", L("score").alias("score"))


MOST_CHARS, BATCH_CHARS = 60_000, 20_000


def small_memory_model():
    """A stand-in model that cannot take batches of over BATCH_CHARS characters,
    nor any text of over MOST_CHARS."""
    import math

    def score(texts):
        n = [len(t or "") for t in texts]
        if len(texts) > 1 and sum(n) > BATCH_CHARS or max(n) > MOST_CHARS:
            raise MemoryError("too long")
        return [{"text": (t or "")[:20][::-1], "logprobs": [-math.log(1 + k), math.log((1 + k) / (2 + k))], "vector": [float(k), float((t or "").count(" "))]}
                for t, k in zip(texts, n)]
    return score


SCORED = StructType([StructField("text", StringType()), StructField("logprobs", ArrayType(DoubleType())), StructField("vector", ArrayType(FloatType()))])


def q_udf_batch_adaptive(spark, sf):
    """Batches halved where the model fails; a first run that stops at half of
    the rows, and a second one that scores the rest."""
    docs, path = T(spark, sf, "documents"), scratch_path(spark, "scored")
    score_missing(docs.where("doc_id % 2 = 0"), "doc_id", "text", small_memory_model, SCORED, path, retry_errors=False)
    r = score_missing(docs, "doc_id", "text", small_memory_model, SCORED, path, retry_errors=False)
    return r.select("doc_id", "text", F.round(F.element_at("logprobs", 1), 6).alias("lp"), L(F.element_at("vector", 1)).alias("n_chars"),
                    L(F.element_at("vector", 2)).alias("n_spaces"), "error")


def q_str_corpus(spark, sf):
    src = stage_documents_as_files(spark, sf)
    out, ck, log = (scratch_path(spark, f"str_corpus_{x}") for x in ("out", "ckpt", "log"))
    run_append(stream_corpus(spark, src, log, DOC_END), out, ck)
    c = spark.read.parquet(out)
    return c.select(L("chunk_no").alias("chunk_no"), L("start_token").alias("start_token"),
                    L("n_tokens").alias("n_tokens"), "text")


QUERIES = {
    "src_text_corpus": q_src_text_corpus,
    "src_paragraphs": q_src_paragraphs,
    "src_text_column": q_src_text_column,
    "src_prompt_slice": q_src_prompt_slice,
    "src_cohort_union": q_src_cohort_union,
    "snk_split_dataset": q_snk_split_dataset,
    "flt_min_tokens": q_flt_min_tokens,
    "seq_sliding_chunks": q_seq_sliding_chunks,
    "idx_global": q_idx_global,
    "txt_template_cycle": q_txt_template_cycle,
    "txt_topic": q_txt_topic,
    "txt_instruction": q_txt_instruction,
    "split_train_val": q_split_train_val,
    "split_exact": q_split_exact,
    "top_preview": q_top_preview,
    "txt_render": q_txt_render,
    "txt_truncate_tokens": q_txt_truncate_tokens,
    "agg_ingest_stats": q_agg_ingest_stats,
    "num_step_plan": q_num_step_plan,
    "udf_tokenizer": q_udf_tokenizer,
    "udf_token_chunks": q_udf_token_chunks,
    "udf_batch_score": q_udf_batch_score,
    "src_corpus_files": q_src_corpus_files,
    "src_prompt_range": q_src_prompt_range,
    "idx_append": q_idx_append,
    "udf_batch_adaptive": q_udf_batch_adaptive,
    "str_corpus": q_str_corpus,
}

_EX = examples_cte(TEMPLATES)
_SEGS = f"""segs AS (
  SELECT doc_id, CAST(unnest(range(0, len(l))) AS BIGINT) AS segment_no, unnest(l) AS text
  FROM (SELECT doc_id, CASE WHEN len(p) = 0 THEN [text] ELSE p END AS l
        FROM (SELECT doc_id, text,
                     list_filter(list_transform(string_split(text, chr(10)), lambda s: {sql_strip('s')}),
                                 lambda s: s <> '') AS p
              FROM documents)))"""
_RENDER = "'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10) || response"

_SLICED = " UNION ALL ".join(
    f"SELECT '{s}' AS slice, conv_id, turn, text FROM numbered WHERE cohort = '{s[:s.index('[')]}' AND {cond}" for s, cond in zip(SLICES, (
        "i >= 100 AND i < 250", "i >= round_even(n * 0.10, 0) AND i < round_even(n * 0.20, 0)", "i >= n - 30",
        "i >= round_even(n * 0.95, 0)", "i < round_even(n * 0.01, 0)")))

ORACLES = {
    "src_corpus_files": f"""SELECT doc_id // {FILE_DOCS} AS file, CASE WHEN bad THEN 0 ELSE count(*) END AS n_texts,
        CAST(CASE WHEN bad THEN 0 ELSE sum(length(regexp_replace(text, '\\r\\n?', chr(10), 'g'))) END AS BIGINT) AS n_chars,
        CASE WHEN bad THEN 'invalid utf-8' END AS reason
        FROM (SELECT *, doc_id // {FILE_DOCS} % 6 = 5 AS bad FROM documents WHERE text IS NOT NULL)
        WHERE doc_id // {FILE_DOCS} % 5 <> 4 GROUP BY doc_id // {FILE_DOCS}, bad""",
    "src_prompt_range": f"""WITH {PROMPTS_CTE}, numbered AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY conv_id, turn) - 1 AS i,
          count(*) OVER (PARTITION BY cohort) AS n FROM prompts) {_SLICED}""",
    "idx_append": f"""WITH {CHUNKS_CTE}, numbered AS (
          SELECT *, CAST(doc_id % 3 AS BIGINT) AS segment, CAST(row_number() OVER (ORDER BY doc_id % 3, doc_id, segment_no, chunk_no) - 1 AS BIGINT) AS idx FROM chunks)
        SELECT doc_id, chunk_no, segment, idx, list_extract([{', '.join("'" + t.replace("'", "''") + "'" for t in TEMPLATES)}], CAST(idx % {len(TEMPLATES)} AS INTEGER) + 1) AS template
        FROM numbered""",
    "udf_batch_adaptive": f"""SELECT doc_id, CASE WHEN fits THEN reverse(left(t, 20)) END AS text, CASE WHEN fits THEN round(-ln(1 + length(t)), 6) END AS lp,
        CASE WHEN fits THEN length(t) END AS n_chars, CASE WHEN fits THEN length(t) - length(replace(t, ' ', '')) END AS n_spaces,
        CASE WHEN NOT fits THEN 'MemoryError: too long' END AS error
        FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) <= {MOST_CHARS} AS fits FROM documents)""",
    "src_text_corpus": """SELECT regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text,
        CAST(length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS BIGINT) AS n_chars FROM documents""",
    "src_paragraphs": f"WITH {_SEGS} SELECT doc_id, segment_no, text FROM segs",
    "src_text_column": """SELECT 'documents' AS source, doc_id AS id, text FROM documents
        UNION ALL SELECT 'pages' AS source, page_id AS id, CAST(page_id AS VARCHAR) AS text FROM pages""",
    "src_prompt_slice": f"WITH {PROMPTS_CTE} SELECT conv_id, turn, text FROM prompts WHERE cohort = 'good' ORDER BY conv_id, turn LIMIT 100",
    "src_cohort_union": f"WITH {PROMPTS_CTE} SELECT cohort, purpose, count(*) AS n_prompts FROM prompts GROUP BY cohort, purpose",
    "snk_split_dataset": f"WITH {_EX} SELECT example_id, split, instruction, response FROM examples",
    "flt_min_tokens": f"""WITH {_SEGS} SELECT doc_id, segment_no, CAST(len({sql_tokens('text')}) AS BIGINT) AS n_tokens
        FROM segs WHERE len({sql_tokens('text')}) >= 50""",
    "seq_sliding_chunks": f"WITH {CHUNKS_CTE} SELECT doc_id, chunk_no, start_token, n_tokens, text FROM chunks",
    "idx_global": f"""WITH {CHUNKS_CTE} SELECT doc_id, chunk_no,
        CAST(row_number() OVER (ORDER BY doc_id, segment_no, chunk_no) - 1 AS BIGINT) AS idx FROM chunks""",
    "txt_template_cycle": f"WITH {_EX} SELECT example_id, template FROM examples",
    "txt_topic": f"WITH {CHUNKS_CTE} SELECT doc_id, chunk_no, {sql_topic('text')} AS topic FROM chunks",
    "txt_instruction": f"WITH {_EX} SELECT example_id, instruction, response FROM examples",
    "split_train_val": f"WITH {_EX} SELECT example_id, split FROM examples",
    "split_exact": """WITH r AS (
          SELECT doc_id, row_number() OVER (ORDER BY substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8), doc_id) AS k,
                 count(*) OVER () AS n FROM documents)
        SELECT doc_id, CASE WHEN k <= CAST(floor(0.9 * n) AS BIGINT) THEN 'train' ELSE 'validation' END AS split FROM r""",
    "top_preview": f"""WITH {_EX} SELECT example_id, left(instruction, 150) AS instruction, left(response, 300) AS response
        FROM examples WHERE split = 'train' ORDER BY example_id LIMIT 3""",
    "txt_render": f"WITH {_EX} SELECT example_id, {_RENDER} AS prompt FROM examples",
    "txt_truncate_tokens": f"""WITH {_EX}, r AS (SELECT example_id, list_slice({sql_tokens(_RENDER)}, 1, 2048) AS ids FROM examples)
        SELECT example_id, CAST(len(ids) AS BIGINT) AS n_input, CAST(len(ids) AS BIGINT) AS n_labels,
               ids[-1] AS last_token FROM r""",
    "agg_ingest_stats": f"""WITH {_EX}
        SELECT 'segments' AS metric, CAST(count(*) AS BIGINT) AS value FROM documents
        UNION ALL SELECT 'chunks', CAST(count(*) AS BIGINT) FROM chunks
        UNION ALL SELECT split, CAST(count(*) AS BIGINT) FROM examples GROUP BY split""",
    "num_step_plan": f"""WITH {_EX}, c AS (SELECT split, count(*) AS n FROM examples GROUP BY split)
        SELECT split, CAST(n AS BIGINT) AS n_rows, CAST((n // 4 // 8) * 3 AS BIGINT) AS total_steps,
               CAST(floor((n // 4 // 8) * 3 * 0.1) AS BIGINT) AS warmup_steps, CAST(32 AS BIGINT) AS effective_batch
        FROM c""",
    "udf_tokenizer": f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS BIGINT) AS n_tokens FROM documents",
    "udf_token_chunks": f"WITH {CHUNKS_CTE} SELECT doc_id, chunk_no, start_token, n_tokens, text FROM chunks",
    "udf_batch_score": "SELECT doc_id, CAST(length(text) AS BIGINT) AS score FROM documents",
    "str_corpus": f"WITH {CHUNKS_CTE} SELECT chunk_no, start_token, n_tokens, text FROM chunks",
}
