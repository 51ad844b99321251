"""Shared pieces of the registered queries: table access, rounding, and
the DuckDB oracle fragments that mirror each binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.session import table

# Markers that occur in the bound (invented-prose) tables; real refusal
# markers match nothing there, so they are exercised in the unit tests.
QUERY_MARKERS = ["que ", "und ", "ai ", "license", "sorry"]


def T(spark, sf_dir, name):
    return table(spark, sf_dir, name)


def r6(col):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6)


def L(col):
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("long")


# ---- SQL fragments (DuckDB) -------------------------------------------------
WS = "[ \\t\\n\\r\\f\\x0B]"


def sql_strip(x: str) -> str:
    return f"trim({x}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def sql_markers(markers) -> str:
    return "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in markers) + "]"


def sql_norm(x: str) -> str:
    return f"replace(replace(lower({x}), '*', ''), '’', '''')"


def sql_has_marker(x: str, markers) -> str:
    if not markers:
        return "false"
    return "(" + " OR ".join(f"contains({x}, '" + m.lower().replace("'", "''") + "')" for m in markers) + ")"


PROMPTS_CTE = """prompts AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn,
         CASE WHEN conv_id % 2 = 1 THEN 'bad' ELSE 'good' END AS cohort,
         CASE WHEN (conv_id // 2) % 5 = 0 THEN 'evaluation' ELSE 'direction' END AS purpose, text
  FROM conversations WHERE role = 'user')"""

ANSWERS_CTE = """answers AS (
  SELECT conv_id, CAST(turn - 1 AS BIGINT) AS turn, text AS response FROM conversations WHERE role = 'assistant')"""

RESPONSES_CTE = ANSWERS_CTE + f""",
responses AS (
  SELECT 'base' AS model_id, conv_id, turn, response FROM answers
  UNION ALL
  SELECT 'head20' AS model_id, conv_id, turn,
         array_to_string(list_slice({sql_tokens('response')}, 1, 20), ' ') AS response
  FROM answers)"""

TRIALS_CTE = """trials AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS study,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS trial_number,
         CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'COMPLETE' END AS state,
         value / 100 AS divergence,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS hits,
         100 AS total,
         value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_type = 'view' THEN NULL
              ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) / 4.0 END AS direction_index,
         ts AS started_at,
         ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS finished_at
  FROM events)"""

SCORED_CTE = TRIALS_CTE + """,
scored AS (
  SELECT *, 0.6 * divergence + 0.4 * rate_pct / 100 AS score
  FROM (SELECT *, CASE WHEN total <> 0 THEN CAST(hits AS DOUBLE) / total * 100 ELSE 0.0 END AS rate_pct
        FROM trials)),
seqd AS (
  SELECT *, row_number() OVER (PARTITION BY study ORDER BY trial_number) AS seq
  FROM scored WHERE state = 'COMPLETE')"""

TREND_CTE = SCORED_CTE + """,
trend AS (
  SELECT study, trial_number, seq, score, improvement,
         CASE WHEN improvement IS NULL THEN 'insufficient_data'
              WHEN improvement > 0.05 THEN 'improving'
              WHEN improvement < -0.05 THEN 'degrading' ELSE 'stable' END AS trend
  FROM (SELECT *, CASE WHEN seq >= 10 THEN
          avg(score) OVER (PARTITION BY study ORDER BY seq ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING)
        - avg(score) OVER (PARTITION BY study ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
        END AS improvement FROM seqd)),
best AS (
  SELECT study, trial_number, seq,
         arg_min(trial_number, (score, trial_number)) OVER (PARTITION BY study ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_trial
  FROM seqd)"""

SYMBOL_SQL = ("CASE trend WHEN 'improving' THEN '▼' WHEN 'degrading' THEN '▲' "
              "WHEN 'stable' THEN '▬' ELSE '?' END")

# Whole documents as one segment each -> tokens -> chunks (1024 / 128).
CHUNKS_CTE = f"""docseg AS (
  SELECT doc_id, 0 AS segment_no, {sql_strip('text')} AS text FROM documents),
tok AS (
  SELECT doc_id, segment_no, text, toks, len(toks) AS n
  FROM (SELECT *, {sql_tokens('text')} AS toks FROM docseg)
  WHERE len(toks) >= 50),
kk AS (
  SELECT *, unnest(range(0, CASE WHEN n <= 1024 THEN 1
                  ELSE 1 + CAST(ceil((n - 1024) / 896.0) AS BIGINT) END)) AS k
  FROM tok),
chunks AS (
  SELECT doc_id, segment_no, CAST(k AS BIGINT) AS chunk_no, CAST(k * 896 AS BIGINT) AS start_token,
         CAST(len(list_slice(toks, k * 896 + 1, k * 896 + 1024)) AS BIGINT) AS n_tokens,
         CASE WHEN n <= 1024 THEN text
              ELSE array_to_string(list_slice(toks, k * 896 + 1, k * 896 + 1024), ' ') END AS text
  FROM kk)"""


def sql_topic(x: str) -> str:
    t = f"left(split_part({x}, '.', 1), 100)"
    return f"(CASE WHEN length({t}) < 10 THEN left({x}, 100) ELSE {t} END)"


def examples_cte(templates) -> str:
    arr = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in templates) + "]"
    return CHUNKS_CTE + f""",
ex0 AS (
  SELECT CAST(row_number() OVER (ORDER BY doc_id, segment_no, chunk_no) - 1 AS BIGINT) AS example_id, *
  FROM chunks),
examples AS (
  SELECT example_id, doc_id, segment_no, chunk_no,
         list_extract({arr}, CAST(example_id % {len(templates)} AS INTEGER) + 1) AS template,
         list_extract({arr}, CAST(example_id % {len(templates)} AS INTEGER) + 1) || ' ' || {sql_topic('text')} AS instruction,
         text AS response,
         CASE WHEN substr(md5('42:' || CAST(example_id AS VARCHAR)), 1, 8) < 'e6666666'
              THEN 'train' ELSE 'validation' END AS split
  FROM ex0)"""


# Embedding-derived logprobs: base = log_softmax(2e), cand_<label> = log_softmax(e).
def sql_log_softmax(arr: str) -> str:
    return (f"list_transform({arr}, lambda x: x - (list_max({arr}) + "
            f"ln(list_sum(list_transform({arr}, lambda y: exp(y - list_max({arr})))))))")


LOGPROBS_CTE = f"""emb AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2) AS e2
  FROM embeddings),
logprobs AS (
  SELECT 'base' AS model_id, vec_id AS prompt_id, {sql_log_softmax('e2')} AS lp FROM emb
  UNION ALL
  SELECT 'cand_' || CAST(label AS VARCHAR) AS model_id, vec_id AS prompt_id, {sql_log_softmax('e')} AS lp FROM emb)"""

VECTORS_CTE = """vecs AS (
  SELECT vec_id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS cohort, CAST(layer AS INTEGER) AS layer,
         list_slice(embedding, layer * 16 + 1, layer * 16 + 16) AS vec
  FROM (SELECT *, unnest(range(0, (len(embedding) + 15) // 16)) AS layer FROM embeddings)),
vx AS (
  SELECT cohort, layer, vec_id, CAST(unnest(range(0, len(vec))) AS BIGINT) AS pos,
         CAST(unnest(vec) AS DOUBLE) AS x
  FROM vecs)"""

STEPS_CTE = """steps AS (
  SELECT CAST(o_custkey AS VARCHAR) AS run,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS step,
         o_totalprice / 125000 AS train_loss, o_totalprice / 100000 AS eval_loss
  FROM orders)"""

BENCH_CTE = """bench AS (
  SELECT p_brand AS config, CAST(p_size AS INTEGER) AS batch_size, sum(p_retailprice) / 1000 AS elapsed_s,
         CAST(count(*) * 100 AS BIGINT) AS tokens, p_size <= 32 AS ok
  FROM part GROUP BY p_brand, p_size),
usable AS (
  SELECT b.* FROM bench b JOIN (
    SELECT config, min(CASE WHEN NOT ok THEN batch_size END) AS ff FROM bench GROUP BY config) f
  ON b.config = f.config
  WHERE f.ff IS NULL OR b.batch_size < f.ff)"""
