"""Registered evaluation queries (responses, log-probabilities, vectors)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.text import as_chat, head_tokens, normalize_response, strip_prompt
from tessera.functions.udfs import batch_score
from tessera.functions.vectors import l2_normalize, last_state, log_softmax
from tessera.operators.centroids import centroid_contrast, centroids
from tessera.operators.conversation import conversations
from tessera.operators.evaluate import (compare, flag_responses, hit_rate, kl_divergence,
                                        marker_profile, match_report, pair)
from tessera.operators.marker_index import flag_rows, indexed_profile
from tessera.operators.stored_base import kl_against, relative_against, store_base
from tessera.plans.common import (ANSWERS_CTE, LOGPROBS_CTE, PROMPTS_CTE, QUERY_MARKERS,
                                  RESPONSES_CTE, VECTORS_CTE, L, T, r6, sql_has_marker,
                                  sql_markers, sql_norm, sql_strip, sql_tokens)
from tessera.session import scratch_path
from tessera.sources import bindings as B
from tessera.streaming.responses_stream import stream_hit_rate
from tessera.streaming.sinks import read_latest, run_updates, stream_session

# A first token is "confident" when its probability exceeds this bound; the
# per-model count of confident prompts plays the role of hits for the
# relative score of log-probability models.
CONFIDENT_LP = float(np.log(0.03))


def _key():
    return ["conv_id", L("turn").alias("turn")]


def _responses(spark, sf):
    return B.responses(T(spark, sf, "conversations"))


def _answers(spark, sf):
    return B.answers(T(spark, sf, "conversations"))


def q_txt_normalize(spark, sf):
    return _answers(spark, sf).select(*_key(), normalize_response("response").alias("normalized"))


def q_txt_marker_flag(spark, sf):
    return flag_responses(_responses(spark, sf), QUERY_MARKERS).select("model_id", *_key(), "hit")


def q_txt_marker_profile(spark, sf):
    p = marker_profile(_responses(spark, sf), QUERY_MARKERS, by=["model_id"])
    return p.select("model_id", "marker", L("hits").alias("hits"))


# A long marker list made by rule: every three of these syllables of the invented prose.
SYLLABLES = ["que", "ción", "mente", "ado", "ar", "er", "os", "as", "es", "en", "la", "ie", "ue", "ra", "ll", "rr", "bo"]


def long_markers():
    return sorted({a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES})


def q_txt_marker_index(spark, sf):
    p = indexed_profile(_responses(spark, sf), long_markers(), ["model_id", *B.PROMPT_KEY], by=["model_id"])
    return p.select("model_id", "marker", L("hits").alias("hits"))


def q_txt_marker_index_flag(spark, sf):
    f = flag_rows(_responses(spark, sf), long_markers(), ["model_id", *B.PROMPT_KEY])
    return f.select("model_id", *_key(), "hit")


def q_txt_head_tokens(spark, sf):
    return _answers(spark, sf).select(*_key(), head_tokens("response", 20).alias("head"))


def q_txt_strip_prompt(spark, sf):
    p = pair(B.prompts(T(spark, sf, "conversations")), _answers(spark, sf), B.PROMPT_KEY)
    full = F.concat(F.col("text"), F.col("response"))
    return p.select(*_key(), strip_prompt(full, F.col("text")).alias("answer"))


def q_txt_chat(spark, sf):
    p = B.prompts(T(spark, sf, "conversations"))
    c = p.select(*B.PROMPT_KEY, as_chat("text").alias("chat"))
    return c.select(*_key(), L(F.size("chat")).alias("n_messages"),
                    F.col("chat")[0]["content"].alias("system"), F.col("chat")[1]["content"].alias("user"))


def q_agg_conversation(spark, sf):
    c = conversations(T(spark, sf, "conversations"))
    return c.select("conv_id", L(F.size("chat")).alias("n_turns"),
                    F.array_join(F.transform("chat", lambda m: m["role"]), ",").alias("roles"),
                    L(F.aggregate("chat", F.lit(0), lambda acc, m: acc + F.length(m["content"]))).alias("n_chars"))


def q_join_prompt_response(spark, sf):
    j = pair(B.prompts(T(spark, sf, "conversations")), _responses(spark, sf), B.PROMPT_KEY)
    return j.select(*_key(), "model_id", "cohort", "purpose", "response")


def q_join_match_report(spark, sf):
    """Prompts without an answer, answers without a prompt, repeated keys."""
    r = match_report(B.prompts(T(spark, sf, "conversations")), _answers(spark, sf), B.PROMPT_KEY)
    return r.select(*[L(c).alias(c) for c in r.columns])


def q_agg_hit_rate(spark, sf):
    h = hit_rate(flag_responses(_responses(spark, sf), QUERY_MARKERS), ["model_id"])
    return h.select("model_id", L("hits").alias("hits"), L("total").alias("total"), r6("rate_pct").alias("rate_pct"))


def q_join_base_candidate(spark, sf):
    c = compare(_responses(spark, sf), "base", QUERY_MARKERS, on=B.PROMPT_KEY)
    return c.select("model_id", *[L(x).alias(x) for x in ("n_prompts", "n_unmatched", "base_hits", "cand_hits", "gained", "lost")],
                    r6("relative_hits").alias("relative_hits"))


def _logprobs(spark, sf):
    return B.logprobs(T(spark, sf, "embeddings"))


def q_agg_kl(spark, sf):
    k = kl_divergence(_logprobs(spark, sf))
    return k.select("model_id", r6("kl").alias("kl"), L("n_prompts").alias("n_prompts"))


def _stored(spark, sf):
    """The base stored by prompt, and the candidates' log-probabilities."""
    lp = _logprobs(spark, sf)
    return store_base(lp), lp.where("model_id <> 'base'")


def q_agg_kl_stored(spark, sf):
    k = kl_against(*_stored(spark, sf))
    return k.select("model_id", r6("kl").alias("kl"), L("n_prompts").alias("n_prompts"))


def q_agg_relative_score(spark, sf):
    s = relative_against(*_stored(spark, sf), hit=lambda c: F.array_max(c) > CONFIDENT_LP)
    return s.select("model_id", r6("kl_score").alias("kl_score"), r6("hit_score").alias("hit_score"))


def q_vec_log_softmax(spark, sf):
    e = T(spark, sf, "embeddings")
    x = e.select("vec_id", F.posexplode(log_softmax("embedding")).alias("pos", "v"))
    return x.select("vec_id", L("pos").alias("pos"), r6("v").alias("value"))


def q_vec_l2_normalize(spark, sf):
    e = T(spark, sf, "embeddings")
    x = e.select("vec_id", F.posexplode(l2_normalize("embedding")).alias("pos", "v"))
    return x.select("vec_id", L("pos").alias("pos"), r6("v").alias("value"))


def q_vec_last(spark, sf):
    v = B.vectors(T(spark, sf, "embeddings"))
    return v.select("vec_id", L("layer").alias("layer"), r6(last_state("vec")).alias("last"))


def _row_sum_model():
    def predict(inputs):
        return np.asarray(inputs, dtype=np.float64).sum(axis=1)
    return predict


def q_vec_concat_batches(spark, sf):
    e = T(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    dim = e.select(F.max(F.size("e"))).first()[0]  # one scalar: the tensor width
    s = batch_score(e, "e", _row_sum_model, DoubleType(), batch_size=7, input_tensor_shapes=[[dim]])
    return s.select("vec_id", r6("score").alias("row_sum"))


def q_agg_centroid(spark, sf):
    c = centroids(B.vectors(T(spark, sf, "embeddings")))
    x = c.select("cohort", "layer", "n", F.posexplode("centroid").alias("pos", "m"))
    return x.select("cohort", L("layer").alias("layer"), L("pos").alias("pos"), r6("m").alias("mean"), L("n").alias("n"))


def q_agg_centroid_contrast(spark, sf):
    c = centroid_contrast(B.vectors(T(spark, sf, "embeddings")), "a", "b")
    x = c.select("layer", "norm", F.posexplode("direction").alias("pos", "d"))
    return x.select(L("layer").alias("layer"), L("pos").alias("pos"), r6("d").alias("direction"), r6("norm").alias("norm"))


def q_str_hit_rate(spark, sf):
    src = scratch_path(spark, "responses_files")
    r = _responses(spark, sf)
    r.write.parquet(src)
    stream = stream_session(spark).readStream.schema(r.schema).parquet(src)
    out, ck = scratch_path(spark, "str_hit_rate_out"), scratch_path(spark, "str_hit_rate_ckpt")
    run_updates(stream_hit_rate(stream, QUERY_MARKERS), out, ck)
    h = read_latest(spark, out, ["model_id"])
    return h.select("model_id", L("hits").alias("hits"), L("total").alias("total"), r6("rate_pct").alias("rate_pct"))


QUERIES = {
    "txt_normalize": q_txt_normalize,
    "txt_marker_flag": q_txt_marker_flag,
    "txt_marker_profile": q_txt_marker_profile,
    "txt_marker_index": q_txt_marker_index,
    "txt_marker_index_flag": q_txt_marker_index_flag,
    "txt_head_tokens": q_txt_head_tokens,
    "txt_strip_prompt": q_txt_strip_prompt,
    "txt_chat": q_txt_chat,
    "agg_conversation": q_agg_conversation,
    "join_prompt_response": q_join_prompt_response,
    "join_match_report": q_join_match_report,
    "agg_hit_rate": q_agg_hit_rate,
    "join_base_candidate": q_join_base_candidate,
    "agg_kl": q_agg_kl,
    "agg_kl_stored": q_agg_kl_stored,
    "agg_relative_score": q_agg_relative_score,
    "vec_log_softmax": q_vec_log_softmax,
    "vec_l2_normalize": q_vec_l2_normalize,
    "vec_last": q_vec_last,
    "vec_concat_batches": q_vec_concat_batches,
    "agg_centroid": q_agg_centroid,
    "agg_centroid_contrast": q_agg_centroid_contrast,
    "str_hit_rate": q_str_hit_rate,
}

_M = QUERY_MARKERS
_LONG = f"""syl AS (SELECT unnest({sql_markers(SYLLABLES)}) AS x),
m AS (SELECT DISTINCT a.x || b.x || c.x AS marker FROM syl a, syl b, syl c)"""
_FLAGS = f"{RESPONSES_CTE}, flags AS (SELECT model_id, conv_id, turn, {sql_has_marker(sql_norm('response'), _M)} AS hit FROM responses)"
_HIT_RATE = f"""WITH {_FLAGS}
    SELECT model_id, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS total,
           round(CASE WHEN count(*) <> 0 THEN CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) * 100 ELSE 0.0 END, 6) AS rate_pct
    FROM flags GROUP BY model_id"""
_KL = f"""{LOGPROBS_CTE},
    kl AS (SELECT c.model_id, avg(list_sum(list_transform(list_zip(b.lp, c.lp),
                    lambda p: CASE WHEN p[1] = '-inf'::DOUBLE THEN 0.0 ELSE exp(p[1]) * (p[1] - p[2]) END))) AS kl,
                  count(*) AS n_prompts
           FROM logprobs c JOIN logprobs b ON b.prompt_id = c.prompt_id AND b.model_id = 'base'
           WHERE c.model_id <> 'base' GROUP BY c.model_id)"""
_CENT = f"""{VECTORS_CTE}, cent AS (SELECT cohort, layer, pos, avg(x) AS m, count(*) AS n FROM vx GROUP BY cohort, layer, pos)"""

ORACLES = {
    "txt_normalize": f"WITH {ANSWERS_CTE} SELECT conv_id, turn, {sql_norm('response')} AS normalized FROM answers",
    "txt_marker_flag": f"WITH {_FLAGS} SELECT model_id, conv_id, turn, hit FROM flags",
    "txt_marker_profile": f"""WITH {RESPONSES_CTE}, m AS (SELECT unnest({sql_markers(_M)}) AS marker)
        SELECT r.model_id, m.marker, CAST(count(*) AS BIGINT) AS hits
        FROM responses r JOIN m ON contains({sql_norm('r.response')}, m.marker) GROUP BY r.model_id, m.marker""",
    "txt_marker_index": f"""WITH {RESPONSES_CTE}, {_LONG}
        SELECT r.model_id, m.marker, CAST(count(*) AS BIGINT) AS hits
        FROM responses r JOIN m ON contains({sql_norm('r.response')}, m.marker) GROUP BY r.model_id, m.marker""",
    "txt_marker_index_flag": f"""WITH {RESPONSES_CTE}, {_LONG}
        SELECT model_id, conv_id, turn, CASE WHEN response IS NOT NULL THEN EXISTS (SELECT 1 FROM m WHERE contains({sql_norm('response')}, m.marker)) END AS hit
        FROM responses""",
    "txt_head_tokens": f"""WITH {ANSWERS_CTE} SELECT conv_id, turn,
        array_to_string(list_slice({sql_tokens('response')}, 1, 20), ' ') AS head FROM answers""",
    "txt_strip_prompt": f"""SELECT u.conv_id, CAST(u.turn AS BIGINT) AS turn,
        left({sql_strip("substr(u.text || a.text, length(u.text) + 1)")}, 500) AS answer
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "txt_chat": """SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(2 AS BIGINT) AS n_messages,
        'You are a helpful assistant.' AS system, text AS "user" FROM conversations WHERE role = 'user'""",
    "agg_conversation": """SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles,
        CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id""",
    "join_prompt_response": f"""WITH {PROMPTS_CTE}, {RESPONSES_CTE} SELECT p.conv_id, p.turn, r.model_id, p.cohort, p.purpose, r.response
        FROM prompts p JOIN responses r ON r.conv_id = p.conv_id AND r.turn = p.turn""",
    "join_match_report": """WITH k AS (
          SELECT conv_id, CASE role WHEN 'user' THEN turn ELSE turn - 1 END AS turn,
                 count(*) FILTER (WHERE role = 'user') AS p, count(*) FILTER (WHERE role = 'assistant') AS a
          FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1, 2)
        SELECT CAST(count(*) FILTER (WHERE p > 0 AND a > 0) AS BIGINT) AS matched,
               CAST(count(*) FILTER (WHERE a = 0) AS BIGINT) AS left_only, CAST(count(*) FILTER (WHERE p = 0) AS BIGINT) AS right_only,
               CAST(count(*) FILTER (WHERE p > 1) AS BIGINT) AS left_repeated,
               CAST(count(*) FILTER (WHERE a > 1) AS BIGINT) AS right_repeated FROM k""",
    "agg_hit_rate": _HIT_RATE,
    "join_base_candidate": f"""WITH {_FLAGS}
        SELECT c.model_id, CAST(count(*) AS BIGINT) AS n_prompts,
               CAST(count(*) FILTER (WHERE b.hit IS NULL) AS BIGINT) AS n_unmatched,
               CAST(count(*) FILTER (WHERE b.hit) AS BIGINT) AS base_hits,
               CAST(count(*) FILTER (WHERE c.hit) AS BIGINT) AS cand_hits,
               CAST(count(*) FILTER (WHERE c.hit AND NOT b.hit) AS BIGINT) AS gained,
               CAST(count(*) FILTER (WHERE NOT c.hit AND b.hit) AS BIGINT) AS lost,
               round(CAST(count(*) FILTER (WHERE c.hit) AS DOUBLE) / nullif(count(*) FILTER (WHERE b.hit), 0), 6) AS relative_hits
        FROM flags c LEFT JOIN flags b ON b.conv_id = c.conv_id AND b.turn = c.turn AND b.model_id = 'base'
        WHERE c.model_id <> 'base' GROUP BY c.model_id""",
    "agg_kl_stored": f"WITH {_KL} SELECT model_id, round(kl, 6) AS kl, CAST(n_prompts AS BIGINT) AS n_prompts FROM kl",
    "agg_kl": f"WITH {_KL} SELECT model_id, round(kl, 6) AS kl, CAST(n_prompts AS BIGINT) AS n_prompts FROM kl",
    "agg_relative_score": f"""WITH {_KL},
        h AS (SELECT model_id, count(*) FILTER (WHERE list_max(lp) > {CONFIDENT_LP!r}) AS hits FROM logprobs GROUP BY model_id),
        bh AS (SELECT max(hits) AS base_hits FROM h WHERE model_id = 'base')
        SELECT h.model_id, round(kl.kl / 1.0, 6) AS kl_score,
               round(CAST(h.hits AS DOUBLE) / nullif(bh.base_hits, 0), 6) AS hit_score
        FROM h LEFT JOIN kl ON kl.model_id = h.model_id, bh WHERE h.model_id <> 'base'""",
    "vec_log_softmax": f"""WITH {LOGPROBS_CTE} SELECT prompt_id AS vec_id, CAST(unnest(range(0, len(lp))) AS BIGINT) AS pos,
        round(unnest(lp), 6) AS value FROM logprobs WHERE model_id <> 'base'""",
    "vec_l2_normalize": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        n AS (SELECT vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS nrm FROM e)
        SELECT vec_id, CAST(unnest(range(0, len(v))) AS BIGINT) AS pos,
               round(unnest(list_transform(v, lambda x: x / nrm)), 6) AS value FROM n""",
    "vec_last": f"WITH {VECTORS_CTE} SELECT vec_id, CAST(layer AS BIGINT) AS layer, round(CAST(vec[-1] AS DOUBLE), 6) AS last FROM vecs",
    "vec_concat_batches": """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS row_sum
        FROM embeddings""",
    "agg_centroid": f"""WITH {_CENT} SELECT cohort, CAST(layer AS BIGINT) AS layer, pos, round(m, 6) AS mean,
        CAST(n AS BIGINT) AS n FROM cent""",
    "agg_centroid_contrast": f"""WITH {_CENT},
        d AS (SELECT a.layer, a.pos, b.m - a.m AS d FROM cent a JOIN cent b ON a.layer = b.layer AND a.pos = b.pos
              WHERE a.cohort = 'a' AND b.cohort = 'b'),
        n AS (SELECT layer, sqrt(sum(d * d)) AS nrm FROM d GROUP BY layer)
        SELECT CAST(d.layer AS BIGINT) AS layer, d.pos, round(d.d / greatest(n.nrm, 1e-12), 6) AS direction,
               round(n.nrm, 6) AS norm FROM d JOIN n ON n.layer = d.layer""",
    "str_hit_rate": _HIT_RATE,
}
