"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


#: Id that ends each document.
END_ID = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_rans_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import cascade
    rows = cascade(table(spark, sf_dir, "documents"), stats=True)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score_texts
    return score_texts(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract
    return extract(table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix
    rows, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "stream_start")


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dart_minhash import classes
    return classes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    lexicon, weights = learn(docs, table(spark, sf_dir, "labels"), allowed=fold != 0)
    rows = score(docs, lexicon, weights)
    return rows.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("url")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, verify
    doc, n = F.col("doc_id"), F.col("n_chars")
    hit = F.crc32(doc.cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(hit, n.cast("decimal(20,0)") + 1).otherwise(n.cast("decimal(20,0)"))
    rows = verify(manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": n_chars}))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants
    return variants(table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID, with_ids=False)


QUERIES = {
    "op1_rans_token_output": op1_rans_token_output,
    "op2_secrets": op2_secrets,
    "op3_quality_cascade": op3_quality_cascade,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_html_text": op5_html_text,
    "op6_mix_sources": op6_mix_sources,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_best_fit_packing": op13_best_fit_packing,
}
#: The remainders of crc32 byte by byte, and a byte string's crc32 by them (DuckDB has no crc32).
_CRC_TABLE = """crc AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t
  FROM range(256) r(b))"""


def _crc32(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, t[xor(c % 256, b)::INT + 1]), 4294967295::BIGINT), 4294967295)"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


_NIBBLES = "".join(f"{i:04b}" for i in range(16))
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLES: dict[str, str] = {
    "op3_quality_cascade": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
keyed AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS k FROM win),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice WHERE n > 1) GROUP BY r),
f AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
        coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '!')) AS n_exclaims,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i-1])) AS n_stutter,
        len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x) AND len(regexp_extract_all(x, '\p{L}')) > 1)) AS n_shouted
      FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_exclaims > 30 * n_words
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_stutter > 20 * n_words
       OR 100 * n_shouted > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM f""",
    "op9_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
             max(page_id) OVER (PARTITION BY sha1(html)) AS top FROM p),
b AS (SELECT *, array_to_string([substr('{_NIBBLES}', 4 * instr('123456789abcdef', substr(hex, i, 1)) + 1, 4) FOR i IN range(1, 41)], '') AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('{_BASE32}', 1 + 16 * substr(bits, 5*i+1, 1)::INT + 8 * substr(bits, 5*i+2, 1)::INT
    + 4 * substr(bits, 5*i+3, 1)::INT + 2 * substr(bits, 5*i+4, 1)::INT + substr(bits, 5*i+5, 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {_leaf('n_chars')} AS leaf,
             CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('n_chars::HUGEINT + 1')} ELSE {_leaf('n_chars')} END AS other FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx FROM d),
low AS (SELECT 0 AS level, g, idx, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
        UNION ALL
        SELECT level + 1, g, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY level, g, idx // 2),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE n = 1),
high AS (SELECT 0 AS level, pos AS idx, subroot AS h, count(*) OVER () AS n FROM subs
         UNION ALL
         SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, idx // 2),
steps AS (SELECT r, leaves.g, l.level, coalesce(o.h, '') AS h, leaves.idx >> l.level AS spot
          FROM leaves JOIN (SELECT DISTINCT g, level FROM low WHERE n > 1) l ON l.g = leaves.g
          LEFT JOIN low o ON o.g = leaves.g AND o.level = l.level AND o.idx = xor(leaves.idx >> l.level, 1)),
up AS (SELECT pos, l.level, coalesce(o.h, '') AS h, pos >> l.level AS spot
       FROM subs CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) l LEFT JOIN high o ON o.level = l.level AND o.idx = xor(pos >> l.level, 1)),
path AS (SELECT r, level, h, spot FROM steps
         UNION ALL SELECT r, 1000 + level, up.h, up.spot FROM leaves JOIN subs ON subs.g = leaves.g JOIN up ON up.pos = subs.pos),
whole AS (SELECT r, list({{'h': h, 'odd': spot % 2 = 1}} ORDER BY level) AS p FROM path GROUP BY r),
flat AS (SELECT doc_id, leaf, other, subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(p, []) AS p
         FROM leaves JOIN subs ON subs.g = leaves.g LEFT JOIN whole ON whole.r = leaves.r),
folded AS (SELECT *, list_reduce(list_prepend({{'h': other, 'odd': false}}, p),
             lambda a, s: {{'h': CASE WHEN s.odd THEN sha256(s.h || a.h) ELSE sha256(a.h || s.h) END, 'odd': false}}).h AS folded_root FROM flat)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s.h), '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM folded""",
    "op12_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS k, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, n, {_crc32('k')} AS h FROM each, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT word, rest FROM less JOIN words USING (word) WHERE rest IN (SELECT word FROM words)
         UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
top AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS best, max(n) AS m FROM near JOIN words ON words.word = near.b GROUP BY a),
v AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN best END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
      FROM words LEFT JOIN top ON top.word = words.word),
way AS (SELECT word, form AS spot FROM v WHERE form IS NOT NULL
        UNION ALL SELECT way.word, v.form FROM way JOIN v ON v.word = way.spot WHERE v.form IS NOT NULL),
ends AS (SELECT way.word, spot FROM way JOIN v ON v.word = way.spot WHERE v.form IS NULL)
SELECT v.word, form, coalesce(ends.spot, v.word) AS root, n, n_near, form_n FROM v LEFT JOIN ends ON ends.word = v.word""",
}
