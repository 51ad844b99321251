"""Operator 2: secret scan with multipart credential linking.

Strong parts (assignments, access ids, long hex) are always reported.  Weak
parts - short assigned values, random-looking tokens, user names, endpoints -
are reported only where complementary parts lie in the same scope (a part of a
text between blank lines), however far apart, or, with ``reach``, within so many
code points:

* a short value or token needs an identifier (access id or user) or an endpoint,
* a user needs a secret, an endpoint needs both an identifier and a secret.

Parts are found per text; the linking is an interval join in Spark: a scope is
the interval, summed up by role, and a weak part looks up the roles it needs.
With ``reach``, positions are cut into bins of that size, each (scope, bin,
role) is summed up by its first start and last end, and a weak part looks at
its own bins and the two next to them.  That is exact, since inside one bin
everything is within reach, and it makes a handful of rows per part instead of a
row per pair.  Texts are never shuffled, parts are few.

Defined cases: null and empty texts have no parts; repeated rows are scanned
and linked on their own; a null id is kept; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import as_text

KINDS = ("assign", "access", "hex", "short", "token", "user", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "short": "secret", "token": "secret",
        "user": "identifier", "endpoint": "endpoint"}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_USER = re.compile(r"""\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_ENDPOINT = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\s"'<>]+|\b(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}:\d{2,5}\b""")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def _long_words(text: str, least: int):
    """(start, word) of the runs without white space of at least ``least`` characters."""
    at = 0
    for w in text.split():
        if len(w) >= least:
            at = text.index(w, at)
            yield at, w
            at += len(w)


def strong_parts(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds: leftmost matches that do not
    overlap, then those that are too short are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for at, w in _long_words(text, 32):
        out += [(at + m.start(), "hex", at + m.end()) for m in _HEX.finditer(w) if m.end() - m.start() >= 32]
    return out


class Spans:
    """Spans sorted by start, with the furthest end so far: an overlap is one bisection."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def meet(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)           # spans that begin before ``end``
        return at > 0 and self.ends[at - 1] > start


def weak_parts(text: str, strong: list) -> list[tuple[int, str, int]]:
    """Candidates that overlap no strong part."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), "short", m.end()) for m in _ASSIGN.finditer(text) if 0 < m.end(2) - m.start(2) < 8]
        out += [(m.start(), "user", m.end()) for m in _USER.finditer(text)]
        out += [(m.start(), "endpoint", m.end()) for m in _ENDPOINT.finditer(text)]
    for at, w in _long_words(text, 20):
        if w.isalpha():
            continue
        for m in _TOKEN.finditer(w):
            t = m[0]
            if len(t) >= 20 and any(map(str.isdigit, t)) and any(map(str.isupper, t)) and any(map(str.islower, t)) and "//" not in t:
                out.append((at + m.start(), "token", at + m.end()))
    strong_spans = Spans((a, b) for a, _, b in strong)
    all_spans = Spans([(a, b) for a, _, b in strong] + [(a, b) for a, k, b in out if k != "token"])
    return [p for p in out if not (all_spans if p[1] == "token" else strong_spans).meet(p[0], p[2])]


def _join(parts) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(parts, key=lambda p: (p[0], KINDS.index(p[1]))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its strong parts and, as arrays, all parts with their scope."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    part = "struct<kind:string,start:long,end:long,scope:long>"
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())])

    def run(batches):
        for b in batches:
            counts, base, shas, parts = [], [], [], []
            for text in as_text(b.column(1)):
                strong = strong_parts(text)
                weak = weak_parts(text, strong)
                every = strong + weak
                # the scope of a part: how many blank lines end before it
                breaks = [m.start() for m in _BLANK.finditer(text)] if weak else []
                names = [k for _, k, _ in strong]
                counts.append([names.count(k) for k in KINDS[:3]])
                base.append(_join(strong))
                shas.append(hashlib.sha256(base[-1].encode()).hexdigest())
                parts.append([{"kind": k, "start": a, "end": e, "scope": bisect_left(breaks, a)} for a, k, e in every] if weak else [])
            cols = [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)),
                    pa.array(base, pa.string()), pa.array(shas, pa.string()), pa.array(parts, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base", "base_sha256", "parts"])
    return rows.mapInArrow(run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base string, base_sha256 string, parts array<{part}>")


def link(parts: DataFrame, reach: int | None = None) -> DataFrame:
    """The weak parts that complementary parts support.  ``parts``: (row, scope,
    kind, start, end); returns the same columns."""
    role = F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv))
    parts = parts.withColumn("role", role[F.col("kind")])
    weak = parts.where(~F.col("kind").isin(*KINDS[:3]))
    wanted = F.when(F.col("role") == "secret", F.array(F.lit("identifier"), F.lit("endpoint"))).when(
        F.col("role") == "identifier", F.array(F.lit("secret"))).otherwise(F.array(F.lit("identifier"), F.lit("secret")))
    looks = weak.withColumn("other", F.explode(wanted))
    if reach is None:
        there = parts.select("row", "scope", F.col("role").alias("other")).distinct()
        near = looks.join(there, ["row", "scope", "other"])
    else:
        first, last = F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach)
        bins = (parts.withColumn("bin", F.explode(F.sequence(first, last)))
                .groupBy("row", "scope", F.col("role").alias("other"), "bin").agg(F.min("start").alias("lo"), F.max("end").alias("hi")))
        near = looks.withColumn("bin", F.explode(F.sequence(first - 1, last + 1))).join(bins, ["row", "scope", "other", "bin"])
        near = near.where((F.col("lo") - F.col("end") <= reach) & (F.col("start") - F.col("hi") <= reach))
    key = ["row", "scope", "kind", "start", "end", "role"]
    found = near.groupBy(*key).agg(F.count_distinct("other").alias("n"))
    return found.where((F.col("role") != "endpoint") | (F.col("n") == 2)).select(*key[:-1])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """doc_id, counts and digest of the strong parts, and all reported spans."""
    spark = docs.sparkSession
    path = scratch_path(spark, "secret-parts")
    scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    linked = link(rows.select("row", F.inline("parts")).select("row", "scope", "kind", "start", "end"), reach)
    spans = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    added = linked.groupBy("row").agg(F.collect_list(F.struct("start", order[F.col("kind")].alias("at"), spans.alias("span"))).alias("added"))
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(
        F.split(s, ":")[1].cast("long").alias("start"), order[F.split(s, ":")[0]].alias("at"), s.alias("span")))
    out = rows.join(added, "row", "left")
    every = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:bigint,at:int,span:string>>"))))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                      F.concat_ws(",", F.transform(every, lambda s: s["span"])).alias("spans"))
