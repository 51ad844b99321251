"""Operator 10: benchmark decontamination by pigeonhole edit matching.

Texts are compared in a normal form: lower case, ASCII punctuation as space,
runs of white space as one space, in UTF-8 bytes.  A test item of n bytes may
differ by e = n // ``BYTES_PER_ERROR`` edits.  It is cut into e + 1 pieces; of
any place within e edits at least one piece occurs unchanged, so an automaton
over all pieces finds every candidate place, and Myers' bit-parallel distance
decides each.

The items are sent to the tasks in blocks of about ``BLOCK_BYTES``; a larger
item table means more passes over the documents, not a larger broadcast.

The rule is one for all lengths.  An item that is too short for any edit (under
``BYTES_PER_ERROR`` bytes) must stand as whole words, as it may be part of many.

Defined cases: null or empty texts match nothing, nor do items without a
letter, digit or byte beyond ASCII (their normal form is empty); repeated
rows are reported once each; a null id is reported as null.  Only the columns
named are read (``drop_leaks`` passes the others through untouched).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text

BYTES_PER_ERROR = 12
BLOCK_BYTES = 8 << 20
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal_form(text: str) -> str:
    """One character per byte, so that distances count bytes."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()).decode("latin-1")


def budget(n: int) -> int:
    return n // BYTES_PER_ERROR


def whole_words(form: str, start: int, end: int) -> bool:
    return (start == 0 or form[start - 1] == " ") and (end == len(form) or form[end] == " ")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item cut into errors + 1 pieces of nearly equal length: (offset, piece)."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern_masks(item: str) -> dict:
    masks: dict = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict, m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text`` and the
    end of the first such substring (bit-parallel, one step per character)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


class Matcher:
    """All items of one block, ready to scan texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick
        self.items = []
        where: dict[str, list] = {}
        for item_id, text in items:
            form = normal_form(text or "")
            if not form:
                continue
            e = budget(len(form))
            self.items.append((item_id, form, e, pattern_masks(form)))
            for offset, piece in pieces(form, e):
                where.setdefault(piece, []).append((len(self.items) - 1, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def hits(self, text: str, first_only: bool = False) -> list[tuple]:
        """(item_id, distance, start, end) of the best place of each item found,
        places in the normal form."""
        if not self.items or not text:
            return []
        form = normal_form(text)
        places: dict[int, list[int]] = {}
        for end, (n, at) in self.automaton.iter(form):
            start = end + 1 - n
            for item, offset in at:
                places.setdefault(item, []).append(start - offset)
        found = []
        for item, starts in places.items():
            item_id, pattern, e, masks = self.items[item]
            m, best = len(pattern), None
            exact = next((s for s in starts if s >= 0 and form.startswith(pattern, s)
                          and (e or whole_words(form, s, s + m))), None)
            if exact is not None:
                best = (0, exact, exact + m)
            elif e:
                lo = hi = None
                windows = []
                for s in sorted(starts):          # places closer than the budget share a window
                    if hi is not None and s - e <= hi:
                        hi = s + m + e
                    else:
                        if hi is not None:
                            windows.append((lo, hi))
                        lo, hi = s - e, s + m + e
                windows.append((lo, hi))
                for lo, hi in windows:
                    lo = max(0, lo)
                    part = form[lo:hi]
                    if len(part) < m - e:
                        continue
                    d, end = myers(masks, m, part)
                    if d <= e and (best is None or d < best[0]):
                        best = (d, max(0, lo + end - m), lo + end)
            if best is not None:
                found.append((item_id, *best))
                if first_only:
                    break
        return found


def item_blocks(items: DataFrame, item_id_col: str, item_text_col: str):
    """Yield the items in blocks of about BLOCK_BYTES, so what is sent stays bounded."""
    rows = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-int(size) // BLOCK_BYTES)
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield sorted(((r["i"], r["t"]) for r in block), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, item) within the item's budget: doc_id, item_id,
    distance, start and end in the normal form.  No shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, start long, end long"
    out = None
    for block in item_blocks(items, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches, sent=sent):
            matcher = Matcher(sent.value)
            for b in batches:
                found = [(d, *h) for d, t in zip(b.column(0).to_pylist(), as_text(b.column(1))) for h in matcher.hits(t)]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                                                     ["doc_id", "item_id", "distance", "start", "end"])
        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    at = docs.columns.index(text_col)
    for block in item_blocks(items, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, sent=sent):
            matcher = Matcher(sent.value)
            for b in batches:
                yield b.filter(pa.array([not matcher.hits(t, True) for t in as_text(b.column(at))], pa.bool_()))
        docs = docs.mapInArrow(clean, docs.schema)
    return docs
