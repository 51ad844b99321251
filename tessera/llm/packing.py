"""Operator 13: documents packed into sequences by vector best-fit.

Every sequence has three capacities: tokens, documents and attention cost (the
sum of the squares of its piece lengths).  Pieces are placed longest first; a
piece goes into the open sequence that all three residual capacities allow
and whose residuals are the best match: the least weighted norm of what is left
(``rule="norm"``) or the largest weighted dot product of residuals and demand
(``rule="dot"``).  If no sequence takes it, a new one is opened.

Pieces of equal length have the same demand, so which of them goes where does
not matter.  The placement therefore needs only how many pieces there are of
each length: at most ``tokens`` numbers, whatever the size of the corpus.  Open
sequences with equal residuals form a class; a step of the best-fit places as
many pieces as the one-by-one rule would put into that class before it looks
elsewhere.  The result, ranges of (length, rank) onto ranges of sequences, has
at most a few entries per length and class.  Spark tokenises and cuts the
documents, numbers the pieces of each length without gathering a length in one
task, and looks up each piece's range.

Defined cases: null and empty texts hold the end id alone; repeated rows are
separate documents; null ids stay null; other columns are not read, so they
cannot clash; an empty table gives no rows.  A single piece must fit an empty
sequence under every capacity, otherwise ``ValueError``.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import with_group_index
from ..session import scratch_path
from .common import as_text

TOKENS = 1024
#: Neither binds where only the tokens are limited: a document has at least its
#: end id, and squares of lengths add up to less than the square of their sum.
DOCUMENTS = 1024
ATTENTION = 1024 * 1024
WEIGHTS = (1.0, 0.01, 0.01)
TEXTS_PER_STEP = 256


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, tokens: int = TOKENS,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, piece, start, length, ids_crc32, ids): one row per piece.
    Only a document of over ``tokens`` ids is cut; its first piece is the
    shorter one.  ``ids`` are little-endian, of 2 bytes for a vocabulary of up
    to 65,536 entries, else of 4; ``rid`` is unique.  Written once, because the
    numbers of ``rid`` must not change between passes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches):
        from .byte_tokenize import ChunkCacheTokenizer
        tok = ChunkCacheTokenizer.of_worker(tokenizer_path)
        width, end = int(tok.dtype[2:]), np.asarray([end_id], tok.dtype).tobytes()
        for b in batches:
            for i in range(0, b.num_rows, TEXTS_PER_STEP):
                part = b.slice(i, TEXTS_PER_STEP)
                out: list = [[] for _ in names]
                for doc, ids in zip(part.column(0).to_pylist(), tok.encode(as_text(part.column(1)))):
                    ids += end
                    n = len(ids) // width
                    wide = np.frombuffer(ids, tok.dtype).astype("<u4").tobytes() if width < 4 else ids
                    cuts = [0, *range(n % tokens or tokens, n + 1, tokens)] if n > tokens else [0, n]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        for column, v in zip(out, (doc, k, a, z - a, zlib.crc32(wide[4 * a:4 * z]), ids[width * a:width * z])):
                            column.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
    pieces = rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    path = scratch_path(docs.sparkSession, "pieces")
    pieces.withColumn("rid", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _take(ranges: list, n: int) -> list:
    """Cut ``n`` sequences from the end of a list of (first, count) ranges."""
    out = []
    while n:
        first, count = ranges.pop()
        if count > n:
            ranges.append((first, count - n))
            first, count = first + count - n, n
        out.append((first, count))
        n -= count
    return out


def best_fit(counts: dict[int, int], capacity=(TOKENS, DOCUMENTS, ATTENTION), weights=WEIGHTS, rule: str = "norm"):
    """Place ``counts[length]`` pieces of each length, longest first.

    Returns (ranges, n_sequences); a range (length, rank, n, sequence, offset)
    puts the pieces of that length with ranks from ``rank`` to ``rank + n - 1``
    at ``offset`` of the sequences from ``sequence`` on, one each."""
    scale = [w / c for w, c in zip(weights, capacity)]

    def key(left, need):
        """Order of the sequences a piece may join: the least comes first."""
        if rule == "norm":
            fit = sum((s * (x - y)) ** 2 for s, x, y in zip(scale, left, need))
        else:
            fit = -sum(s * s * x * y for s, x, y in zip(scale, left, need))
        return fit, left

    def after(left, need):
        return tuple(x - y for x, y in zip(left, need))

    def fits(left, need):
        return all(x >= y for x, y in zip(left, need))

    classes: dict[tuple, list] = {}          # residuals -> ranges of open sequences
    ranges, opened = [], 0
    for length in sorted(counts, reverse=True):
        need, todo, rank = (length, 1, length * length), counts[length], 0
        if not fits(capacity, need):
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        heap = [key(left, need) for left in classes if fits(left, need)]
        heapq.heapify(heap)
        while todo:
            fresh = not heap
            fit, left = heapq.heappop(heap) if heap else (None, tuple(capacity))
            each, last = 1, after(left, need)
            # one by one, a sequence just joined takes the next piece too where it is still the best
            while fits(last, need) and (fresh or key(last, need) < (fit, left)):
                each, last = each + 1, after(last, need)
            free = todo if fresh else sum(c for _, c in classes[left])
            n = min(free, todo // each)
            if not n:                        # the last pieces of this length: one sequence takes them all
                n, each = 1, todo
                last = tuple(x - each * y for x, y in zip(left, need))
            if fresh:
                taken, opened = [(opened, n)], opened + n
            else:
                taken = _take(classes[left], n)
                if classes[left]:
                    heapq.heappush(heap, (fit, left))
                else:
                    del classes[left]
            for layer in range(each):
                for first, count in taken:
                    ranges.append((length, rank, count, first, capacity[0] - left[0] + layer * length))
                    rank += count
            todo -= n * each
            if fits(last, need) and last not in classes:
                heapq.heappush(heap, key(last, need))
            if last[0]:
                classes.setdefault(last, []).extend(taken)
    return ranges, opened


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity=(TOKENS, DOCUMENTS, ATTENTION), weights=WEIGHTS,
         rules=("norm", "dot"), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset and, unless ``with_ids`` is false, ids (one join on the unique rid).
    Of the rules given, the one with the fewest sequences is used (both work on
    the counts alone)."""
    pieces = tokenised_pieces(docs, tokenizer_path, end_id, capacity[0], id_col, text_col)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = min((best_fit(counts, capacity, weights, rule) for rule in rules), key=lambda x: x[1])[0]
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    start = (table[:, 0] << 44) + table[:, 1]                # a rank is under 2 ** 44
    narrow = pieces.select("length", "rid", "doc_id", "piece", "start", "ids_crc32")
    ranked = with_group_index(narrow, ["length"], ["rid"], "rank")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rid", "sequence_id", "offset"]

    def place(batches):
        for b in batches:
            rank = b.column(1).to_numpy()
            at = np.searchsorted(start, (b.column(0).to_numpy() << 44) + rank, "right") - 1
            _, first, _, sequence, offset = table[at].T
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (2, 3, 4, 0, 5, 6)), pa.array(sequence + rank - first),
                                              pa.array(offset)], names)
    placed = ranked.select("length", "rank", "doc_id", "piece", "start", "ids_crc32", "rid").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, rid long, sequence_id long, offset long")
    return placed.join(pieces.select("rid", "ids"), "rid").drop("rid") if with_ids else placed.drop("rid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, documents, ids): the packed sequences; at most
    ``tokens`` pieces meet in one."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_p"))
    return rows.select("sequence_id", "n_tokens", F.transform("_p", lambda p: p.dropFields("ids")).alias("documents"),
                       F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
