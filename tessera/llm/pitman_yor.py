"""Operator 4: hierarchical Pitman-Yor language model of words and their spelling.

Restaurants: one per preceding word (tokens are words and one end per text; a
text starts after an end), all with one parent, the restaurant of words
without context; the base distribution of that one spells a word byte by
byte, with one restaurant per context of up to ``ORDER`` preceding bytes of
the word, each sharing as parent the context shortened by its oldest byte,
down to the empty context and a uniform distribution over bytes.  Customers are seated by the Chinese
restaurant process with a discount: a customer opens a table with weight
(strength + discount * tables) * parent probability, and each table sends one
customer to the parent.  ``SWEEPS`` Gibbs sweeps resample the tables of every
dish given all others; the predictive probabilities of the last ``SAMPLES``
are averaged.  In a sweep, restaurants of one level are resampled side by side
from the same state, which is what lets them run in parallel.  The word
contexts start with one table per pair; then ``ROUNDS`` times the parent is
seated by the tables of the contexts and the contexts are swept under the parent
that this gives, and at last the parent is seated by the tables they end with.

Unknown words are one outcome of ``score``, as they are of the smoothed
unigram ``base_score`` that it stands beside (V + 1 outcomes each): the chance
that a token opens a table and the spelling gives no known word.  In
``open_score`` an unknown word is spelled out instead.

Scale: a task turns its texts into chunks (about ``CHUNK_BYTES``) and sends
each distinct word of a chunk once, packed by hash bucket, so hot words and
copied texts cost one entry a chunk.  Word servers (one group per bucket) add
up counts; byte servers (one group per pair of last context bytes) hold whole
subtrees of contexts; answers go back the same way.  Pairs of words are counted
per chunk, all of them, and sent once to the bucket of the preceding word as
numbers (frequent words have small ones); the pairs of one preceding word lie
in one group, at most one entry per word that follows it.  The texts of a chunk
stay in a file of the shared folder, so they are not shuffled.  Only the 256 x 256 table
of the shortest contexts and a few sums reach the driver; nothing that grows
with the input is broadcast.

Words are runs of bytes other than space and \\t to \\r, A-Z in lower case.
Defined cases: null and empty texts are one end token; a null id is a training
row; repeated rows count and are scored each; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path
from .common import as_bytes, fresh_name, mix64, open_bytes, pack, unpack, write_bytes

ORDER = 5                        # bytes of context
CHUNK_BYTES = 32 << 20           # text in a chunk
CHUNK_WORDS = 400_000            # or distinct words in a chunk
WORD_STRENGTH = 10.0             # the discounts of words and pairs come from their counts
PAIR_STRENGTH = 1.0
BYTE_DISCOUNT, BYTE_STRENGTH = 0.6, 1.0
SWEEPS, SAMPLES = 6, 3
ROUNDS = 1                       # times that words and contexts are seated in turn
BUCKET_BYTES = 32 << 20          # text for one bucket of words
SEED = 20
_PARTS = "kind string, bucket int, chunk long, a binary, b binary, c binary, n long, m long"


# ---- the Chinese restaurant process -----------------------------------------

def seat(customers: np.ndarray, open_weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of each dish after seating its customers one after the other; a
    customer opens a table with weight ``open_weight`` against n - discount *
    tables.  The customers between two tables are passed over by a geometric
    step at the present chance, which only falls until the next table; the
    customer reached opens one with the share of that chance that is left."""
    c = np.asarray(customers, np.int64)
    weight = np.asarray(open_weight, float)
    t, n = (c > 0).astype(np.int64), np.ones(len(c), np.int64)
    at = np.flatnonzero((c > 1) & (weight > 0))
    while len(at):
        w = weight[at]
        chance = w / (w + n[at] - discount * t[at])
        reached = n[at] + np.minimum(rng.geometric(np.maximum(chance, 1e-15)), c[at]) - 1
        here = reached < c[at]
        at, reached, chance, w = at[here], reached[here], chance[here], w[here]
        t[at] += rng.random(len(at)) * chance < w / (w + reached - discount * t[at])
        n[at] = reached + 1
        at = at[n[at] < c[at]]
    return t


def predictive(c, t, in_context, n_contexts, parent, discount, strength):
    """Probability of each dish: (c - d t + (strength + d T) parent) / (strength + C)."""
    total = np.bincount(in_context, weights=c, minlength=n_contexts)[in_context]
    tables = np.bincount(in_context, weights=t, minlength=n_contexts)[in_context]
    return (c - discount * t + (strength + discount * tables) * parent) / (strength + total), strength + discount * tables


# ---- spelling ---------------------------------------------------------------

def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (level << 48 | context << 8 | byte) of all steps of the words, and
    where each word's steps begin.  A word starts after, and ends with, a space."""
    flat = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    step = np.arange(len(flat)) - np.repeat(begin, size)
    level = np.minimum(step, ORDER)
    key = flat.copy()
    for j in range(1, ORDER + 1):
        ok = level >= j
        at = np.flatnonzero(ok)
        key[at] |= flat[at - j] << np.uint64(8 * j)
    key |= level.astype(np.uint64) << np.uint64(48)
    inside = step > 0
    return key[inside], begin - np.arange(len(words))


def _level(key):
    return (key >> np.uint64(48)).astype(np.int64)


def shorten(key: np.ndarray, level: int) -> np.ndarray:
    """The keys of ``level`` one level up: the oldest byte of the context goes."""
    mask = np.uint64((1 << (8 * level)) - 1)
    return (key & mask) | np.uint64((level - 1) << 48)


class Subtree:
    """Restaurants of levels 2 to ORDER whose contexts end in some byte pairs."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray):
        level = _level(keys)
        self.keys, self.direct, self.up, self.context, self.n_contexts = {}, {}, {}, {}, {}
        deeper = np.zeros(0, np.uint64)
        for lv in range(ORDER, 1, -1):
            own = level == lv
            all_ = np.unique(np.concatenate((keys[own], deeper)))
            self.keys[lv] = all_
            self.direct[lv] = np.bincount(np.searchsorted(all_, keys[own]), weights=customers[own], minlength=len(all_)).astype(float)
            _, self.context[lv] = np.unique(all_ >> np.uint64(8), return_inverse=True)
            self.n_contexts[lv] = int(self.context[lv].max()) + 1 if len(all_) else 0
            deeper = shorten(all_, lv)
        for lv in range(ORDER, 2, -1):
            self.up[lv] = np.searchsorted(self.keys[lv - 1], shorten(self.keys[lv], lv))

    def run(self, first: np.ndarray, rng) -> dict:
        """Averaged predictive probabilities per level; ``first``: the 256 x 256
        table of probabilities by last byte and byte."""
        key2 = self.keys[2]
        base = first[((key2 >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (key2 & np.uint64(255)).astype(np.int64)]
        t = {lv: None for lv in self.keys}
        mean = {lv: np.zeros(len(k)) for lv, k in self.keys.items()}

        def customers():
            c, below = {}, None
            for lv in range(ORDER, 1, -1):
                c[lv] = self.direct[lv].copy()
                if below is not None:
                    c[lv] += np.bincount(self.up[lv + 1], weights=below, minlength=len(c[lv]))
                if t[lv] is None:
                    t[lv] = (c[lv] > 0).astype(np.int64)
                below = t[lv]
            return c
        for sweep in range(SWEEPS + 1):
            c = customers()
            p, weight = {}, {}
            for lv in range(2, ORDER + 1):
                parent = base if lv == 2 else p[lv - 1][self.up[lv]]
                p[lv], mass = predictive(c[lv], t[lv], self.context[lv], self.n_contexts[lv], parent, BYTE_DISCOUNT, BYTE_STRENGTH)
                weight[lv] = mass * parent
            if sweep > SWEEPS - SAMPLES:
                for lv in mean:
                    mean[lv] += p[lv] / SAMPLES
            if sweep < SWEEPS:
                below = None
                for lv in range(ORDER, 1, -1):      # tables below are customers here
                    c_now = self.direct[lv].copy()
                    if below is not None:
                        c_now += np.bincount(self.up[lv + 1], weights=below, minlength=len(c_now))
                    t[lv] = below = seat(c_now, weight[lv], BYTE_DISCOUNT, rng)
        return mean


def shortest_contexts(pairs: np.ndarray, rng) -> np.ndarray:
    """Probability of a byte after the last byte: the restaurants of levels 1
    and 0 over a uniform base.  ``pairs``: 256 x 256 customers of level 1."""
    c = pairs.reshape(-1).astype(float)
    context, dish = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
    t, out = (c > 0).astype(np.int64), np.zeros(65536)
    for sweep in range(SWEEPS + 1):
        c0 = np.bincount(dish, weights=t, minlength=256)
        t0 = (c0 > 0).astype(np.int64)
        p0, _ = predictive(c0, t0, np.zeros(256, np.int64), 1, np.full(256, 1 / 256), BYTE_DISCOUNT, BYTE_STRENGTH)
        p1, mass = predictive(c, t, context, 256, p0[dish], BYTE_DISCOUNT, BYTE_STRENGTH)
        if sweep > SWEEPS - SAMPLES:
            out += p1 / SAMPLES
        t = seat(c, mass * p0[dish], BYTE_DISCOUNT, rng)
    return out.reshape(256, 256)


# ---- pairs of words ---------------------------------------------------------

_PLACE = np.int64(40)            # a pair is context << 40 | word


def _planes(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return pack(np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T)


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def pack_pairs(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending pairs as (contexts and their sizes, steps of the words)."""
    context, word = keys >> _PLACE, keys & ((1 << _PLACE) - 1)
    at = np.flatnonzero(np.diff(context, prepend=-1))
    step = np.diff(word, prepend=0)
    step[at] = word[at]
    return _planes(np.concatenate((np.diff(context[at], prepend=0), np.diff(np.append(at, len(keys)))))), _planes(step)


def unpack_pairs(a: bytes, b: bytes) -> np.ndarray:
    context, size = _from_planes(a).reshape(2, -1)
    step = _from_planes(b)
    at = np.cumsum(size) - size
    word = np.cumsum(step)
    word -= np.repeat(word[at] - step[at], size)
    return np.repeat(np.cumsum(context), size) << _PLACE | word


def chunk_tokens(d: dict):
    """Of a row 'd': ids, known and held out per text, the tokens (each text
    ended by the end token), the text of each, and the token before each."""
    with open_bytes(d["b"].decode()) as f:
        flat = unpack(f.read(), np.int32)
    doc, n, known, held = unpack(d["a"], np.int64).reshape(4, -1)
    tokens = np.insert(flat, np.cumsum(n), d["n"])
    return doc, known, held, tokens, np.repeat(np.arange(len(doc)), n + 1), np.concatenate(([d["n"]], tokens[:-1]))


def chunk_pairs(tokens, before, q: list[dict], buckets: int):
    """The distinct pairs of a chunk in the order (bucket, context, word), the
    bucket of each and the pair of each token.  ``q``: rows by bucket."""
    place = [unpack(r["a"], np.int32).astype(np.int64) for r in q]
    bucket = np.repeat(np.array([r["bucket"] for r in q], np.int64), [len(x) for x in place])
    place = np.concatenate(place)
    word = place * buckets + bucket
    by_context, by_word = np.lexsort((place, bucket)), np.argsort(word)
    c, w = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    c[by_context] = w[by_word] = np.arange(len(place))
    keys, inverse = np.unique(c[before] * len(place) + w[tokens], return_inverse=True)
    context = by_context[keys // len(place)]
    return place[context] << _PLACE | word[by_word[keys % len(place)]], bucket[context], inverse


def by_bucket(words: np.ndarray, buckets: int):
    """Distinct ascending words -> (bucket, positions) of each bucket met."""
    bucket = words % buckets
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


# ---- the Spark stages -------------------------------------------------------

def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _row(kind, bucket, chunk, a=None, b=None, c=None, n=0, m=0):
    return kind, bucket, chunk, a, b, c, n, m


def _batch(rows):
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                      ["kind", "bucket", "chunk", "a", "b", "c", "n", "m"])


def _zip_words(words):
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _words(blob):
    import zstandard
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


def _to_chunks(buckets: int, is_held, folder: str):
    """Texts of a task -> rows 'd' (the texts of a chunk; b: the file of their
    word numbers, n: the end token's) and 'w' (its distinct words in one bucket with their training counts).  The
    end token is the empty word."""
    def run(batches):
        import xxhash
        from pyspark import TaskContext
        chunk = TaskContext.get().partitionId() << 32
        place, docs, ids, size = {b"": 0}, [], [], 0

        def flush():
            words = list(place)
            bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            number = np.empty(len(words), np.int32)
            number[order] = np.arange(len(words), dtype=np.int32)
            n = np.array([len(x) for x in ids], np.int64)
            flat = number[np.concatenate(ids)] if n.sum() else np.zeros(0, np.int32)
            held = np.array([is_held(d) for d in docs], bool)
            train = np.bincount(flat[np.repeat(~held, n)], minlength=len(words))
            train[number[0]] += int((~held).sum())
            known = np.array([d is not None for d in docs], bool)
            doc = np.array([d or 0 for d in docs], np.int64)
            yield _row("d", -1, chunk, pack(np.stack([doc, n, known, held]).astype("<i8")),
                       write_bytes(folder, fresh_name("chunk"), [pack(flat)])[0].encode(), None, int(number[0]), len(docs))
            sorted_bucket = bucket[order]
            cuts = np.flatnonzero(np.diff(sorted_bucket)) + 1
            for part in np.split(order, cuts):
                yield _row("w", int(bucket[part[0]]), chunk, _zip_words([words[i] for i in part]), pack(train[number[part]]))
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                words = raw.lower().split()
                docs.append(doc_id)
                ids.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words)))
                size += len(raw)
                if size >= CHUNK_BYTES or len(place) >= CHUNK_WORDS:
                    yield _batch(list(flush()))
                    chunk += 1
                    place, docs, ids, size = {b"": 0}, [], [], 0
        if docs:
            yield _batch(list(flush()))
    return run


def _shard(keys, shards: int):
    pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return (mix64(pair + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _requests(words, shards):
    """Distinct keys of the words sorted by (shard, key), the key of each step,
    where each word's steps begin, and each key's shard (-1: level 1)."""
    keys, begin = spell(words)
    distinct, inverse = np.unique(keys, return_inverse=True)
    shard = np.where(_level(distinct) < 2, -1, _shard(distinct, shards))
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[inverse], begin, shard[order]


def _merge_words(shards: int):
    """Rows 'w' of a bucket -> 'v' (its words and counts), 'q' (per chunk the
    numbers of its words), 'n' (keys and customers for a byte server) and 't'
    (what level 1 needs)."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist()))
        place, counts, out = {}, [], []
        for chunk, a, b in rows:
            at = np.array([place.setdefault(w, len(place)) for w in _words(a)], np.int32)
            counts.append((chunk, at, unpack(b, np.int64)))
        c = np.zeros(len(place), np.int64)
        for _, at, n in counts:
            c[at] += n
        order = np.argsort(-c, kind="stable")         # frequent words get small numbers
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        out += [_row("q", bucket, chunk, pack(rank[at])) for chunk, at, _ in counts]
        words = list(place)
        words, c = [words[i] for i in order], c[order]
        out.append(_row("v", bucket, -1, _zip_words(words), pack(c), None, int(c.sum()), int((c > 0).sum())))
        out.append(_row("s", bucket, -1, n=int((c == 1).sum()), m=int((c == 2).sum())))
        keys, step, begin, shard = _requests(words, shards)
        length = np.diff(np.append(begin, len(step)))
        customers = np.bincount(step, weights=np.repeat(c > 0, length), minlength=len(keys)).astype(np.int64)
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(shard)) + 1):
            s = int(shard[part[0]])
            if s >= 0:
                out.append(_row("n", bucket, s, pack(keys[part]), pack(customers[part])))
        used = customers > 0
        triples = np.unique(keys[used & (shard >= 0)] & np.uint64(0xFFFFFF)).astype("<i4")
        first = np.zeros(256, np.int64)
        starts = used & (shard < 0)
        first[(keys[starts] & np.uint64(255)).astype(int)] = customers[starts]
        out.append(_row("t", bucket, -1, triples.tobytes(), first.tobytes()))
        return pa.Table.from_batches([_batch(out)])
    return run


def _byte_server(first: np.ndarray):
    """Rows 'n' of a shard -> rows 'p': the averaged probabilities of the keys
    each bucket asked for."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("chunk")[0].as_py()
        rows = sorted(zip(table.column("bucket").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist()))
        asked = [unpack(a, np.uint64) for _, a, _ in rows]
        keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        customers = np.bincount(inverse, weights=np.concatenate([unpack(b, np.int64) for _, _, b in rows]), minlength=len(keys))
        tree = Subtree(keys, customers)
        mean = tree.run(first, np.random.default_rng([SEED, shard]))
        level, p = _level(keys), np.zeros(len(keys))
        for lv, q in mean.items():
            own = level == lv
            p[own] = q[np.searchsorted(tree.keys[lv], keys[own])]
        at, out = 0, []
        for (bucket, _, _), k in zip(rows, asked):
            out.append(_row("p", bucket, shard, pack(np.log(p[inverse[at:at + len(k)]]).astype(np.float32))))
            at += len(k)
        return pa.Table.from_batches([_batch(out)])
    return run


def _spell_words(shards: int, first: np.ndarray):
    """Rows 'v' and 'p' of a bucket -> row 'l': log base probability of each
    word and its count; m: base probability of all known words together, in
    units of 1e-15."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        v = next(r for r in rows if r["kind"] == "v")
        words, c = _words(v["a"]), unpack(v["b"], np.int64)
        keys, step, begin, shard = _requests(words, shards)
        logp = np.zeros(len(keys))
        one = shard < 0
        logp[one] = np.log(first[32, (keys[one] & np.uint64(255)).astype(int)])
        for r in rows:
            if r["kind"] == "p":
                lo, hi = np.searchsorted(shard, [r["chunk"], r["chunk"] + 1])
                logp[lo:hi] = unpack(r["a"], np.float32)
        log_h = np.add.reduceat(logp[step], begin)
        return pa.Table.from_batches([_batch([_row("l", bucket, -1, pack(log_h), None, pack(c), 0, int(1e15 * np.exp(log_h[c > 0]).sum()))])])
    return run


def _pair_chunk(buckets: int):
    """Rows 'd' and 'q' of a chunk -> rows 'j': per bucket the chunk's pairs
    whose first word is there, and their training counts."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        d = rows[0]                                   # bucket -1
        _, _, held, tokens, owner, before = chunk_tokens(d)
        keys, bucket, inverse = chunk_pairs(tokens, before, rows[1:], buckets)
        train = np.bincount(inverse, weights=held[owner] == 0, minlength=len(keys)).astype(np.int64)
        out = []
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(bucket)) + 1):
            out.append(_row("j", int(bucket[part[0]]), d["chunk"], *pack_pairs(keys[part]), _planes(train[part])))
        return pa.Table.from_batches([_batch(out)])
    return run


def _merge_pairs(buckets: int):
    """Rows 'j' of a bucket -> 'm' (its training pairs and counts; n, m: pairs
    met once and twice), 'i' (per chunk its contexts, which of its pairs are
    training pairs, and which ones) and 'k' (for another bucket: its words met
    here and the contexts of each)."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = sorted(zip(*(table.column(x).to_pylist() for x in ("chunk", "a", "b", "c"))))
        asked = [unpack_pairs(a, b) for _, a, b, _ in rows]
        train = [_from_planes(c) for *_, c in rows]
        keys, inverse = np.unique(np.concatenate([k[n > 0] for k, n in zip(asked, train)]), return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate([n[n > 0] for n in train]), minlength=len(keys)).astype(np.int64)
        out = [_row("m", bucket, -1, *pack_pairs(keys), _planes(c), int((c == 1).sum()), int((c == 2).sum()))] if len(keys) else []
        for (chunk, *_), k in zip(rows, asked):
            at = np.searchsorted(keys, k)
            seen = keys[np.minimum(at, len(keys) - 1)] == k if len(keys) else np.zeros(len(k), bool)
            context = (k >> _PLACE)[np.flatnonzero(np.diff(k >> _PLACE, prepend=-1))]
            out.append(_row("i", bucket, chunk, _planes(np.diff(context, prepend=0)), pack(np.packbits(seen)),
                            _planes(np.diff(at[seen], prepend=0)), len(k)))
        words, contexts = np.unique(keys & ((1 << _PLACE) - 1), return_counts=True)
        for to, at in by_bucket(words, buckets):
            out.append(_row("k", to, bucket, _planes(np.diff(words[at] // buckets, prepend=0)), _planes(contexts[at])))
        return pa.Table.from_batches([_batch(out)])
    return run


def _seat_words(types: int, discount: float, turn: int):
    """Rows 'l' and 'k' of a bucket -> row 'h': log base probability of each
    word, its customers (the tables of its contexts) and tables in each sample,
    its count; n: tables, summed; m: customers."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(r for r in rows if r["kind"] == "l")
        log_h, c = unpack(row["a"], np.float64), unpack(row["c"], np.int64)
        customers = np.zeros(len(c), np.int64)
        for r in rows:
            if r["kind"] == "k":
                customers[np.cumsum(_from_planes(r["a"]))] += _from_planes(r["b"])
        weight = (WORD_STRENGTH + discount * types) * np.exp(log_h)
        rng = np.random.default_rng([SEED, 1 << 20, turn, row["bucket"]])
        tables = np.stack([seat(customers, weight, discount, rng) for _ in range(SAMPLES)])
        return pa.Table.from_batches([_batch([_row("h", row["bucket"], -1, pack(log_h), pack(np.stack([customers, tables.sum(axis=0)])),
                                                   pack(c), int(tables.sum()), int(customers.sum()))])])
    return run


def _word_odds(h: dict, customers: int, tables: float, discount: float):
    """Probability of each word of a row 'h' without context, and of a new table."""
    n, t = unpack(h["b"], np.int64).reshape(2, -1)
    new = (WORD_STRENGTH + discount * tables) / (WORD_STRENGTH + customers)
    log_h = unpack(h["a"], np.float64)
    return np.maximum(n - discount * t / SAMPLES, 0) / (WORD_STRENGTH + customers) + new * np.exp(log_h), new, log_h


def _give_odds(customers: int, tables: float, discount: float):
    """Rows 'h' and 'k' of a bucket -> rows 'g': the probabilities of the words
    that a bucket of pairs met."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        p, _, _ = _word_odds(next(r for r in rows if r["kind"] == "h"), customers, tables, discount)
        return pa.Table.from_batches([_batch([_row("g", r["chunk"], r["bucket"], pack(p[np.cumsum(_from_planes(r["a"]))].astype(np.float32)))
                                              for r in rows if r["kind"] == "k"] or [_row("-", -1, -1)])])
    return run


def seat_pairs(context: np.ndarray, c: np.ndarray, parent: np.ndarray, discount: float, rng):
    """Sweeps over the restaurants of contexts (0, 1, ...): the tables of each
    pair at the end, the averaged probability of each pair without its parent's
    share, and the averaged share of the parent in each context."""
    total = PAIR_STRENGTH + np.bincount(context, weights=c)
    t, direct, share = (c > 0).astype(np.int64), np.zeros(len(c)), np.zeros(len(total))
    for sweep in range(SWEEPS):
        mass = PAIR_STRENGTH + discount * np.bincount(context, weights=t)
        t = seat(c, mass[context] * parent, discount, rng)
        if sweep >= SWEEPS - SAMPLES:
            direct += (c - discount * t) / total[context] / SAMPLES
            share += (PAIR_STRENGTH + discount * np.bincount(context, weights=t)) / total / SAMPLES
    return t, direct, share


def _seat_pairs(buckets: int, discount: float, turn: int):
    """Rows 'm', 'i' and 'g' of a bucket -> rows 'k' as before with the tables
    of each word here, and 'a': per chunk the probabilities of its pairs
    without the parent's share, and that share in each of its contexts."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        m = next((r for r in rows if r["kind"] == "m"), None)
        places, direct, share, out = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), []
        if m:
            keys, c = unpack_pairs(m["a"], m["b"]), _from_planes(m["c"])
            words, word = np.unique(keys & ((1 << _PLACE) - 1), return_inverse=True)
            places, context = np.unique(keys >> _PLACE, return_inverse=True)
            odds, given = np.zeros(len(words)), {r["chunk"]: r["a"] for r in rows if r["kind"] == "g"}
            for to, at in by_bucket(words, buckets):
                odds[at] = unpack(given[to], np.float32)
            t, direct, share = seat_pairs(context, c, odds[word], discount, np.random.default_rng([SEED, 1 << 21, turn, bucket]))
            tables = np.bincount(word, weights=t).astype(np.int64)
            for to, at in by_bucket(words, buckets):
                out.append(_row("k", to, bucket, _planes(np.diff(words[at] // buckets, prepend=0)), _planes(tables[at])))
        for r in rows:
            if r["kind"] == "i":
                p = np.zeros(r["n"], np.float32)
                p[np.unpackbits(unpack(r["b"], np.uint8), count=r["n"]).astype(bool)] = direct[np.cumsum(_from_planes(r["c"]))]
                asked = np.cumsum(_from_planes(r["a"]))
                at = np.searchsorted(places, asked)
                known = places[np.minimum(at, len(places) - 1)] == asked if len(places) else np.zeros(len(asked), bool)
                back = np.ones(len(asked), np.float32)
                back[known] = share[at[known]]
                out.append(_row("a", bucket, r["chunk"], pack(p), pack(back)))
        return pa.Table.from_batches([_batch(out)])
    return run


def _answer(customers: int, tables: float, discount: float, known: float):
    """Rows 'h' and 'q' of a bucket -> rows 'r': count, log10 probability
    without context and the same with unknown words spelled out, of each word
    of a chunk."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        h = next(r for r in rows if r["kind"] == "h")
        c = unpack(h["c"], np.int64)
        seen, new, log_h = _word_odds(h, customers, tables, discount)
        spelled = np.log10(new) + log_h / np.log(10)
        closed = np.where(c > 0, np.log10(np.maximum(seen, 1e-300)), np.log10(new * max(1 - known, 1e-6)))
        out = []
        for r in rows:
            if r["kind"] == "q":
                at = unpack(r["a"], np.int32)
                out.append(_row("r", r["bucket"], r["chunk"], pack(c[at]), pack(closed[at].astype(np.float32)),
                                pack(spelled[at[c[at] == 0]].astype(np.float32))))
        return pa.Table.from_batches([_batch(out)])
    return run


def _score_chunk(buckets: int, train_tokens: int, types: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "open_score"]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        d, q, r, a = rows[0], *([x for x in rows if x["kind"] == kind] for kind in "qra")
        doc, known, held, tokens, owner, before = chunk_tokens(d)
        pairs, bucket, pair = chunk_pairs(tokens, before, q, buckets)
        context = np.cumsum((np.diff(pairs >> _PLACE, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0)) - 1
        direct = np.concatenate([unpack(x["a"], np.float32) for x in a]).astype(np.float64)[pair]
        share = np.concatenate([unpack(x["b"], np.float32) for x in a]).astype(np.float64)[context[pair]]
        c = np.concatenate([unpack(x["a"], np.int64) for x in r])
        logp = np.concatenate([unpack(x["b"], np.float32) for x in r]).astype(np.float64)
        open_ = logp.copy()
        open_[c == 0] = np.concatenate([unpack(x["c"], np.float32) for x in r])
        base = np.log10((c + 0.5) / (train_tokens + 0.5 * (types + 1)))

        def score(log_word):         # logs are added where a pair was never met: spelled words may be below 1e-300
            x = np.log10(share) + log_word[tokens]
            met = direct > 0
            x[met] = np.log10(direct[met] + 10.0 ** x[met])
            return x
        add = lambda x: np.bincount(owner, weights=x, minlength=len(doc))
        cols = [pa.array(doc, mask=known == 0), pa.array(held.astype(bool)), pa.array(np.bincount(owner, minlength=len(doc))), pa.array(add((c > 0)[tokens]).astype(np.int64)),
                pa.array(np.full(len(doc), train_tokens, np.int64)), pa.array(add(base[tokens])), pa.array(add(score(logp))), pa.array(add(score(open_)))]
        return pa.Table.from_arrays(cols, names)
    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_held=held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    open_score (log10) of every row; learns from the rows that ``is_held`` refuses."""
    spark = docs.sparkSession
    made = []

    def store(df, name):
        made.append(scratch_path(spark, name))
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folder = scratch_path(spark, "lm-texts")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))     # a bucket stays as large as it is
    chunks = store(rows.mapInArrow(_to_chunks(buckets, is_held, folder), _PARTS), "lm-chunks")
    vocab = store(chunks.where("kind = 'w'").groupBy("bucket").applyInArrow(_merge_words(buckets), _PARTS), "lm-vocab")
    total = vocab.where("kind = 'v'").agg(F.sum("n"), F.sum("m")).first()
    train_tokens, types = total[0] or 0, total[1] or 0
    once = vocab.where("kind = 's'").agg(F.sum("n"), F.sum("m")).first()
    discount = min(0.95, max(0.05, (once[0] or 0) / max(1, (once[0] or 0) + 2 * (once[1] or 0))))
    # customers of the shortest contexts: distinct (byte, last byte, byte), and first bytes
    pairs = np.zeros((256, 256), np.int64)
    triples = vocab.where("kind = 't'").select("a", "b").mapInArrow(_triples, "code int, n long")
    triples = triples.groupBy("code").agg(F.sum("n").alias("n"))
    counts = triples.groupBy(F.when(F.col("code") < 0, F.col("code")).otherwise(F.col("code").bitwiseAND(0xFFFF)).alias("pair"))
    for r in counts.agg(F.sum(F.when(F.col("code") < 0, F.col("n")).otherwise(1)).alias("n")).collect():   # 65,792 rows at most
        if r["pair"] < 0:
            pairs[32, -1 - r["pair"]] += r["n"]
        else:
            pairs[r["pair"] >> 8, r["pair"] & 255] += r["n"]
    first = shortest_contexts(pairs, np.random.default_rng(SEED))
    keys = vocab.where("kind = 'n'")
    spelled = keys.groupBy("chunk").applyInArrow(_byte_server(first), _PARTS)
    words = vocab.where("kind = 'v'").unionByName(spelled).groupBy("bucket").applyInArrow(_spell_words(buckets, first), _PARTS)
    words = store(words, "lm-words")
    known = (words.agg(F.sum("m")).first()[0] or 0) / 1e15
    texts, numbers = chunks.where("kind = 'd'"), vocab.where("kind = 'q'")
    pairs = texts.unionByName(numbers).groupBy("chunk").applyInArrow(_pair_chunk(buckets), _PARTS)
    pairs = store(pairs.groupBy("bucket").applyInArrow(_merge_pairs(buckets), _PARTS), "lm-pairs")
    once = pairs.where("kind = 'm'").agg(F.sum("n"), F.sum("m")).first()
    pair_discount = min(0.95, max(0.05, (once[0] or 0) / max(1, (once[0] or 0) + 2 * (once[1] or 0))))

    def seated(links, turn):
        """Rows 'h' by the tables in ``links``; customers and tables over all."""
        h = words.unionByName(links).groupBy("bucket").applyInArrow(_seat_words(types, discount, turn), _PARTS)
        h = store(h, "lm-seated")
        total = h.agg(F.sum("m"), F.sum("n")).first()
        return h, total[0] or 0, (total[1] or 0) / SAMPLES
    links = pairs.where("kind = 'k'")
    for turn in range(ROUNDS):                       # words by the tables of their contexts, contexts under the words
        h, customers, tables = seated(links, turn)
        odds = h.unionByName(links).groupBy("bucket").applyInArrow(_give_odds(customers, tables, discount), _PARTS).where("kind = 'g'")
        contexts = pairs.where("kind in ('m', 'i')").unionByName(odds).groupBy("bucket").applyInArrow(_seat_pairs(buckets, pair_discount, turn), _PARTS)
        contexts = store(contexts, "lm-contexts")
        if turn:
            drop_scratch(spark, made.pop(-3))        # the contexts of the turn before
        links = contexts.where("kind = 'k'")
    h, customers, tables = seated(links, ROUNDS)
    answers = numbers.unionByName(h).groupBy("bucket").applyInArrow(_answer(customers, tables, discount, known), _PARTS)
    parts = texts.unionByName(numbers).unionByName(contexts.where("kind = 'a'")).unionByName(answers)
    scored = parts.groupBy("chunk").applyInArrow(
        _score_chunk(buckets, train_tokens, types),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, open_score double")
    out = store(scored, "lm-scores")
    drop_scratch(spark, folder, *made[:-1])
    return out


def _triples(batches):
    """Codes of the triples (n = 1) and, as -1 - byte, of the first bytes."""
    for b in batches:
        for a, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            code, n = np.frombuffer(a, "<i4"), np.frombuffer(first, np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((code, -1 - at)).astype(np.int32)),
                                              pa.array(np.concatenate((np.ones(len(code), np.int64), n[at])))], ["code", "n"])


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of the held-out and the training rows, of the model
    and of the smoothed unigram base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
