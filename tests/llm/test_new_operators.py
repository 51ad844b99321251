"""Merkle manifest, spelling variants, packing: brute force, edge tables, round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, packing, spelling
from tessera.llm.byte_tokenize import ChunkCacheTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, idx long, grp string, rid long, word string"


def rows_of(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = r.choice([None, "", "x", "é" * r.randrange(3), "word " * r.randrange(30)])
        out.append((None if i % 41 == 0 else i // 2 if i % 10 == 0 else i, text, r.choice(["en"] * 6 + ["fr", None, "", "dé", "="]),
                    r.choice([None, "s1"]), r.choice([None, i, 0]), -1, "g", -1, "w"))
    return out + out[:3] + [(10 ** 6, "long " * 50_000, "en", "s", 2 ** 63 - 1, 0, "", 0, "")] * bool(n)


# ------------------------------------------------------------------ merkle --
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(nodes, fanout):
    """root, and per node its siblings: (left, right) of every level."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i:i + fanout]
            for k in range(len(run)):
                for m in members[i + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(H(*run))
            held.append(sum(members[i:i + fanout], []))
        nodes, members = up, held
    return nodes[0], paths


def manifest_of(rows, fanout, bump):
    groups = defaultdict(list)
    for i, text, lang, source, n, *_ in rows:
        own = leaf(i, source, lang, n, text)
        other = leaf(i, source, lang, None if n is None else n + 1, text) if bump(i) else own
        groups[lang].append((i is not None, i or 0, own, other, i))
    trees = []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        ls = sorted(groups[g], key=lambda x: x[:4])
        trees.append((ls, *tree([x[2] for x in ls], fanout)))
    root, above = tree([t[1] for t in trees], fanout)
    out = []
    for (ls, sub, paths), up in zip(trees, above):
        for (_, _, own, other, i), path in zip(ls, paths):
            h = other
            for a, b in path + up:
                h = H(a, h, b)
            out.append((i, own, sub, root, H(*(a + b for a, b in path + up)), h, h == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n,fanout,block", [(0, 2, 256), (1, 2, 256), (37, 2, 8), (700, 2, 256), (300, 3, 9), (120, 5, 4)])
def test_manifest_equals_plain_trees(spark, monkeypatch, n, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = rows_of(n)
    bump = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    c = F.col("n_chars").cast("decimal(20,0)")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.verify(merkle.manifest(spark.createDataFrame(rows, DOCS), fanout=fanout, tampered={"n_chars": F.when(hit, c + 1).otherwise(c)}))
    want = manifest_of(rows, fanout, bump) if rows else []
    assert sorted(map(tuple, made.select(COLUMNS).collect()), key=str) == sorted(want, key=str)
    if n > 100:
        assert {v[-1] for v in want} == {True, False}
        whole = merkle.verify(merkle.manifest(spark.createDataFrame(rows, DOCS), fanout=fanout))
        assert whole.where("not verified").count() == 0 and whole.count() == len(rows)


def test_one_shuffle_and_sort_serve_all_levels(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 2).cast("string").alias("grp"), F.col("id").alias("idx"),
                             F.sha2(F.col("id").cast("string"), 256).alias("hash")).write.parquet(f"{tmp_path}/n")
    plan = merkle._round(spark.read.parquet(f"{tmp_path}/n"), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
    with pytest.raises(ValueError):
        merkle.trees(spark.read.parquet(f"{tmp_path}/n"), [], 1)


# ---------------------------------------------------------------- spelling --
def plain_variants(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += len(w) >= 6
    n = {w: k for w, k in count.items() if k >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), near


def edited(r, w, letters):
    k, c = r.randrange(len(w) + 1), r.choice(letters)
    return r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:]])


@pytest.fixture(scope="module")
def spelled():
    """Families of words with edits of edits, over a small alphabet with ties."""
    r = random.Random(11)
    words = Counter()
    for letters in ("abc", "aeiourstn", "éàabÿ"):
        for _ in range(12):
            w = "".join(r.choice(letters) for _ in range(r.randrange(6, 11)))
            for k, n in ((0, 150), (1, 28), (2, 5), (1, 28), (1, 6), (2, 5)):
                v = w
                for _ in range(k):
                    v = edited(r, v, letters)
                words[v] += n
    text = [w.upper() if r.random() < 0.1 else w for w, n in words.items() for _ in range(n)]
    r.shuffle(text)
    docs = [(i if i % 9 else None, "; ".join(text[i * 40:i * 40 + 40]) + " Àé×ßÿÉ") for i in range(len(text) // 40 + 1)]
    return [(i, t, "l", "s", 0, 0, "g", 0, "w") for i, t in docs] + [(1, None, None, None, 0, 0, "", 0, ""), (2, "", None, None, 0, 0, "", 0, "")]


@pytest.mark.parametrize("frequent", [spelling.FREQUENT, 40, 1])
def test_variants_equal_all_pairs(spark, monkeypatch, spelled, frequent):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (None, spelling.SHORTEST, spelling.LONGEST, frequent))
    got = spelling.variants(spark.createDataFrame(spelled, DOCS))
    want, near = plain_variants(spelled)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want
    assert any(w[1] and w[2] != w[1] for w in want) and sum(map(len, near.values())) > 100


def test_no_words(spark, spelled):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame(spelled[-2:], DOCS)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], DOCS), least_length=5)


def test_bound_holds_for_every_edit():
    r = random.Random(4)
    for _ in range(3000):
        letters = r.choice(["ab", "abcd", "étab"])
        w = "".join(r.choice(letters) for _ in range(r.randrange(6, 12)))
        frequent = {"".join(r.choice(letters) for _ in range(r.choice([2, 3]))) for _ in range(r.randrange(0, 14))}
        v = edited(r, w, letters)
        if v == w or len(v) < 6:
            continue
        (a, keep_a), (b, keep_b) = spelling.decompose(w, frequent), spelling.decompose(v, frequent)
        assert keep_a >= 1 and keep_b >= 1
        shift = len(v) - len(w)
        # grams before the edit keep their place, those after it are shifted
        best = max(sum(a[i] == b[i] for i in range(min(k, len(a), len(b))))
                   + sum(0 <= i + shift < len(b) and i + shift >= k and a[i] == b[i + shift] for i in range(k, len(a))) for k in range(len(w) + 1))
        assert best >= max(keep_a, keep_b)


def test_dictionary_is_bounded(spark, spelled):
    words = spelling.count_words(spark.createDataFrame(spelled, DOCS))
    for frequent in (1, 10, 60):
        grams = spelling.frequent_grams(words, frequent=frequent)
        assert all(sum(len(g) == n for g in grams) < max(frequent, 1) for n in (2, 3))
        all_ = Counter(r.word[i:i + n] for r in words.collect() for n in (2, 3) for i in range(len(r.word) - n + 1))
        assert all(all_[g] == n for g, n in grams.items())


# ----------------------------------------------------------------- packing --
def byte_bpe():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def test_chunk_cache_equals_the_library():
    tok, r = ChunkCacheTokenizer(byte_bpe(), max_chunks=300), random.Random(2)
    bits = [*"ab'sdreEÉñü  \n\t\r .,;-_123²½ÿ×日本<|>", "<|endoftext|>", "'re", "\xa0", "\x1c", "Ⅷ", "👍", "hello", " world", "x" * 70]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 20))) for _ in range(6000)] + ["", " ", "  ", "\n \n", "a" * 100_000]
    assert tok.encode(texts) == tok._library(texts)


def one_by_one(counts, capacity, weights, rule):
    """Vector best-fit, one piece at a time."""
    scale, bins = [w / c for w, c in zip(weights, capacity)], []
    for length in sorted(counts, reverse=True):
        need = (length, 1, length * length)
        for _ in range(counts[length]):
            fit = [b for b in set(bins) if all(x >= y for x, y in zip(b, need))]
            if rule == "norm":
                best = min(fit, key=lambda b: (sum((s * (x - y)) ** 2 for s, x, y in zip(scale, b, need)), b), default=None)
            else:
                best = min(fit, key=lambda b: (-sum(s * s * x * y for s, x, y in zip(scale, b, need)), b), default=None)
            if best is None:
                best = tuple(capacity)
            else:
                bins.remove(best)
            bins.append(tuple(x - y for x, y in zip(best, need)))
    return sorted(bins)


@pytest.mark.parametrize("capacity,weights", [((64, 64, 4096), (1, 0.01, 0.01)), ((64, 4, 4096), (1, 0.5, 0.1)), ((64, 64, 1700), (1, 0.2, 1)),
                                              ((40, 3, 1600), (1, 1, 1))])
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_classes_place_as_one_by_one(capacity, weights, rule):
    r = random.Random(str((capacity, rule)))
    for _ in range(25):
        counts = {n: r.randrange(1, 40) for n in r.sample(range(1, 41), r.randrange(1, 15))}
        ranges, n = packing.best_fit(counts, capacity, weights, rule)
        seqs, ranks = defaultdict(list), defaultdict(set)
        for length, rank, k, first, offset in ranges:
            for i in range(k):
                seqs[first + i].append((offset, length))
                assert rank + i not in ranks[length]
                ranks[length].add(rank + i)
        assert {x: set(range(c)) for x, c in counts.items()} == ranks and len(seqs) == n
        left = []
        for parts in seqs.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]
            use = (sum(x for _, x in parts), len(parts), sum(x * x for _, x in parts))
            assert all(u <= c for u, c in zip(use, capacity))
            left.append(tuple(c - u for c, u in zip(capacity, use)))
        assert sorted(left) == one_by_one(counts, capacity, weights, rule)
    with pytest.raises(ValueError):
        packing.best_fit({capacity[0] + 1: 1}, capacity)


@pytest.fixture(scope="module")
def long_docs():
    rows = [(i, t, "l", "s", 0, 0, "g", -1, "w") for i, t, *_ in rows_of(150, 3)]
    r = random.Random(8)
    return rows + [(9000 + k, " ".join(r.choice(["tokens", "über", "x1,"]) for _ in range(k * 61)), None, None, 0, 0, "", 0, "") for k in range(40)]


def test_packing_of_documents(spark, long_docs):
    from tokenizers import Tokenizer
    tok, cap = Tokenizer.from_file(byte_bpe()), (256, 9, 70_000)
    df = spark.createDataFrame(long_docs, DOCS).repartition(5)
    packed = packing.pack(df, byte_bpe(), 2, cap, weights=(1.0, 0.3, 0.3))
    rows = packed.collect()
    want = Counter()
    for i, text, *_ in long_docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, z - a, zlib.crc32(ids[a:z].tobytes()), ids[a:z].astype("<u2").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
    for parts in seqs.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
        assert sum(r.length for r in parts) <= 256 and len(parts) <= 9 and sum(r.length ** 2 for r in parts) <= 70_000
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert {k: bytes(v.ids) for k, v in whole.items()} == {k: b"".join(bytes(r.ids) for r in v) for k, v in seqs.items()}
    assert all(v.n_tokens == len(v.ids) // 2 == sum(p.length for p in v.documents) for v in whole.values())


def test_few_sequences_when_only_tokens_bind(spark, long_docs):
    rows = packing.pack(spark.createDataFrame(long_docs, DOCS), byte_bpe(), 2, with_ids=False).collect()
    tokens = sum(r.length for r in rows)
    assert -(-tokens // 1024) <= len({r.sequence_id for r in rows}) <= -(-tokens // 1024) + 1
    assert packing.pack(spark.createDataFrame([], DOCS), byte_bpe(), 2).count() == 0
    assert packing.sequences(packing.pack(spark.createDataFrame([], DOCS), byte_bpe(), 2)).count() == 0
