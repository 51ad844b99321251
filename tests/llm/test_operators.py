"""Training-data operators: edge tables, brute-force versions and round trips."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import dart_minhash, decontaminate, html_text, mixing, pitman_yor, quality, rans, secrets, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, class_id long, kept string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, equal ids, clashing columns."""
    base = prose(1, 80)
    near = base.split()
    near[40] = "changed"
    texts = [(1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t"), (7, prose(2, 40000)),
             (None, prose(3, 30)), (8, "short one"), (9, prose(9, 60)), (9, prose(10, 60)), (10, "x" * 50000)]
    rows = [(i, t, None if i == 4 else "en", None if i in (5, 9) else f"s{(i or 0) % 2}", 0, -1, -2, "no") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 300_000), 49_407).astype(np.uint16)
    table = rans.Table(rans.normalise(np.bincount(ids, minlength=49408)))
    for n in (0, 1, 2, 255, 1000, 300_000):
        assert (table.decode(table.encode(ids[:n])) == ids[:n]).all()
    block = table.encode(ids)
    lanes = min(rans.MAX_LANES, len(ids) // rans.LANE_STEPS)
    part = table.decode(block, 1)                       # a checkpoint starts anywhere
    assert (part == ids[rans.SEGMENT * lanes:][:len(part)]).all()
    broken = bytearray(block)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        table.decode(bytes(broken))


def test_token_output(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.token_output import token_output
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted((r for r in token_output(docs, path).collect()), key=lambda r: r["start"])
    tok = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_output(empty, path).count() == 0


def test_secrets_link_only_where_parts_meet(spark, empty):
    near = "password: abc  user=alice  https://host.example.com/x"
    far = "password: abc " + "word " * 200 + " user=alice"
    split = "password: abc\n\nuser=alice"
    rows = [(1, near), (2, far), (3, split), (4, None), (5, ""), (6, "token = " + "a1" * 20), (6, "AKIA" + "A" * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_assign"], r["n_access"]): r for r in secrets.find_secrets(df, reach=256).collect()}
    assert {s.split(":")[0] for s in got[1, 0, 0]["spans"].split(",")} == {"short", "user", "endpoint"}
    assert got[2, 0, 0]["spans"] == "" and got[3, 0, 0]["spans"] == ""
    # without a reach the scope is the interval: parts link however far apart
    whole = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df.where("doc_id < 4")).collect()}
    assert {s.split(":")[0] for s in whole[2].split(",")} == {"short", "user"} and whole[3] == ""
    none = hashlib.sha256(b"").hexdigest()
    assert got[4, 0, 0]["base_sha256"] == none and got[5, 0, 0]["spans"] == ""
    assert got[6, 1, 0]["spans"] == "assign:0:48,hex:8:48" and got[6, 0, 1]["n_hex"] == 0
    assert secrets.find_secrets(empty).count() == 0


def test_quality_verdict_does_not_depend_on_order(spark, docs, empty):
    names = list(quality.RULES)
    a = quality.cascade(docs, order=names, stats=True).select("doc_id", "n_words", "n_repeat_words", "kept")
    b = quality.cascade(docs, order=names[::-1], stats=True).select("doc_id", "n_words", "n_repeat_words", "kept")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3}
    assert quality.cascade(empty, stats=True).count() == 0
    words = (b"a b c d e f a b c d e g " * 3).split()
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    assert quality.Text(b" ".join(words)).n_repeat_words == len(cover)


def test_language_model(spark, docs, empty):
    got = pitman_yor.score_texts(docs).collect()
    tokens = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in docs.collect()]
    train = Counter(w for d, ws in tokens if not pitman_yor.held_out(d) for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted((d or -1, len(ws), sum(train[w] > 0 for w in ws), round(sum(
        math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for d, ws in tokens)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and r["open_score"] <= 0 and r["train_tokens"] == n for r in got)
    assert pitman_yor.score_texts(empty).count() == 0


def test_seating():
    rng = np.random.default_rng(3)
    c = np.array([0, 1, 2, 50, 5000])
    mean = np.mean([pitman_yor.seat(c, np.full(5, 2.0), 0.0, rng) for _ in range(400)], axis=0)
    want = [0, 1] + [1 + sum(2 / (2 + i) for i in range(1, k)) for k in (2, 50, 5000)]
    assert np.allclose(mean, want, rtol=0.06)


def test_html(spark):
    page = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav>"
            "<div class='cookie-notice'>We use cookies on this site.</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n"
            " text of the article here.<p>Second paragraph of it.</article><div id=comments><p>A reader writes this.</div><footer>(c)</footer>")
    assert html_text.main_text(page) == "Head & line\nFirst bold text of the article here.\nSecond paragraph of it."
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and got[1]["n_chars"] == len(got[1]["text"])


def test_min_cut_is_least():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 7)
        unary = [r.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): r.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}

        def price(lab):
            return (sum(max(0, u) if not x else max(0, -u) for u, x in zip(unary, lab))
                    + sum(c for (i, j), c in edges.items() if lab[i] != lab[j]))
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(price(html_text.min_cut(unary, edges)) - best) < 1e-6


def test_mix_against_its_schedule(spark, docs, empty):
    rows, slots = mixing.mix(docs)
    got = rows.collect()
    streams, taken = {}, Counter()
    for r in sorted(got, key=lambda r: r["stream_start"]):
        streams.setdefault(r["source"], []).extend([(r["doc_id"], r["tie"])] * r["size"])
    for s in slots.collect():
        stream = streams[s["source"]]
        for i in range(mixing.BLOCK_WORDS):
            at = s["repeat"] * len(stream) + s["block_start"] + i
            if at < 3 * len(stream):
                taken[stream[at % len(stream)]] += 1
    want = Counter()
    for r in got:
        want[r["doc_id"], r["tie"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert +want == +taken
    again = mixing.mix(docs)[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.apply_mix(docs).columns == docs.columns
    assert mixing.mix(empty)[0].count() == 0
    assert mixing.targets({"a": 10, "b": 10, "c": 100, None: 0})["c"] <= 300


def test_near_duplicates(spark, docs, empty):
    got = {(r["doc_id"]): r["class_id"] for r in dart_minhash.classes(docs).collect()}
    assert got[1] == got[2] == got[3] == 1
    assert all(got[i] == i for i in (4, 5, 6, 7, 8, 10)) and got[None] is None
    kept = [r["doc_id"] for r in dart_minhash.keep_first(docs).collect()]
    assert Counter(kept)[1] == 1 and 2 not in kept and 3 not in kept
    assert dart_minhash.classes(empty).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    pool = rng.integers(1, 2 ** 63, 400).astype(np.uint64)
    wa, wb = rng.uniform(0, 3, 400), rng.uniform(0, 3, 400)
    sig = dart_minhash.signatures([pool, pool], [wa, wb], k=2000, darts=2000 * 12)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05


def test_dart_signatures_are_the_earliest_dart_of_each_coordinate():
    k, darts = 16, 40                                   # few darts: some texts go on at twice the rank
    m64, unit, odd = dart_minhash.mix64, dart_minhash._unit, dart_minhash._ODD

    def plain(e, w):
        cells = [(x, c, min(1.0, v - c)) for x, v in zip(e, w) for c in range(int(np.ceil(v)))]
        to = darts / sum(lim for _, _, lim in cells)
        while True:
            best = {}
            for x, c, lim in cells:
                cell = m64(np.array([x], np.uint64) ^ m64(np.array([c], np.uint64) + odd))
                at, number = 0.0, 0
                while True:
                    number += 1
                    dart = m64(cell + np.array([number], np.uint64) * odd)
                    at = at - np.log(unit(dart))[0]
                    if at > to:
                        break
                    place = m64(dart ^ odd)
                    if unit(place)[0] <= lim:
                        at_k = int(m64(place + odd)[0] % np.uint64(k))
                        best[at_k] = min(best.get(at_k, (np.inf, 0)), (at, int(dart[0])))
            if len(best) == k:
                return [best[i][1] for i in range(k)]
            to *= 2
    r = np.random.default_rng(4)
    bags = [r.integers(0, 9, n).astype(np.uint64) for n in (1, 2, 7, 30)]
    sets = [np.unique(b, return_counts=True) for b in bags]
    assert dart_minhash.signatures(bags, k=k, darts=darts).tolist() == [plain(*x) for x in sets]
    weights = [r.uniform(0.1, 3, len(e)) for e, _ in sets]
    got = dart_minhash.signatures([e for e, _ in sets], weights, k=k, darts=darts)
    assert got.tolist() == [plain(e, w) for (e, _), w in zip(sets, weights)]


def test_toxicity(spark, docs, empty):
    assert toxicity.Grammar({}).features(b"you are an idiot.")[0] > toxicity.Grammar({}).features(b"you are not an idiot.")[0]
    assert toxicity.Grammar({}).features(b"he said you idiot.")[0] < toxicity.Grammar({}).features(b"he saw you idiot.")[0]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon, weights = toxicity.learn(docs, labels)
    got = toxicity.score(docs, lexicon, weights).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.score(empty, lexicon, weights).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "u", "same", 0), (2, "v", "same", 0), (2, "v", "same", 0), (3, None, None, 0), (4, "w\r\n%", "", 0), (None, "n", "other", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    got = warc.read_archives(warc.write_archives(df)).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "response", None)])
    assert {r["url"] for r in got} == {"u", "v", None, "w\r\n%", "n"}
    whole = warc.record(1, "u", b"x" * 100_000, warc.digest(b"x" * 100_000), None, True) * 2
    assert len(list(warc.read_records(io.BytesIO(whole), chunk=7))) == 2
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(whole[:-5])))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_leaks(spark, docs, empty):
    def least(p, t):
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            cur = [i]
            for j, d in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
            prev = cur
        return min(prev)
    r = random.Random(4)
    for _ in range(100):
        p, t = ("".join(r.choice("ab ") for _ in range(r.randint(1, n))) for n in (70, 90))
        assert decontaminate.myers(decontaminate.pattern_masks(p), len(p), t)[0] == least(p, t)
    passage = prose(50, 12)
    items = spark.createDataFrame([(1, passage), (2, None), (3, "tiny"), (4, prose(51, 12))], "item_id long, text string")
    held = spark.createDataFrame([(1, f"{prose(52, 9)} {passage.upper()}! tail"), (2, "a " + passage.replace("a", "A", 2)[:-1]),
                                  (3, prose(53, 50)), (4, None)], "doc_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(held, items).collect()} == {(1, 1), (2, 1)}
    assert {x["doc_id"] for x in decontaminate.drop_leaks(held, items).collect()} == {3, 4}
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.drop_leaks(docs, items).count() == docs.count()


def test_language_model_knows_the_word_before(spark):
    r = random.Random(8)
    follows = {w: r.sample(WORDS, 2) for w in WORDS}

    def walk(n):
        out = [r.choice(WORDS)]
        while len(out) < n:
            out.append(r.choice(follows[out[-1]]))
        return out
    texts = [walk(60) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(r.sample(t, len(t)))) for i, t in enumerate(texts)]
    rows += [(200, "unheard alpha unheard"), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in pitman_yor.score_texts(df, is_held=lambda d: d >= 40).collect()}
    for i in range(40, 60):                    # held out, in order and shuffled
        assert got[i]["base_score"] == pytest.approx(got[100 + i]["base_score"])
        assert got[i]["score"] > got[100 + i]["score"] + 10
    assert got[200]["n_known"] == 2 and got[200]["open_score"] < got[200]["score"] < 0


def test_pairs_of_words_against_a_count(spark):
    r = np.random.default_rng(4)
    keys = np.unique(r.integers(0, 50, 500) << pitman_yor._PLACE | r.integers(0, 1 << 30, 500))
    assert (pitman_yor.unpack_pairs(*pitman_yor.pack_pairs(keys)) == keys).all()
    context, c, parent = np.array([0, 0, 0, 1, 1]), np.array([5, 1, 1, 2, 90]), np.array([.4, .2, .1, .2, .4])
    _, direct, share = pitman_yor.seat_pairs(context, c, parent, 0.7, r)
    total = np.bincount(context, weights=direct) + share
    assert np.allclose(total, 1)               # the parent's probabilities add up to one
    texts = [(i, prose(i, 300)) for i in range(30)] + [(31, None), (31, "alpha1 alpha1"), (None, "alpha1 alpha1")]
    made = []
    real = pitman_yor.drop_scratch
    pitman_yor.drop_scratch = lambda spark, *paths: made.extend(paths)
    try:
        pitman_yor.score_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).count()
    finally:
        pitman_yor.drop_scratch = real
    want = Counter(p for d, t in texts if not pitman_yor.held_out(d) for w in [[""] + (t or "").split() + [""]] for p in zip(w, w[1:]))
    path = next(p for p in made if "lm-pairs" in p)
    got = Counter()
    for m in spark.read.parquet(path).where("kind = 'm'").collect():
        got.update(pitman_yor._from_planes(m["c"]).tolist())
    assert got == Counter(want.values())
    real(spark, *made)


def test_keep_first_tells_rows_of_one_id_apart(spark, docs):
    kept = dart_minhash.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted(r["text"] for r in kept.collect() if r["doc_id"] == 9) == sorted([prose(9, 60), prose(10, 60)])
    a, b, c = prose(60, 80), prose(61, 80), prose(62, 80)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c + " more"), (4, None), (4, ""), (4, b + " " + a), (4, b + " " + a), (None, a)]
    kept = dart_minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], r["text"] or "") for r in kept)
    assert got.pop((3, c), 0) + got.pop((3, c + " more"), 0) == 1            # near copies with one id
    assert got == Counter([(1, a), (2, b), (4, ""), (4, b + " " + a), (None, a)])


def test_shouting_beyond_ascii():
    for word in ("ПРИВЕТ", "ÉCOLE", "ÑANDÚ", "ΑΘΗΝΑ", "~HELLO", "LOUD", "«ВНИМАНИЕ»"):
        assert quality.Text(f"{word} тихо quiet éa A Я 1".encode()).n_shouted == 1, word
    assert quality.Text("東京 ёлка ünder 12 É".encode()).n_shouted == 0
    loud = quality.Text(" ".join(f"ГРОМКО{'АБВГДЕЖЗИКЛМ'[i]}" for i in range(12)).encode())
    assert quality.RULES["shouting"][1](loud)


def test_short_items_are_leaks_too(spark):
    items = spark.createDataFrame([(1, "Who is Ada?"), (2, "?!"), (3, "tiny"), (4, "été")], "item_id long, text string")
    held = spark.createDataFrame([(1, "so: who is ADA, then"), (2, "who is adam"), (3, "destiny ?! tinyx"), (4, "a tiny-ish one; tiny"), (5, "Été")],
                                 "doc_id long, text string")
    got = sorted(tuple(x) for x in decontaminate.find_leaks(held, items).collect())
    assert got == [(1, 1, 0, 3, 13), (4, 3, 0, 2, 6), (5, 4, 0, 0, 5)]
    assert {x["doc_id"] for x in decontaminate.drop_leaks(held, items).collect()} == {2, 3}


def test_long_near_copies_pass_the_cell_test(spark):
    words = [f"w{i}" for i in range(300_000)]
    texts = spark.createDataFrame([(b"a", " ".join(words)), (b"b", " ".join(words[:270_000]))], "rep binary, text string")
    mixed = spark.createDataFrame([(0, 5, b"a", b"a", True), (0, 5, b"b", b"b", False)], "band int, key long, rep binary, root binary, minor boolean")
    reps = spark.createDataFrame([(b"a", [5]), (b"b", [5])], "rep binary, keys array<long>")
    true = (270_000 - 4) / (300_000 - 4)
    for least, n in ((true - 1e-9, 1), (true + 1e-3, 0)):
        assert dart_minhash._cross_pairs(mixed, reps, texts, least).count() == n
