"""Operators and the pipeline against plain versions of themselves."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import dart_minhash, decontaminate, html_text, mixing, quality, secrets, token_output
from tessera.llm.tokenize import WordCacheTokenizer

WORDS = [a + b for a in "be da fo gi hu ka le mi no pu ra si to".split() for b in "na ro li tu se".split()]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edit(r, text, k):
    w = text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = "changed" + str(r.randrange(10 ** 6))
    return " ".join(w)


# ------------------------------------------------------------ near copies --
def bag(text):
    w = (text or "").split()
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def alike(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def components(texts, least):
    """Class number per text by all pairs; texts without words stay alone."""
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and alike(bags[i], bags[j]) >= least:
                links += 1
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))], links


@pytest.fixture(scope="module")
def families():
    r, texts = random.Random(21), []
    for f in range(18):
        base = prose(r, r.choice([4, 12, 60, 150]))
        texts.append(base)
        for _ in range(r.randrange(0, 9)):
            texts.append(r.choice([base, base.replace(" ", "\n"), edit(r, r.choice(texts[-3:]), r.randrange(0, 4))]))
    hub = prose(r, 80)
    texts += [edit(r, hub, r.randrange(0, 6)) for _ in range(60)]          # one large group of near copies, many not alike
    texts += [None, "", " \n", prose(r, 30), prose(r, 3)]
    rows = [(None if i % 37 == 5 else i, t) for i, t in enumerate(texts)]
    return rows


def test_classes_equal_all_pairs(spark, families):
    want, links = components([t for _, t in families], dart_minhash.SIMILARITY)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(families)], "doc_id long, text string, class_id long").repartition(3)
    got = dart_minhash.classes(df, with_words=True).collect()
    assert len(got) == len(families) and links > 300
    key = {dart_minhash._text_key((t or "").encode().split()): c for (_, t), c in zip(families, want) if (t or "").split()}
    first = defaultdict(lambda: math.inf)
    for (i, t), c in zip(families, want):
        if i is not None and (t or "").split():
            first[c] = min(first[c], i)
    pairs = {}
    for row in got:                                   # one group here for one class there, and the other way round
        if row.group_key is None:
            assert row.class_id == row.doc_id
            continue
        c = key[bytes(row.words_key)]
        assert pairs.setdefault(c, bytes(row.group_key)) == bytes(row.group_key)
        assert row.class_id == (first[c] if first[c] < math.inf else None)
    assert len(set(pairs.values())) == len(pairs) == len(set(key.values()))


def test_two_runs_live_side_by_side(spark, families):
    df = spark.createDataFrame(families, "doc_id long, text string")
    a = dart_minhash.keep_first(df)
    b = dart_minhash.keep_first(df.where("doc_id % 2 = 0"))
    assert a.count() > b.count() > 0 and a.count() > 0


def test_joined_groups_equal_all_links(spark):
    r = random.Random(3)
    for _ in range(3):
        links = [(b"%03d" % r.randrange(60), b"%03d" % r.randrange(60)) for _ in range(40)]
        links = [x for x in links if x[0] != x[1]]
        df = lambda x: spark.createDataFrame(x, "a binary, b binary")
        made: list = []
        one = dart_minhash._joined(dart_minhash.connected(df(links[:20]), made), df(links[20:]), made)
        assert {(bytes(x.node), bytes(x.root)) for x in one.collect()} == {(bytes(x.node), bytes(x.root)) for x in dart_minhash.connected(df(links)).collect()}


# -------------------------------------------------------- decontamination --
def substring_distance(item, text):
    """Least edit distance of the item to any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def found_plainly(text, items):
    form, out = decontaminate.normal_form(text or ""), {}
    for i, t in items:
        item = decontaminate.normal_form(t or "")
        e = len(item) // decontaminate.BYTES_PER_ERROR
        if not item or not form:
            continue
        if e:
            d = substring_distance(item, form)
            if d <= e:
                out[i] = d
        elif any(form.startswith(item, s) and decontaminate.whole_words(form, s, s + len(item)) for s in range(len(form))):
            out[i] = 0
    return out


def test_leaks_equal_a_full_scan(spark):
    r = random.Random(6)
    items = [(i, prose(r, r.choice([1, 2, 3, 8, 25]))) for i in range(25)] + [(90, None), (91, "?!"), (92, "ä"), (None, prose(r, 6))]
    texts = []
    for k in range(120):
        t = list(prose(r, r.randrange(0, 40)))
        if r.random() < 0.7:
            item = list(r.choice(items[:25])[1])
            for _ in range(r.randrange(0, len(item) // 9 + 2)):
                at = r.randrange(len(item))
                item[at:at + 1] = r.choice([[], ["x"], [item[at], "y"], ["Ü"]])
            at = r.randrange(len(t) + 1)
            t[at:at] = list(r.choice(["", " "])) + item + list(r.choice(["", " "]))
        texts.append((k, "".join(t)))
    texts += [(500, None), (501, ""), (None, items[4][1])]
    got = defaultdict(dict)
    for x in decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got[x.doc_id][x.item_id] = x.distance
    want = {d: f for d, t in texts if (f := found_plainly(t, items))}
    assert got == want and sum(any(f.values()) for f in want.values()) > 10
    kept = decontaminate.drop_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in texts if d not in want}


def test_one_rule_for_all_lengths():
    """One edit in a 39-byte item is found like one in a 40-byte item."""
    for n in (13, 24, 39, 40, 41):
        item = ("abcdefghij " * 5)[:n - 1] + "z"
        matcher = decontaminate.Matcher([(1, item)])
        broken = item[:5] + "#Q" + item[6:]
        assert matcher.hits("so " + item.replace("f", "x", 1) + " then") and matcher.hits("so " + item + " then"), (n, broken)
    assert not decontaminate.Matcher([(1, "tiny item")]).hits("a tiny itemx")


# ----------------------------------------------------------------- tokens --
def test_special_tokens_as_the_library_has_them(spark):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, r = WordCacheTokenizer(path), random.Random(9)
    bits = [*"ab'sEÉñ \n.,-12²<|>", "<|endoftext|>", "<|startoftext|>", "hello", " w"]
    texts = ["<|endoftext|> a", "a <|startoftext|>b"] + ["".join(r.choice(bits) for _ in range(r.randrange(0, 12))) for _ in range(4000)]
    lib = [np.asarray(e.ids, "<u2").tobytes() for e in tok.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert tok.encode(texts) == lib
    assert np.frombuffer(lib[0], "<u2")[0] == 49407
    rows = [(i, t) for i, t in enumerate(texts[:200])]
    got = {x.doc_id: (x.n_tokens, x.ids_crc32) for x in token_output.token_output(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for (i, _), ids in zip(rows, lib):
        ids = np.append(np.frombuffer(ids, "<u2"), 2).astype("<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


# ---------------------------------------------------------------- secrets --
def linked_plainly(text, reach=None):
    strong = secrets.strong_parts(text)
    weak = secrets.weak_parts(text, strong)
    breaks = [m.start() for m in secrets._BLANK.finditer(text)]
    scope = lambda a: sum(x < a for x in breaks)
    out = list(strong)
    for a, kind, b in weak:
        around = {secrets.ROLE[k] for x, k, y in strong + weak
                  if scope(x) == scope(a) and (reach is None or (x - b <= reach and a - y <= reach))}
        ok = {"secret": around & {"identifier", "endpoint"}, "identifier": "secret" in around,
              "endpoint": {"identifier", "secret"} <= around}[secrets.ROLE[kind]]
        if ok:
            out.append((a, kind, b))
    return secrets._join(out)


@pytest.mark.parametrize("reach", [None, 60])
def test_links_equal_all_pairs(spark, reach):
    r = random.Random(12)
    bits = ["password: abc", "user=alice", "https://host.example.com/x", "AKIA" + "A" * 14, "token = " + "a1" * 20, "Zk3" * 9, "login: bob_1", "\n\n",
            "db.example.org:5432", "secret=longenough1", "\n", "word " * 9, "f" * 32, "api_key: x1"]
    texts = [(k if k % 9 else None, " ".join(r.choice(bits) for _ in range(r.randrange(0, 14))), -1) for k in range(150)] + [(1, None, 0), (2, "", 0)]
    got = secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string, scope long"), reach=reach).collect()
    assert Counter((x.doc_id, x.spans) for x in got) == Counter((i, linked_plainly(t or "", reach)) for i, t, _ in texts)
    assert any("short" in x.spans and "user" in x.spans for x in got)


def test_long_texts_take_linear_time():
    text = "\n\n".join(f"user=alice{i} password: abc" for i in range(20_000)) + " AKIA" + "B" * 20
    began = time.perf_counter()
    strong = secrets.strong_parts(text)
    assert len(secrets.weak_parts(text, strong)) == 40_000
    many = " ".join(f"token = {'a1' * 6}{i}" for i in range(20_000))
    assert len(secrets.strong_parts(many)) == 20_000 and not [p for p in secrets.weak_parts(many, secrets.strong_parts(many)) if p[1] != "token"]
    assert time.perf_counter() - began < 6


# ------------------------------------------------------------------ mixing --
def test_a_thousand_sources(spark):
    shares = [(i, (i % 3 + 1) / 1999.0) for i in range(1000)]
    total = sum(s for _, s in shares)
    slots = mixing.schedule(spark, [(i, s / total) for i, s in shares], 40_000).collect()
    got = Counter(x.source_no for x in slots)
    assert max(abs(got[i] - 40_000 * s / total) for i, s in shares) <= 17
    ranks = defaultdict(list)
    for x in sorted(slots, key=lambda x: x.slot):
        ranks[x.source_no].append(x.rank)
    assert all(v == list(range(len(v))) for v in ranks.values())


def test_sequence_is_the_mix_and_its_prefixes_keep_the_weights(spark):
    r = random.Random(14)
    rows = [(None if i % 50 == 0 else i, prose(r, r.choice([0, 3, 40, 400])), "en", r.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(300)]
    rows += [(9, "", "en", "only-empty", 0), (7, None, "en", "a", 0), (7, rows[8][1], "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    seq = mixing.sequence(df).collect()
    taken = Counter()
    for x in seq:
        taken[x.doc_id, x.tie] += x.words
    assert +taken == +Counter({k: n for k, n in _taken(mixing.mix(df)[0]).items()})
    seq.sort(key=lambda x: (x.slot, x.at))
    place = defaultdict(int)
    for x in seq:
        assert x.at == place[x.slot] and 0 < x.words <= mixing.BLOCK_WORDS          # a slot is filled without gaps
        place[x.slot] += x.words
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    goal = mixing.targets(dict(sizes))
    total, upto = sum(goal.values()), Counter()
    for slot in range(max(place) + 1):
        for x in (y for y in seq if y.slot == slot):
            upto[x.source] += x.words
        if slot % 64 == 63:
            done = sum(upto.values())
            # a van der Corput prefix is off by at most log2(slots) / 2 + 1 slots
            assert all(abs(upto[s] - done * g / total) <= mixing.BLOCK_WORDS * (math.log2(slot + 1) / 2 + 2) for s, g in goal.items())
    assert mixing.sequence(spark.createDataFrame([], DOCS)).count() == 0


def _taken(rows):
    out = Counter()
    for x in rows.collect():
        out[x.doc_id, x.tie] += x.taken
    return out


# -------------------------------------------------------------------- html --
PAGE = """<html><head><title>T</title></head><body><nav><ul><li><a href=a>Home</a><li><a href=b>About us and more.</a></ul></nav>
<article><h1>Headline</h1><div>By Jane</div><p>First sentence of the text, which goes on for a while. <p>Second one.
<aside><p>Read this other long piece too, it is a fine one.</p></aside><figure><figcaption>A caption</figcaption></figure><p>Third.</article>
<section class=comments><p>A reader wrote a long comment here, with a full stop.</p><p>Another one did so, too.</p></section>
<div class="ad-box">Buy this now, it is really good.</div><footer>Imprint</footer></body></html>"""
TEXT = "Headline\nBy Jane\nFirst sentence of the text, which goes on for a while.\nSecond one.\nA caption\nThird."


def best_labels(unary, edges):
    n, best = len(unary), (math.inf, None)
    for m in range(1 << n):
        lab = [bool(m >> i & 1) for i in range(n)]
        price = sum(max(0, u) if not x else max(0, -u) for u, x in zip(unary, lab))
        for (i, j), c in edges.items():
            a, b = c if isinstance(c, tuple) else (c, c)
            price += a if lab[i] and not lab[j] else b if lab[j] and not lab[i] else 0
        best = min(best, (price, lab), key=lambda x: x[0])
    return best


def test_directed_cut_is_least():
    r = random.Random(5)
    for _ in range(250):
        n = r.randint(1, 8)
        unary = [r.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): r.choice([r.uniform(0, 1.5), (r.uniform(0, 9), r.uniform(0, 1))]) for i in range(n) for j in range(n) if i < j and r.random() < 0.5}
        lab = html_text.min_cut(unary, edges)
        price = sum(max(0, u) if not x else max(0, -u) for u, x in zip(unary, lab))
        for (i, j), c in edges.items():
            a, b = c if isinstance(c, tuple) else (c, c)
            price += a if lab[i] and not lab[j] else b if lab[j] and not lab[i] else 0
        assert abs(price - best_labels(unary, edges)[0]) < 1e-6


def test_the_cut_decides_against_own_costs():
    """Paragraphs of comments, advert and sidebar look like text, byline and
    caption do not; the labels come from what holds them and stands beside them."""
    page = html_text.parse(PAGE)
    assert html_text.main_text(PAGE) == TEXT
    own = [html_text.cost(b) > 0 for b in page.blocks]
    label = html_text.min_cut(*html_text.graph(page))[:len(own)]
    assert sum(a != b for a, b in zip(own, label)) >= 6
    plain = "<body><div class=x1><p>One long paragraph of text stands here, alone.<p>Short<p>Another long paragraph of text stands here, alone.</div>"
    assert html_text.main_text(plain).split("\n")[1] == "Short"          # kept by its neighbours and its element


def test_extraction_is_the_least_cut_of_small_pages():
    r = random.Random(31)
    tags = ["div", "p", "article", "nav", "aside", "section class=comments", "main", "ul", "li", "h2"]
    texts = ["Short", "A longer sentence with many words in it, which ends here.", "<a href=x>link</a>", "Two words", "Ends."]
    for _ in range(150):
        html, depth = "", 0
        for _ in range(r.randrange(1, 7)):
            html += "".join(f"<{r.choice(tags)}>" for _ in range(r.randrange(0, 3))) + r.choice(texts)
            html += "".join(f"</{r.choice(tags).split()[0]}>" for _ in range(r.randrange(0, 3)))
        page = html_text.parse(html)
        unary, edges = html_text.graph(page)
        if len(unary) > 14:
            continue
        price, _ = best_labels(unary, edges)
        label = html_text.min_cut(unary, edges)
        mine = sum(max(0, u) if not x else max(0, -u) for u, x in zip(unary, label)) + sum(
            a if label[i] and not label[j] else b if label[j] and not label[i] else 0 for (i, j), (a, b) in edges.items())
        assert abs(mine - price) < 1e-6
        # nothing is content inside an element that is not
        n = len(page.blocks)
        assert all(not label[i] or label[j] for (i, j), (a, _) in edges.items() if j >= n and a > 1 + 2 * html_text.NEIGHBOUR)
        assert html_text.main_text(html) == "\n".join(b.text for b, x in zip(page.blocks, label) if x)


def test_weights_from_pages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", PAGE if i % 3 else "<article><p>Only text of the page, nothing else.</article><nav><li>Menu</nav>", 1)
                                   for i in range(60)] + [(100, None, None, 1), (None, "u", "", 1), (1, "u1", PAGE, 1)], "page_id long, url string, html string, text int")
    weights = html_text.learn(pages)
    by = dict(zip(html_text.FEATURES, weights))
    assert by["paragraph"] > 0 > by["linked"] and len(weights) == len(html_text.FEATURES)
    assert html_text.fit({}) == html_text.WEIGHTS and html_text.learn(pages.limit(0)) == html_text.WEIGHTS
    got = html_text.extract(pages).collect()
    assert Counter((x.page_id, x.text, x.n_chars) for x in got)[1, TEXT, len(TEXT)] == 2
    assert {x.text for x in got if x.page_id in (100, None)} == {""} and len(got) == 63
    assert html_text.extract(pages.limit(0)).count() == 0


def test_deep_and_long_pages_take_linear_time():
    began = time.perf_counter()
    assert html_text.main_text("<div>" * 20_000 + "Deep text." + "</div>" * 20_000) == "Deep text."
    html_text.main_text("".join(f"<div class=x><p>Some words here {i}." for i in range(8000)))
    assert html_text.main_text("<footer>" + "".join(f"<section><p>Some words here {i}. <a href=x>l</a>" for i in range(8000))) == ""
    assert time.perf_counter() - began < 6


# ---------------------------------------------------------------- pipeline --
@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    r = random.Random(77)
    items = [(i, prose(r, 14)) for i in range(6)] + [(9, None)]
    rows, n = [], 0

    def add(text, id_=None, source=None):
        nonlocal n
        n += 1
        rows.append((n * 3 if id_ is None else id_, text, r.choice(["en", None]), source or r.choice(["s1", "s1", "s1", "s2", "ü", None]), 1))
    for _ in range(40):
        base = prose(r, r.choice([15, 60, 200]))
        add(base)
        if r.random() < 0.3:
            add(base)
        if r.random() < 0.3:
            add(edit(r, base, 1))
    for i, t in items[:4]:
        add(prose(r, 20) + " " + t + " " + prose(r, 20))                    # holds a benchmark passage
        add(prose(r, 20) + " " + t.upper().replace("A", "q", 1) + ".")
    for bad in (None, "", "too short", "spam spam " * 40, "!!! " * 60, "ГРОМКО ВСЕ СЛОВА " * 9, "# $ % & " * 30):
        add(bad)
    same = prose(r, 70)
    add(same, id_=1), add(same, id_=1), add(prose(r, 70), id_=1)             # equal ids, equal and other texts
    add("Über die schönen Wörter, naïve façade: " + prose(r, 40) + " 東京 ёлка")
    add("<|endoftext|> " + prose(r, 30))
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages_equal_plain_versions(spark, corpus):
    d, rows, items = corpus
    stage = dict(corpus_pipeline.STAGES)
    frame = lambda x: spark.createDataFrame(x, DOCS)
    out = lambda df: Counter(map(tuple, df.collect()))
    # quality: no rule rejects the text
    good = [x for x in rows if not any(test(quality.Text((x[1] or "").encode())) for _, test in quality.RULES.values())]
    assert out(stage["quality"](spark, frame(rows), d)) == Counter(good) and 0 < len(good) < len(rows)
    # near_dedup: the smallest id of each class, one row of equal id and words
    cls, _ = components([x[1] for x in good], dart_minhash.SIMILARITY)
    least = {}
    for x, c in zip(good, cls):
        least[c] = min(least.get(c, (math.inf,)), (x[0],))
    kept = out(stage["near_dedup"](spark, frame(good), d))
    assert Counter((x[0], c) for x, c in ((x, cls[good.index(x)]) for x in kept.elements())) == Counter((i[0], c) for c, i in least.items())
    assert not kept - Counter(good)
    unique = sorted(kept.elements(), key=str)
    # decontaminate: no item by a full scan
    clean = [x for x in unique if not found_plainly(x[1], items)]
    assert out(stage["decontaminate"](spark, frame(unique), d)) == Counter(clean) and 0 < len(clean) < len(unique)
    # mix: as often as the sequence takes the words, rounded half up
    words = Counter()
    for x in mixing.sequence(frame(clean)).collect():
        words[x.doc_id, x.tie, x.source] += x.words
    tie = {(x.doc_id, x.text): x.t for x in frame(clean).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    want = Counter()
    for x in clean:
        want[x] += math.floor(words[x[0], tie[x[0], x[1]], x[3]] / len(x[1].split()) + 0.5)
    mixed = out(stage["mix"](spark, frame(clean), d))
    assert mixed == +want and max(mixed.values()) <= 3
    # tokens: ids of the library, documents in id order
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = sorted(stage["tokens"](spark, frame(list(mixed.elements())), d).collect(), key=lambda x: x.start)
    crc = Counter()
    for x in mixed.elements():
        ids = np.array(tok.encode(x[1], add_special_tokens=False).ids + [2], "<u4")
        crc[x[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in last) == crc
    assert [x.doc_id for x in last] == sorted(x.doc_id for x in last)
    assert [x.start for x in last] == list(np.cumsum([0] + [x.n_tokens for x in last])[:-1])
    # run(): the stages one after the other
    whole = Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in corpus_pipeline.run(spark, d).collect())
    assert whole == crc


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    d, _, _ = corpus
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_but_the_last_stage_keep_the_columns(spark, corpus):
    d, rows, _ = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame(rows[:30], DOCS), d).columns == [c.split()[0] for c in DOCS.split(", ")]
