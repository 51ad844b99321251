"""Operator 5: main text of a page by minimum-cut labelling of its blocks.

A page is read into blocks of text (runs of text between block-level tags) and
the tree of the elements that hold them.  Blocks and elements are the nodes of
one graph; a cut gives each the label content or boilerplate.

* Terminal capacities: a block's cost is a linear classifier of its words, end,
  links and tag, with weights fitted on a bounded sample of pages, where blocks
  in elements of known meaning are the examples.  An element's cost is what its
  own tag and names say, once for every block that it holds.
* Smoothness: neighbouring blocks, and each block or element with the element
  that holds it.  The latter are directed: boilerplate inside content costs a
  little, content inside boilerplate more than the content can be worth.

So a menu takes its paragraphs with it, a short caption stays with the article
around it, and the cut decides every block from all of this at once.  Nodes whose
own cost outweighs all their edges are fixed first, which keeps the cut exact.

Defined cases: null and empty pages give an empty text; repeated rows give
equal rows; a null id or url is kept; other columns are not read; unclosed
tags, comments and scripts end with the page; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                       "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
                       "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template iframe object svg math textarea title button select canvas audio video".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: An opening tag of the key closes an open element of the value.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
for _t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split():
    CLOSES.setdefault(_t, {"p"})
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BAD_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|captcha|cookies?|comments?|consent|disqus|footer|header|"
                       r"login|masthead|menu|modal|nav\w*|newsletter|notice|pagination|popup|promo\w*|related|replies|search|share|"
                       r"sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?:$|[\s_-])", re.I)
#: What an element's tag says about each block in it (positive: content).
HOLDER = {"article": 4.0, "main": 3.0, "nav": -9.0, "footer": -8.0, "header": -6.0, "aside": -8.0, "form": -7.0, "menu": -8.0,
          "dialog": -8.0, "head": -20.0, "fieldset": -6.0, "figcaption": 0.5}
BAD_NAME, GOOD_NAME = -8.0, 2.0
NEIGHBOUR = 0.6                   # two blocks that follow one another with different labels
HOLDS, CONTAINS = 1.5, 0.5        # a boilerplate block, or element, in an element that is content
FEATURES = ("bias", "words", "sentence", "linked", "heading", "paragraph", "item")
#: Weights before any page is seen, and how many blocks they are worth in the fit.
WEIGHTS = (-0.8, 1.5, 0.5, -3.0, 0.0, 0.0, 0.0)
PRIOR = 30.0
LIMIT = 4.0                       # largest cost of a block
SAMPLE_PAGES = 2000
_TAG_KIND = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 1), "p": 2, "blockquote": 2, "pre": 2,
             **dict.fromkeys(("li", "td", "th", "dd", "dt", "option"), 3)}


class Block:
    __slots__ = ("text", "holder", "linked", "kind")

    def __init__(self, text, holder, linked, kind):
        self.text, self.holder, self.linked, self.kind = text, holder, linked, kind

    def traits(self) -> tuple[int, int, int, int]:
        """Words (up to 12), ends like a sentence, mostly links, kind of tag."""
        return (min(self.text.count(" ") + 1, 12), int(self.text[-1] in ".!?\"'”’:;…"), int(self.linked > 0.5), self.kind)


class Page:
    """Blocks in page order; per element its parent and what its tag and names say."""

    def __init__(self):
        self.blocks, self.parent, self.evidence = [], [-1], [0.0]


def vector(traits) -> list[float]:
    words, sentence, linked, kind = traits
    return [1.0, words / 12, sentence, linked, float(kind == 1), float(kind == 2), float(kind == 3)]


def parse(html: str) -> Page:
    page, parts, linked = Page(), [], 0
    stack = [("html", 0)]                    # name, element number
    in_link, at = 0, 0

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            name, element = stack[-1]
            page.blocks.append(Block(text, element, min(1.0, linked / len(text)), _TAG_KIND.get(name, 0)))
        parts, linked = [], 0

    def take(text):
        nonlocal linked
        if text:
            if "&" in text:
                text = unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text.strip())
    end = len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            take(html[at:])
            break
        take(html[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = m[1] == "/"
        if not closing and name in SILENT:
            if not m[0].endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(html, at)
                at = close.end() if close else end
            if name in BLOCK_TAGS:
                flush()
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        if name not in BLOCK_TAGS:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    in_link = 0
                    break
            continue
        if name in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[name]:
                    del stack[i:]
                    break
                if stack[i][0] not in ("p", "td", "th", "dt", "dd", "option"):
                    break
        if name in VOID:
            continue
        said = HOLDER.get(name, 0.0)
        for names in _NAMES.findall(m[3]) if m[3] else ():
            names = "".join(names)
            if _BAD_NAME.search(names):
                said = min(said, BAD_NAME)
            elif said >= 0 and _GOOD_NAME.search(names):
                said = max(said, GOOD_NAME)
        stack.append((name, len(page.parent)))
        page.parent.append(stack[-2][1])
        page.evidence.append(said)
    flush()
    return page


def cost(b: Block, weights=WEIGHTS) -> float:
    """Cost of leaving the block out, less the cost of keeping it, for itself."""
    return max(-LIMIT, min(LIMIT, sum(w * x for w, x in zip(weights, vector(b.traits())))))


def examples(page: Page):
    """(traits, label) of the blocks in elements of known meaning: 0 where some
    element around says boilerplate, 1 where one says content and none the other."""
    good, bad = [], []
    for parent, said in zip(page.parent, page.evidence):        # a parent comes before its children
        good.append(said >= 3 or parent >= 0 and good[parent])
        bad.append(said <= -6 or parent >= 0 and bad[parent])
    for b in page.blocks:
        if bad[b.holder] or good[b.holder]:
            yield b.traits(), int(not bad[b.holder])


def fit(counts: dict, prior=WEIGHTS, strength: float = PRIOR) -> tuple[float, ...]:
    """Logistic regression on (traits, label) -> number of blocks, held to
    ``prior`` as by ``strength`` blocks; Newton's method."""
    w = start = np.array(prior, float)
    if counts:
        x = np.array([vector(t) for t, _ in counts], float)
        y = np.array([label for _, label in counts], float)
        n = np.array(list(counts.values()), float)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (y - p)) - strength * (w - start)
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), slope)
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
    return tuple(float(v) for v in w)


def learn(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> tuple[float, ...]:
    """Weights of the block costs from about ``sample_pages`` pages, chosen by a
    hash of the whole row.  Only numbers of blocks by traits reach the driver."""
    total = pages.count()
    every = max(1, -(-total // sample_pages))
    rows = pages.where(F.pmod(F.xxhash64(*pages.columns), F.lit(every)) == 0).select(F.col(html_col).cast("string").alias("html"))
    names = ["words", "sentence", "linked", "kind", "label"]

    def count(batches):
        found: dict = {}
        for b in batches:
            for html in as_text(b.column(0)):
                for traits, label in examples(parse(html)):
                    found[*traits, label] = found.get((*traits, label), 0) + 1
        columns = list(zip(*found)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(list(found.values()), pa.int64())], [*names, "n"])
    seen = rows.mapInArrow(count, ", ".join(f"{c} int" for c in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))
    return fit({(tuple(r[:4]), r[4]): r["n"] for r in seen.collect()})


def _max_flow(n: int, unary: list[float], edges: dict) -> list[bool]:
    """Source side of a minimum cut (Dinic).  ``edges``: (i, j) -> capacities i to j and j to i."""
    s, t = n, n + 1
    to, cap, adj = [], [], [[] for _ in range(n + 2)]

    def add(u, v, c, back):
        adj[u].append(len(to))
        to.append(v)
        cap.append(c)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)
    for i, u in enumerate(unary):
        if u > 0:
            add(s, i, u, 0.0)
        elif u < 0:
            add(i, t, -u, 0.0)
    for (i, j), (c, back) in edges.items():
        add(i, j, c, back)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path, u = [], s
        while True:                           # blocking flow, without recursion
            if u == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(adj[u]):
                e = adj[u][nxt[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(adj[u]):
                path.append(adj[u][nxt[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def _reduced(unary: list[float], edges: dict) -> tuple[list, list[float], dict]:
    """Labels that follow from costs above all edges (None: open), the costs of
    the open nodes with what the fixed ones add, and the edges between them."""
    n, unary = len(unary), list(unary)
    to: list[dict] = [{} for _ in range(n)]              # to[i][j]: paid if i is content and j is not
    for (i, j), c in edges.items():
        there, back = c if isinstance(c, tuple) else (c, c)
        to[i][j] = to[i].get(j, 0.0) + there
        to[j][i] = to[j].get(i, 0.0) + back
    out = [sum(x.values()) for x in to]
    into = [0.0] * n
    for x in to:
        for j, c in x.items():
            into[j] += c
    label: list = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None:
            continue
        if not to[i]:
            label[i] = unary[i] > 0
        elif unary[i] > out[i] + 1e-9:
            label[i] = True
        elif -unary[i] > into[i] + 1e-9:
            label[i] = False
        else:
            continue
        for j in to[i]:
            there, back = to[i][j], to[j].pop(i)
            out[j] -= back
            into[j] -= there
            unary[j] += there if label[i] else -back
            todo.append(j)
        to[i] = {}
    return label, unary, {(i, j): (c, to[j][i]) for i in range(n) for j, c in to[i].items() if i < j}


def min_cut(unary: list[float], edges: dict) -> list[bool]:
    """The labelling (True: content) of least cost: a node called boilerplate
    pays max(0, unary), one called content max(0, -unary), and an edge (i, j)
    between different labels its capacity, or, if it has two, the first where i
    is the content and the second where j is."""
    label, unary, edges = _reduced(unary, edges)
    open_ = [i for i, x in enumerate(label) if x is None]
    if open_:
        place = {i: k for k, i in enumerate(open_)}
        rest = {(place[i], place[j]): c for (i, j), c in edges.items()}
        for i, keep in zip(open_, _max_flow(len(open_), [unary[i] for i in open_], rest)):
            label[i] = keep
    return label


def graph(page: Page, weights=WEIGHTS) -> tuple[list[float], dict]:
    """Costs and edges: blocks first, then the elements that hold them.  The
    page itself is content, so what it holds pays for being boilerplate."""
    blocks, parent, evidence = page.blocks, page.parent, page.evidence
    held = [0] * len(parent)
    for b in blocks:
        held[b.holder] += 1
    for e in range(len(parent) - 1, 0, -1):              # a parent has a smaller number than its children
        held[parent[e]] += held[e]
    unary = [cost(b, weights) for b in blocks]
    worth = [max(0.0, u) + 2 * NEIGHBOUR for u in unary]     # most that the node's being content can save
    node: list = [None] * len(parent)                    # of the nearest element around that is a node
    up: list = [None] * len(blocks)                      # node of what holds a node; None: the page itself
    for e in range(1, len(parent)):
        node[e] = node[parent[e]]
        if held[e] > 1 or held[e] and evidence[e]:       # else it says nothing and stands for its one block
            up.append(node[e])
            node[e] = len(unary)
            unary.append(evidence[e] * held[e])
            worth.append(max(0.0, unary[-1]))
    for i, b in enumerate(blocks):
        up[i] = node[b.holder]
    for i in [*range(len(blocks)), *range(len(unary) - 1, len(blocks) - 1, -1)]:
        if up[i] is not None:
            worth[up[i]] += worth[i]
    edges = {}
    for i, holder in enumerate(up):
        little = HOLDS if i < len(blocks) else CONTAINS
        if holder is None:
            unary[i] += little
        else:
            edges[i, holder] = (worth[i] + 1.0, little)
    for i in range(1, len(blocks)):
        edges[i - 1, i] = (NEIGHBOUR, NEIGHBOUR)
    return unary, edges


def main_text(html: str, weights=WEIGHTS) -> str:
    page = parse(html)
    if not page.blocks:
        return ""
    label = min_cut(*graph(page, weights))
    return "\n".join(b.text for b, keep in zip(page.blocks, label) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            weights: tuple[float, ...] | None = None) -> DataFrame:
    """page_id, url, text and n_chars, one row per page; no shuffle.  Without
    ``weights`` they are learned from the pages."""
    weights = weights or learn(pages, html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for b in batches:
            texts = [main_text(h, weights) for h in as_text(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
