"""Main text of web pages by gradient-boosted trees over the nodes of the page.

A page becomes a tree; each node is described by its tag, the words of its
attributes, its depth, how dense its subtree's text and links are, and how it
compares with its siblings.  Boosted trees, trained on a bounded sample of pages
whose own markup tells the article from the rest, give each node a probability.
Decoding is over the whole tree: below a node that is dropped nothing is kept,
so ancestors and descendants never contradict each other.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table, trim

#: Bounds of the training sample: pages, and characters of a page.
SAMPLE_PAGES = 400
MAX_CHARS = 100_000
ROUNDS, DEPTH, BINS, RATE = 40, 3, 32, 0.3

#: What stands in a tag behind its name; a "<" outside quotes ends the attempt.  The count keeps broken markup cheap:
#: what it stops is read again by _ends, once for the whole page, so no number of attributes changes a result.
_INSIDE = r"(?:[^<>\"']++|\"[^\"]*\"|'[^']*'){0,500}+"
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)|<(script|style|textarea|xmp|iframe|noembed|noframes)\b{_INSIDE}>(?:.*?</\1\s*>|.*)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({_INSIDE})>|<[!?][^<>]*>|([^<]+|<)",
    re.S | re.I,
)
#: The start of a tag, for one that has more inside than _INSIDE counts.
_OPENS = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
_RAW = frozenset("script style textarea xmp iframe noembed noframes".split())
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - frozenset("br button head html body option select title td th tr tbody thead tfoot legend summary".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_HOLDS = frozenset("ul ol dl table select body html".split())
#: Words of attributes that speak for or against a node; also the markup that the training labels rest on.
_FOR = re.compile(r"article|content|post|entry|story|main|body|text|prose", re.I)
_AGAINST = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|head(?:er)?|foot(?:er)?|side(?:bar)?|aside|comments?|disqus|repl(?:y|ies)|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|signup|share|social|related|recommend\w*|breadcrumbs?|pag(?:er|ination)|widget\w*|login|search|form|copyright|legal)(?:$|[-_\s\d])", re.I)
_AWAY = frozenset("nav header footer aside form script style noscript template button select option dialog head title label fieldset menu".split())
TAGS = "p div article main section h1 h2 li ul a span b td nav header footer aside form body head title blockquote pre".split()
N_FEATURES = len(TAGS) + 16


@dataclass
class Page:
    tag: list[str] = field(default_factory=lambda: ["#"])
    attrs: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # node, block, raw text


def _ends(source: str) -> tuple[list[int], list[int]]:
    """All quotes and angle brackets, and for each where a tag ends that is read from there outside quotes (-1: it never does)."""
    marks = [m.start() for m in re.finditer("[<>\"']", source)]
    ends = [-1] * (len(marks) + 1)
    after = {'"': len(marks), "'": len(marks)}
    for i in range(len(marks) - 1, -1, -1):
        c = source[marks[i]]
        if c == ">":
            ends[i] = marks[i]
        elif c != "<":
            ends[i] = ends[after[c] + 1] if after[c] < len(marks) else -1
            after[c] = i
    return marks, ends


def parse(source: str) -> Page:
    """The nodes of a page in page order; broken markup never fails."""
    page = Page()
    stack = [0]
    open_tags: Counter[str] = Counter()
    block = 0

    def close_from(k: int) -> None:
        open_tags.subtract(page.tag[n] for n in stack[k:])
        del stack[k:]

    at, ends = 0, None
    while at < len(source):
        m = _TOKEN.match(source, at)
        raw, close, tag, attrs, text = m[1], m[2], m[3], m[4], m[5]
        start, at = at, m.end()
        if text == "<" and (m := _OPENS.match(source, start)):
            ends = ends or _ends(source)
            end = ends[1][bisect_left(ends[0], m.end())]
            if end >= 0:  # a tag of very many attributes
                close, tag, attrs, text, at = m[1], m[2], source[m.end() : end], None, end + 1
                if tag.lower() in _RAW and not close:
                    over = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = over.end() if over else len(source)
                    continue
        if text is not None:
            page.texts.append((stack[-1], block, text))
            continue
        if raw or tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            block += 1
        if close:
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while page.tag[stack[k]] != tag:
                    k -= 1
                close_from(k)
            continue
        if tag in _CLOSES_P and open_tags["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] == "p":
                    close_from(k)
                    break
                if page.tag[stack[k]] in _CLOSES_P or page.tag[stack[k]] in ("td", "th", "button"):
                    break
        if tag in _SAME and any(open_tags[t] > 0 for t in _SAME[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] in _SAME[tag]:
                    close_from(k)
                    if tag != "tr":
                        break
                elif page.tag[stack[k]] in _HOLDS:
                    break
        node = len(page.tag)
        page.tag.append(tag)
        page.attrs.append(" ".join(x for y in _ATTR.findall(attrs) for x in y if x) if attrs.strip() else "")
        page.parent.append(stack[-1])
        if tag not in _VOID and not attrs.endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    return page


def describe(page: Page) -> np.ndarray:
    """Features of each node: nodes x N_FEATURES."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, marks = np.zeros(n), np.zeros(n)
    for node, _, t in page.texts:
        s = t.strip()
        own[node] += len(s)
        marks[node] += s.count(".") + s.count(",")
    total, stops, links, size, paras = own.copy(), marks.copy(), np.zeros(n), np.ones(n), np.zeros(n)
    depth, kids, place = np.zeros(n), np.zeros(n), np.zeros(n)
    against, for_ = np.zeros(n), np.zeros(n)
    for i in range(n):
        if i:
            p = page.parent[i]
            depth[i] = depth[p] + 1
            place[i] = kids[p]
            kids[p] += 1
            against[i] = 1.0 if page.attrs[i] and _AGAINST.search(page.attrs[i]) else 0.0
            for_[i] = 1.0 if page.attrs[i] and _FOR.search(page.attrs[i]) else 0.0
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        if page.tag[i] == "a":
            links[i] = total[i]
        paras[i] += page.tag[i] == "p"
        total[p] += total[i]
        stops[p] += stops[i]
        links[p] += links[i]
        size[p] += size[i]
        paras[p] += paras[i]
    up_against, up_away = against.copy(), np.array([float(t in _AWAY) for t in page.tag])
    up_for = np.maximum(for_, [float(t in ("article", "main")) for t in page.tag])
    for i in range(1, n):
        p = page.parent[i]
        up_against[i] = max(up_against[i], up_against[p])
        up_away[i] = max(up_away[i], up_away[p])
        up_for[i] = max(up_for[i], up_for[p])
    whole = max(total[0], 1.0)
    out = np.zeros((n, N_FEATURES))
    index = {t: k for k, t in enumerate(TAGS)}
    for i, t in enumerate(page.tag):
        if t in index:
            out[i, index[t]] = 1.0
    sib = np.maximum(kids[parent], 1)
    sib_text = total[parent]
    out[:, len(TAGS) :] = np.column_stack([
        against, for_, up_against, up_away, up_for, depth, np.log1p(own), np.log1p(total), links / np.maximum(total, 1), stops / np.maximum(total, 1) * 100,
        np.log1p(total / size), total / whole, np.log1p(paras), np.log1p(kids), place / sib, total / np.maximum(sib_text, 1),
    ])
    return out


def own_labels(page: Page) -> np.ndarray | None:
    """What the page's own markup says of its nodes; None if it marks no article."""
    n = len(page.tag)
    inside, away = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for i in range(n):
        p = page.parent[i] if i else 0
        here = page.tag[i] in ("article", "main") or bool(re.search(r"(?:^|\s)(?:article|post|entry|main)?-?(?:content|body|main|article)(?:$|\s)", page.attrs[i], re.I))
        inside[i] = inside[p] or here
        away[i] = away[p] or page.tag[i] in _AWAY or bool(_AGAINST.search(page.attrs[i]))
    return (inside & ~away).astype(float) if (inside & ~away).any() else None


def dense_labels(page: Page) -> np.ndarray | None:
    """For pages without marks: the nodes below the one whose own text and child blocks hold the most text outside links; None without text.

    Menus are links, notices and adverts short blocks of their own; an article is one
    node with many blocks of text.
    """
    n = len(page.tag)
    linked, away, near = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    for i in range(1, n):
        p = page.parent[i]
        linked[i] = linked[p] or page.tag[i] == "a"
        away[i] = away[p] or page.tag[i] in _AWAY
        near[i] = i if page.tag[i] in _BLOCK else near[p]
    text = np.zeros(n)
    for node, _, t in page.texts:
        if not linked[node] and not away[node]:
            text[near[node]] += len(t.strip())
    mass = text.copy()
    for i in range(1, n):
        if near[i] == i and text[i]:
            mass[near[page.parent[i]]] += text[i]
    if not mass.any():
        return None
    out, best = np.zeros(n), int(mass.argmax())
    out[best] = 1.0
    for i in range(best + 1, n):
        out[i] = float(out[page.parent[i]] > 0 and not away[i])
    return out


@dataclass
class Trees:
    base: float
    edges: list[np.ndarray]
    trees: list[list[tuple[int, int, float]]]  # each a full binary tree: feature or -1, bin, value


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]).astype(np.int16)


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting with logistic loss and second-order leaf values over binned features."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    edges = [np.unique(np.concatenate([e, [(x[:, k].min() + x[:, k].max()) / 2]])) for k, e in enumerate(edges)]
    b = _bins(x, edges)
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(p0 / (1 - p0))), edges, [])
    f = np.full(len(y), model.base)
    width = BINS + 2
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        tree: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (DEPTH + 1) - 1)
        members = {0: np.arange(len(y))}
        for node in range(len(tree)):
            rows = members.pop(node, None)
            if rows is None:
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            tree[node] = (-1, 0, RATE * gs / (hs + 1.0))
            if node >= 2**DEPTH - 1 or len(rows) < 10:
                continue
            best = (1e-3, -1, 0)
            for k in range(x.shape[1]):
                gl = np.cumsum(np.bincount(b[rows, k], weights=g[rows], minlength=width))[:-1]
                hl = np.cumsum(np.bincount(b[rows, k], weights=h[rows], minlength=width))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, at)
            if best[1] >= 0:
                left = b[rows, best[1]] <= best[2]
                if left.any() and not left.all():
                    tree[node] = (best[1], best[2], 0.0)
                    members[2 * node + 1], members[2 * node + 2] = rows[left], rows[~left]
        model.trees.append(tree)
        f += _walk(tree, b)
    return model


def _walk(tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
    feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
    at = np.zeros(len(b), dtype=np.int64)
    rows = np.arange(len(b))
    for _ in range(DEPTH):
        k = feature[at]
        inner = k >= 0
        right = b[rows, np.maximum(k, 0)] > cut[at]
        at = np.where(inner, 2 * at + 1 + right, at)
    return value[at]


def log_odds(model: Trees | None, x: np.ndarray) -> np.ndarray:
    if model is None:  # nothing to learn from: the attribute and tag features alone
        k = len(TAGS)
        return np.where((x[:, k + 2] > 0) | (x[:, k + 3] > 0), -2.0, 2.0)
    b = _bins(x, model.edges)
    f = np.full(len(x), model.base)
    for t in model.trees:
        f += _walk(t, b)
    return f


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest labelling in which nothing is kept below a node dropped from kept text.

    States: before the article (a child may start it), in it, dropped (so are all below).
    """
    n = len(page.tag)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best = np.column_stack([no, yes, no])
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        before, within, gone = best[i]
        best[p, 0] += max(before, within)
        best[p, 1] += max(within, gone)
        best[p, 2] += gone
    state = np.zeros(n, dtype=np.int8)
    state[0] = int(best[0, :2].argmax())
    for i in range(1, n):
        s = state[page.parent[i]]
        state[i] = (0 if best[i, 0] >= best[i, 1] else 1) if s == 0 else (1 if best[i, 1] >= best[i, 2] else 2) if s == 1 else 2
    return state == 1


def render(page: Page, keep: np.ndarray) -> str:
    """Kept text: references decoded, white space in a block one space, blocks joined by a line end."""
    out: list[str] = []
    last = None
    for node, block, text in page.texts:
        if keep[node]:
            if block == last:
                out[-1] += text
            else:
                out.append(text)
                last = block
        elif block != last:
            last = None
    return "\n".join(s for s in (" ".join(entities.unescape(t).split()) for t in out) if s)


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Trees | None:
    """Trees from the pages (at most ``sample``, smallest hashes first) that mark their article.

    Where no page does, all of them are labelled by their densest node; None without any text.
    """
    short = pages.select("html", F.xxhash64("html").alias("h")).filter(F.char_length("html").between(1, MAX_CHARS))
    # the hashes first, so that no task sends whole pages that aren't taken; copies of a page count once
    picked = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = short.filter(F.col("h") <= max(picked)).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").collect() if picked else []
    xs, ys = [], []
    rng = np.random.default_rng(7)
    parsed = [parse(r["html"]) for r in rows]
    labels = [own_labels(page) for page in parsed]
    if all(y is None for y in labels):
        labels = [dense_labels(page) for page in parsed]
    for page, y in zip(parsed, labels, strict=True):
        if y is None:
            continue
        x = describe(page)
        xs.append(x)
        ys.append(y)
        # the same page without telling tags, so that text and links must decide
        blind = x.copy()
        k = len(TAGS)
        for t in ("article", "main", "nav", "header", "footer", "aside", "form"):
            blind[:, TAGS.index(t)] = 0
        blind[:, k : k + 5] *= rng.random() < 0.3
        xs.append(blind)
        ys.append(y)
    if not xs or not 0 < np.concatenate(ys).mean() < 1:
        return None
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, model: Trees | None) -> DataFrame:
    """page_id, url, text and n_chars of every page; null or empty html gives an empty text.

    Equal pages give equal texts and repeated rows stay; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                trees = [parse(t or "") for t in b["html"].to_pylist()]
                x = [describe(t) for t in trees]
                odds = log_odds(model, np.concatenate(x))
                texts, k = [], 0
                for t in trees:
                    n = len(t.tag)
                    texts.append(render(t, decode(t, odds[k : k + n])))
                    k += n
                yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        trim()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
