"""Benchmark decontamination by latent semantic retrieval.

Texts and benchmark items become TF-IDF passages over hashed words.  A
distributed randomised SVD of all passages with all items gives
a latent space; every passage of every document is compared with every item
there by cosine.  Also taken, whatever the cosine, is every passage around which
half of an item's telling words stand, from an exact inverted index of these words.
What is taken is checked on the words themselves: the longest common subsequence
with the item around the passage, and whether the item's telling words (its
answer) occur there.  The index leaves out nothing that these checks would accept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import MARKS, array_sum, fresh, ids_and_text, split, table, trim, word_hashes, written

BUCKETS_LOG2 = 16
#: Directions of the latent space: an item in sixteen, within these bounds.
RANKS = (64, 256)
HALF = 16  # words; a passage is two halves, and passages overlap by one
#: The space is fitted on all documents and items, by a task for so many words (at least one a core): each sends an array over all buckets.
FIT_WORDS = 40_000_000
GROUP = 64  # words of a bucket summed at once
BLOCK = 1 << 17  # numbers of the sums that are worked on at once
ITEMS = 4000  # items a pass over the documents
#: Cosine from which a passage is near an item: COSINE, or for items far shorter than a passage SHORT times the
#: root of their share of it.  Measured (README): each finds 0.9 or more of planted items, also with 40 % of the words changed.
COSINE = 0.25
SHORT = 0.3
LCS = 0.6
ANSWER = 0.5


@dataclass
class Space:
    idf: np.ndarray
    basis: np.ndarray  # buckets x rank, rows scaled by idf
    values: np.ndarray  # of the sketch, by direction


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words without ASCII marks, and where each text's begin."""
    return word_hashes([t.lower() for t in texts], MARKS)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of each bucket's words in all documents."""

    def of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64)
        for b in batches:
            texts = b["text"].to_pylist()
            for a, z in split(texts):
                total += np.bincount(_bucket(_words(texts[a:z])[0]), minlength=len(total))
        return total

    return array_sum(ids_and_text(docs).select("text"), of, 1 << BUCKETS_LOG2).astype(np.float64)


def _halves(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the half passages of texts whose words begin at ``at``, and the text of each."""
    n = np.diff(at)
    per = -(-n // HALF)
    doc = np.repeat(np.arange(len(n)), per)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    return at[:-1][doc] + (np.arange(per.sum()) - first[doc]) * HALF, doc


def passages(vectors: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the vectors of each passage (a half and the next one of its text), and its text."""
    if not len(starts):
        return np.zeros((0, vectors.shape[1]), dtype=vectors.dtype), doc
    sums = np.add.reduceat(vectors, starts, axis=0)
    nexts = np.zeros_like(sums)
    same = doc[1:] == doc[:-1]
    nexts[:-1][same] = sums[1:][same]
    return sums + nexts, doc


def run_sums(vectors: np.ndarray, rows: np.ndarray, starts: np.ndarray, group: int = HALF) -> np.ndarray:
    """Sums of the vectors of these rows in runs (none empty) that begin at ``starts``.

    Runs are cut into pieces of ``group`` rows.  Blocks of pieces, the longest first, add
    up their first rows, their second ones and so on: each row is read once, and the sums
    of a block stay in a core's cache.
    """
    n = np.diff(np.append(starts, len(rows)))
    per = -(-n // group)
    begin = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(starts - begin[:-1] * group, per) + np.arange(begin[-1]) * group
    size = np.minimum(np.repeat(starts + n, per) - first, group)
    order = np.argsort((group - size).astype(np.uint16), kind="stable")
    width = vectors.shape[1]
    out = np.empty((len(first), width), dtype=vectors.dtype)
    step = max(64, BLOCK // width)
    total, more = (np.empty((min(step, len(first)), width), dtype=vectors.dtype) for _ in range(2))
    for i in range(0, len(first), step):
        own = order[i : i + step]
        at, left = first[own], size[own]
        k = len(own)
        np.take(vectors, rows[at], axis=0, out=total[:k], mode="clip")
        longer = k - np.searchsorted(left[::-1], np.arange(1, left[0]), side="right")
        for j, k in enumerate(longer.tolist(), 1):
            np.take(vectors, rows[at[:k] + j], axis=0, out=more[:k], mode="clip")
            total[:k] += more[:k]
        out[own] = total[: len(own)]
    if len(out) == len(starts):
        return out
    sums = out[begin[:-1]]
    cut = np.flatnonzero(per > 1)
    ends = np.cumsum(per[cut])
    pieces = np.repeat(begin[cut] - (ends - per[cut]), per[cut]) + np.arange(ends[-1])
    sums[cut] = run_sums(out, pieces, ends - per[cut], group)
    return sums


def _next_to(sums: np.ndarray, doc: np.ndarray, by: int) -> np.ndarray:
    """Each half's neighbour ``by`` (1 or -1) halves on in its text, else zeros."""
    out = np.zeros_like(sums)
    to, of = (slice(None, -1), slice(1, None)) if by > 0 else (slice(1, None), slice(None, -1))
    out[to] = sums[of]
    out[to][doc[1:] != doc[:-1]] = 0
    return out


def texts_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """All texts, on which the space is fitted, and their number."""
    return ids_and_text(docs).select("text"), docs.count()


sample_of = texts_of  # its name when a part of the texts was taken


def rank_of(items: int) -> int:
    return min(max(RANKS[0], items // 16), RANKS[1])


def fit(counts: np.ndarray, texts: DataFrame, n: int, items: list[str], rank: int | None = None) -> Space:
    """The latent space of ``n`` texts and the items: the range that one power iteration finds from a random start, in one pass over the texts.

    ``counts``: word_counts() of the documents.
    """
    rank = rank or rank_of(len(items))
    words = counts.sum()
    own = np.bincount(_bucket(_words(items)[0]), minlength=len(counts)) if items else np.zeros(len(counts))
    counts = counts + own
    idf = np.log1p(counts.sum() / np.maximum(counts, 1)).astype(np.float32)
    idf = idf - min(float(idf.min()), float(idf.max()) - 1)
    width = 1 << BUCKETS_LOG2

    def start() -> np.ndarray:
        """The same in every task and on the driver, so that it isn't sent."""
        q = np.random.default_rng(11).standard_normal((width, rank), dtype=np.float32)
        q *= idf[:, None]
        return q

    def back(texts: list[str], q: np.ndarray, out: np.ndarray, weight: float) -> None:
        """out += weight A' (A q) for the passages A of the texts, without the idf on the left."""
        h, at = _words(texts)
        if not len(h):
            return
        b = _bucket(h)
        starts, doc = _halves(at)
        y = run_sums(q, b, starts)
        y += _next_to(y, doc, 1)
        # each word belongs to its half's passage and the one before
        y += _next_to(y, doc, -1)
        half = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(b))))
        order = np.argsort(b.astype(np.uint16), kind="stable")
        named = b[order]
        first = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
        out[named[first]] += run_sums(y, half[order], first, GROUP) * np.float32(weight)

    def of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        q, out = start(), np.zeros((width, rank), dtype=np.float32)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, z in split(texts, 2_000_000):
                back(texts[a:z], q, out, 1.0)
        out *= idf[:, None]
        return out

    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, int(-(-words // FIT_WORDS)))
    total = array_sum(texts.coalesce(tasks), of, width * rank, real=True).reshape(width, rank)
    extra = np.zeros_like(total)
    # the items must be told apart: as a whole they weigh as much as the texts
    back(items, start(), extra, max(1.0, 8 * n / max(len(items), 1)))
    extra *= idf[:, None]
    total += extra
    del extra
    values = orthonormal(total)
    total *= idf[:, None]
    trim()
    return Space(idf, total, values)


def orthonormal(y: np.ndarray) -> np.ndarray:
    """Turns the columns, in place, into orthonormal ones of the same range (zeros beyond it), the greatest first; gives their singular values.

    By blocks of rows, so that the driver holds no second array of this size.
    """
    blocks = [slice(i, i + 4096) for i in range(0, len(y), 4096)]
    corner = np.linalg.qr(np.vstack([np.linalg.qr(y[b].astype(np.float64), mode="r") for b in blocks]), mode="r")
    _, values, turn = np.linalg.svd(corner)
    turn = turn.T / np.where(values > 1e-7 * values[0], values, np.inf)
    for b in blocks:
        y[b] = y[b] @ turn
    return values


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, on whole machine words of bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        if m := where.get(y):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


class Searcher:
    def __init__(self, space: Space, items: list[tuple[int, str]]):
        self.space = space
        h, at = _words([t for _, t in items])
        self.ids, self.words, self.telling, vectors = [], [], [], []
        for i, (item, _) in enumerate(items):
            own = h[at[i] : at[i + 1]]
            if not len(own):
                continue
            b = _bucket(own)
            # an item's answer: the rarest quarter of its different words
            names, first = np.unique(own, return_index=True)
            rare = names[np.argsort(-space.idf[_bucket(names)], kind="stable")[: max(1, len(names) // 4)]]
            # a long item is searched by each of its passages
            starts, doc = _halves(np.array([0, len(own)]))
            for v in passages(space.basis[b], starts, doc)[0]:
                self.ids.append(item)
                self.words.append(own.tolist())
                self.telling.append(set(rare.tolist()))
                vectors.append(v)
        pairs = sorted((w, i) for i, x in enumerate(self.telling) for w in x)
        self.telling_all, first = np.unique(np.array([w for w, _ in pairs], dtype=np.uint64), return_index=True)
        self.telling_ends = np.append(first, len(pairs)).astype(np.int64)
        self.telling_rows = np.array([i for _, i in pairs], dtype=np.int64)
        self.telling_bucket = np.zeros(1 << BUCKETS_LOG2, dtype=bool)
        self.telling_bucket[_bucket(self.telling_all)] = True
        self.told = np.array([int(np.ceil(ANSWER * len(x))) for x in self.telling], dtype=np.int64)
        # words on each side of a passage in which the item is looked for, and the halves that these reach into
        self.more = np.array([max(HALF, len(w) - HALF) for w in self.words], dtype=np.int64)
        self.halves = -(-self.more // HALF)
        self.reach = 2 + -(-max(map(len, self.words), default=0) // HALF)
        # a short item is but a part of any passage that holds it
        self.least = np.minimum(COSINE, SHORT * np.sqrt(np.array([len(w) for w in self.words]) / (2 * HALF))).astype(np.float32)
        self.matrix = np.array(vectors, dtype=np.float32).reshape(len(vectors), space.basis.shape[1])
        self.matrix /= np.maximum(np.linalg.norm(self.matrix, axis=1, keepdims=True), 1e-9)

    def candidates(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item row, words around) of near passages, then of those around which the index has the item's telling words."""
        h, at = _words(texts)
        if not len(h) or not len(self.ids):
            return
        starts, doc = _halves(at)
        p = run_sums(self.space.basis, _bucket(h), starts)
        p += _next_to(p, doc, 1)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        # an item's answer needs its telling words around the passage; they are rare, so their places are few
        hits = np.flatnonzero(self.telling_bucket[_bucket(h)])
        word = np.searchsorted(self.telling_all, h[hits])
        real = self.telling_all[np.minimum(word, len(self.telling_all) - 1)] == h[hits]
        hits, word = hits[real], word[real]
        half = np.searchsorted(starts, hits, side="right") - 1
        n = self.telling_ends[word + 1] - self.telling_ends[word]
        which = np.repeat(self.telling_ends[word] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        wide = len(starts) + 2
        places = np.sort(self.telling_rows[which] * wide + np.repeat(half, n))
        # passages near an item by cosine; of those without any telling word around none could be told
        hit = np.concatenate([[0], np.cumsum(np.bincount(half, minlength=len(starts)) > 0)])
        all_rows = np.arange(len(starts))
        some = np.flatnonzero(hit[np.minimum(all_rows + self.reach, len(starts) - 1) + 1] > hit[np.maximum(all_rows - self.reach, 0)])
        near = p[some] @ self.matrix.T >= self.least
        near &= self._told(places // wide, places % wide, len(starts))[some]
        at_row, columns = np.divmod(np.flatnonzero(near), near.shape[1])
        taken = set(zip(some[at_row].tolist(), columns.tolist(), strict=True))

        def around(first: int, last: int, c: int) -> np.ndarray:
            d = doc[first]
            return h[max(at[d], starts[first] - self.more[c]) : min(at[d + 1], starts[last] + 2 * HALF + self.more[c])]

        for r, c in sorted(taken):
            yield doc[r], c, around(r, r, c)
        for first, last, c in self._indexed(places // wide, places % wide, doc):
            # what all these passages together don't hold, none of them holds
            if last > first and not self._share(c, around(first, last, c)):
                continue
            for r in range(first, last + 1):
                if (r, c) not in taken:
                    yield doc[r], c, around(r, r, c)

    def _told(self, item: np.ndarray, half: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` passages and all item rows: whether enough of the item's telling words stand within reach, from the words' places in order."""
        out = np.zeros((n, len(self.ids)), dtype=bool)
        end = np.arange(len(item)) + self.told[item] - 1
        j = np.flatnonzero(end < len(item))
        j = j[item[end[j]] == item[j]]
        lo, hi = np.maximum(half[end[j]] - self.reach, 0), np.minimum(half[j] + self.reach, n - 1)
        j, lo, hi = (x[lo <= hi] for x in (j, lo, hi))
        length = hi - lo + 1
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())
        out[rows, np.repeat(item[j], length)] = True
        return out

    def _indexed(self, item: np.ndarray, half: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first passage, last passage, item row): all passages around which enough of the item's telling words stand, from the words' places in order."""
        end = np.arange(len(item)) + self.told[item] - 1
        j = np.flatnonzero(end < len(item))
        end = end[j]
        wide = self.halves[item[j]]
        good = (item[end] == item[j]) & (doc[half[end]] == doc[half[j]]) & (half[end] - half[j] <= 2 * wide + 1)
        j, end, wide = j[good], end[good], wide[good]
        if not len(j):
            return
        own = doc[half[j]]
        lo = np.maximum(half[end] - 1 - wide, np.searchsorted(doc, own))
        hi = np.minimum(half[j] + wide, np.searchsorted(doc, own, side="right") - 1)
        c = item[j]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (own[1:] != own[:-1]) | (lo[1:] > hi[:-1] + 1)])
        begin = np.flatnonzero(new)
        yield from zip(lo[begin].tolist(), hi[np.append(begin[1:], len(new)) - 1].tolist(), c[begin].tolist(), strict=True)

    def _share(self, c: int, around: np.ndarray) -> float:
        """The share of an item row that stands in order among the words, 0 if it or the telling words are too few."""
        words, own = around.tolist(), self.words[c]
        have = set(words)
        if sum(w in have for w in own) < LCS * len(own) or len(self.telling[c] & have) < ANSWER * len(self.telling[c]):
            return 0.0
        share = lcs_length(own, words) / len(own)
        return share if share >= LCS else 0.0

    def search(self, texts: list[str]) -> list[dict[int, float]]:
        """For each text the items that it holds, with the best share of the item in order."""
        out: list[dict[int, float]] = [{} for _ in texts]
        for d, c, around in self.candidates(texts):
            item = self.ids[c]
            if out[d].get(item, 0.0) == 1.0:
                continue
            if share := self._share(c, around):
                out[d][item] = max(out[d].get(item, 0.0), share)
        return out


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded length; each costs one search of the documents."""
    rows = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = rows.count()
    blocks = max(1, -(-n // ITEMS))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]


#: Found texts up to this number are broadcast, more are joined by shuffle.
BROADCAST_TEXTS = 100_000


def matched(docs: DataFrame, benchmark: DataFrame, items_name: str = "items", share_name: str = "share") -> DataFrame:
    """The rows of docs with ``items_name`` (ids found, ascending) and ``share_name`` (of an item, the greatest that stands in order).

    The two names must not be columns of docs.  Null texts hold nothing; equal
    texts hold the same; without items, or with items without words, nothing is
    found.  What is known of the documents is counted once, whatever the number
    of blocks of items.  Each block is two passes over the texts alone, one to fit
    its space and one to search; what is found is joined with the rows by two hashes of the text.
    """
    counts = None
    text = F.coalesce(docs["text"], F.lit(""))
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    texts = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), text.alias("text"))
    found = None
    for items in _item_blocks(benchmark):
        if not items:
            continue
        if counts is None:
            counts, (whole, n) = word_counts(docs), texts_of(docs)
        held = docs.sparkSession.sparkContext.broadcast((fit(counts, whole, n, [t for _, t in items]), items))
        # copies of a text find the same
        some = written(texts.mapInArrow(_search(held), "k1 long, k2 long, items array<long>, share double").dropDuplicates(["k1", "k2"]))
        found = some if found is None else found.unionByName(some)
    if found is None:
        return docs.select(*[_named(c) for c in docs.columns], F.array().cast("array<long>").alias(items_name), F.lit(0.0).alias(share_name))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    by_text = written(found.groupBy("k1", "k2").agg(ids.alias("items"), F.max("share").alias("share")))
    new = by_text.toDF(*[fresh(c, [*docs.columns, items_name, share_name]) for c in by_text.columns])
    k1, k2, its, share = (new[c] for c in new.columns)
    side = F.broadcast(new) if by_text.count() <= BROADCAST_TEXTS else new
    out = docs.join(side, (keys[0] == k1) & (keys[1] == k2), "left")
    return out.select(*[docs[_quoted(c)] for c in docs.columns], F.coalesce(its, F.array().cast("array<long>")).alias(items_name), F.coalesce(share, F.lit(0.0)).alias(share_name))


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _named(column: str) -> Column:
    return F.col(_quoted(column))


def _search(held: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts with their keys: the items of one block that a text holds, and the greatest share; nothing for texts that hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*held.value)
        for b in batches:
            texts = b["text"].to_pylist()
            found: list[dict[int, float]] = []
            for a, z in split(texts, 300_000):
                found += searcher.search(texts[a:z])
            at = [i for i, f in enumerate(found) if f]
            rows = pa.array(at, pa.int64())
            items, shares = pa.array([sorted(found[i]) for i in at], pa.list_(pa.int64())), pa.array([max(found[i].values()) for i in at], pa.float64())
            yield pa.RecordBatch.from_arrays([b["k1"].take(rows), b["k2"].take(rows), items, shares], names=["k1", "k2", "items", "share"])
        trim()

    return run


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return matched(docs, table(spark, sf_dir, "benchmark")).filter(F.size("items") > 0).select("doc_id", F.col("items").alias("item_ids"), F.round("share", 6).alias("share"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with their columns, whatever these are called."""
    items, share = fresh("items", docs.columns), fresh("share", docs.columns)
    return matched(docs, table(spark, sf_dir, "benchmark"), items, share).filter(F.size(items) == 0).drop(items, share)
