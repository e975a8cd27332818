"""Toxic spans by a linear-chain conditional random field over words.

Documents are labelled, words are not.  Words that stand in many more different
contexts of toxic documents than of clean ones are labelled first; the field is
then trained on those word labels, with features of the word and its ends, so it
also judges words and neighbourhoods that the first step left open.  With two
states the forward and backward messages are log-odds, and numpy carries them
for many documents at once.  The marginals give spans and a document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import held_out, ids_and_text, labelled_sample, logistic, table

#: Bounds of the training sample: texts of each label, and characters of a text.
PER_CLASS = 1500
MAX_CHARS = 20_000
FEATURES = 1 << 16
SEGMENT = 64
STEPS = 60
THRESHOLD = 0.5
KEPT_WORDS = 400_000
_EDGE = re.compile(r"^\W+|\W+$")


@dataclass
class Model:
    weights: np.ndarray  # of word features, FEATURES long
    constant: float
    trans: np.ndarray  # 2 x 2 log potentials, from row to column
    curve: np.ndarray  # of the document's score


def features(piece: str) -> list[int]:
    """Buckets of the word itself, its first and last three letters, and its shape."""
    word = _EDGE.sub("", piece).lower()
    return [zlib.crc32(f"{k}:{v}".encode("utf-8", "surrogatepass")) % FEATURES for k, v in (("w", word), ("p", word[:3]), ("s", word[-3:]), ("n", min(len(word), 12)))]


def _first_labels(docs: list[tuple[list[str], int]]) -> set[str]:
    """Words with many more contexts in toxic than in clean texts; copies of a text add no contexts."""
    seen: list[dict[str, set[int]]] = [defaultdict(set), defaultdict(set)]
    n = [1, 1]
    for words, y in docs:
        for a, w, b in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
            seen[y][w].add(hash((a, b)))
        n[y] += len(words)
    return {w for w, c in seen[1].items() if w and len(c) >= 4 and (len(c) / n[1]) / ((len(seen[0].get(w, ())) + 0.5) / n[0]) > 8}


def log_ratio(to1: np.ndarray, to0: np.ndarray) -> np.ndarray:
    return np.log(to1) - np.log(to0)


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each word; scores: documents x words, padded behind ``lengths``."""
    n, m = scores.shape
    e = np.exp(trans)
    forward = np.empty((m, n))
    s = np.ascontiguousarray(np.clip(scores.T, -30, 30))
    f = s[0].copy() if m else np.zeros(n)
    if m:
        forward[0] = f
    for t in range(1, m):
        x = np.exp(f)
        f = s[t] + np.log((e[0, 1] + e[1, 1] * x) / (e[0, 0] + e[1, 0] * x))
        forward[t] = f
    g = np.zeros(n)
    out = np.zeros((m, n))
    for t in range(m - 1, -1, -1):
        inside = t < lengths - 1
        if t < m - 1:
            y = np.exp(s[t + 1] + g)
            g = np.where(inside, np.log((e[1, 0] + e[1, 1] * y) / (e[0, 0] + e[0, 1] * y)), 0.0)
        out[t] = np.where(t < lengths, 1 / (1 + np.exp(-np.clip(forward[t] + g, -40, 40))), 0.0)
    return out.T


def _fit(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum likelihood by full-batch steps of scaled gradients; segments: word features (words x 4) and labels."""
    n = len(segments)
    lengths = np.array([len(y) for _, y in segments])
    m = int(lengths.max())
    feats = np.zeros((n, m, 4), dtype=np.int32)
    labels = np.zeros((n, m))
    for i, (x, y) in enumerate(segments):
        feats[i, : len(y)], labels[i, : len(y)] = x, y
    real = np.arange(m)[None, :] < lengths[:, None]
    w, b, trans = np.zeros(FEATURES), -3.0, np.zeros((2, 2))
    vw, vb, vt = np.zeros(FEATURES), 0.0, np.zeros((2, 2))
    flat = feats[real].ravel()
    for _ in range(STEPS):
        s = np.where(real, b + w[feats].sum(axis=2), 0.0)
        # pair marginals from the messages
        e = np.exp(trans)
        fw = np.zeros((m, n))
        bw = np.zeros((m, n))
        st = np.clip(s.T, -30, 30)
        fw[0] = st[0]
        for t in range(1, m):
            x = np.exp(fw[t - 1])
            fw[t] = st[t] + np.log((e[0, 1] + e[1, 1] * x) / (e[0, 0] + e[1, 0] * x))
        for t in range(m - 2, -1, -1):
            y = np.exp(st[t + 1] + bw[t + 1])
            bw[t] = np.where(t < lengths - 1, np.log((e[1, 0] + e[1, 1] * y) / (e[0, 0] + e[0, 1] * y)), 0.0)
        p = np.where(real, (1 / (1 + np.exp(-np.clip(fw + bw, -40, 40)))).T, 0.0)
        diff = (labels - p)[real]
        gw = np.bincount(flat, weights=np.repeat(diff, 4), minlength=FEATURES) - 0.05 * w
        gb = diff.sum()
        gt = np.zeros((2, 2))
        if m > 1:
            x, y = fw[:-1], (st + bw)[1:]
            both = [[e[0, 0] * np.ones_like(x), e[0, 1] * np.exp(y)], [e[1, 0] * np.exp(x), e[1, 1] * np.exp(np.clip(x + y, -60, 60))]]
            z = sum(map(sum, both))
            step = (np.arange(1, m)[:, None] < lengths[None, :]).astype(float)
            lt = labels.T
            for i in (0, 1):
                for j in (0, 1):
                    seen = (lt[:-1] == i) & (lt[1:] == j)
                    gt[i, j] = ((seen - both[i][j] / z) * step).sum()
        vw, vb, vt = 0.9 * vw + 0.1 * gw**2, 0.9 * vb + 0.1 * gb**2, 0.9 * vt + 0.1 * gt**2
        w += 0.15 * gw / (np.sqrt(vw) + 1e-3)
        b += 0.1 * gb / (np.sqrt(vb) + 1e-3)
        trans += 0.05 * gt / (np.sqrt(vt) + 1e-3)
    return w, float(b), trans - trans[0, 0]


class Tagger:
    """Marginals of whole texts, a batch of documents at a time."""

    def __init__(self, model: Model):
        self.m = model
        self.kept: dict[str, float] = {}

    def _score(self, piece: str) -> float:
        s = self.m.constant + float(self.m.weights[features(piece)].sum())
        if len(self.kept) < KEPT_WORDS:
            self.kept[piece] = s
        return s

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        get = self.kept.get
        scores = []
        for t in texts:
            row = np.empty(0)
            if words := t.split():
                found = [get(x) for x in words]
                row = np.array([self._score(x) if s is None else s for x, s in zip(words, found, strict=True)])
            scores.append(row)
        order = sorted((i for i in range(len(texts)) if len(scores[i])), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and n < 512 and (n + 1) * len(scores[order[at + n]]) <= 2_000_000:
                n += 1
            some = order[at : at + n]
            lengths = np.array([len(scores[i]) for i in some])
            padded = np.zeros((n, int(lengths.max())))
            for k, i in enumerate(some):
                padded[k, : lengths[k]] = scores[i]
            p = marginals(padded, lengths, self.m.trans)
            for k, i in enumerate(some):
                out[i] = p[k, : lengths[k]]
            at += n
        return out


def summary(p: np.ndarray) -> tuple[float, float]:
    """What a document's score rests on: the log-odds of its likeliest word, and the expected number of toxic words."""
    if not len(p):
        return -12.0, 0.0
    top = min(max(float(p.max()), 1e-6), 1 - 1e-6)
    return float(np.log(top / (1 - top))), float(np.log1p(p.sum()))


def spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets (start, end) of runs of words that are likelier toxic than not."""
    out: list[tuple[int, int]] = []
    last = -2
    if not (p > 0.5).any():
        return out
    at = 0
    for i, w in enumerate(text.split()):
        at = text.index(w, at)
        if p[i] > 0.5:
            if last == i - 1:
                out[-1] = (out[-1][0], at + len(w))
            else:
                out.append((at, at + len(w)))
            last = i
        at += len(w)
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from rows that aren't held out; without labels of both kinds every score is 0.5."""
    rows, counts = labelled_sample(docs, labels, "toxic", per_class, MAX_CHARS)
    nothing = Model(np.zeros(FEATURES), 0.0, np.zeros((2, 2)), np.zeros(3))
    if len({y for _, y in rows}) < 2:
        return nothing
    split = [(t.split(), y) for t, y in rows]
    first = _first_labels([([_EDGE.sub("", x).lower() for x in words], y) for words, y in split[::2]])
    if not first:
        return nothing
    known: dict[str, list[int]] = {}
    segments = []
    plain = 0
    for words, y in split[::2]:
        for at in range(0, len(words), SEGMENT):
            some = words[at : at + SEGMENT]
            tags = np.array([float(y == 1 and _EDGE.sub("", x).lower() in first) for x in some])
            plain += not tags.any()
            if tags.any() or plain % 4 == 0:  # of segments without a toxic word, each fourth
                segments.append((np.array([known.setdefault(x, None) or known.__setitem__(x, features(x)) or known[x] for x in some], dtype=np.int32), tags))
    if not segments:
        return nothing
    w, b, trans = _fit(segments)
    model = Model(w, b, trans, np.zeros(3))
    y = np.array([y for _, y in rows[1::2]], dtype=float)
    x = np.array([summary(p) for p in Tagger(model).tag([t for t, _ in rows[1::2]])])
    model.curve = logistic(x, y) if len(y) and 0 < y.sum() < len(y) else np.array([1.0, 0.0, 0.0])
    if len(y):
        model.curve[-1] += np.log(max(counts.get(1, 0), 1) / max(counts.get(0, 0), 1)) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), n_toxic and spans (character offsets) of every row's whole text (null: empty).

    Repeated rows stay and get equal scores, an empty table gives no rows; other
    columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                b = batch.slice(at, 4000)
                texts = b["text"].to_pylist()
                tags = tagger.tag(texts)
                x = np.array([summary(p) for p in tags]).reshape(-1, 2)
                s = 1 / (1 + np.exp(-np.clip(x @ model.curve[:2] + model.curve[2], -30, 30)))
                where = [[{"start": a, "end": e} for a, e in spans(t, p)] for t, p in zip(texts, tags, strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array([int((p > 0.5).sum()) for p in tags], pa.int64()), pa.array(where, kinds)], names=["doc_id", "score", "n_toxic", "spans"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, score double, n_toxic long, spans array<struct<start:int,end:int>>")


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic", "spans")
