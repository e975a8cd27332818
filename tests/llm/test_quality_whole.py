"""The quality model comes from every learnable text, recomputed here in plain Python."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

from gridspark.llm import quality as Q
from gridspark.llm.common import labelled_texts, logistic

SCHEMA = "doc_id long, quality int, toxic int"


def _tables(spark):
    rng = np.random.default_rng(6)
    good, bad = ([f"{k}{i}" for i in range(400)] for k in ("fair", "poor"))
    docs, labels = [], []
    for i in range(7000):
        own, other = (good, bad) if i % 2 else (bad, good)
        words = [(own if rng.random() < 0.7 else other)[k] for k in rng.integers(0, 400, 12)]
        # copies, and texts of over 20,000 characters
        docs.append((i, docs[-2][1] if i % 50 in (4, 5) else " ".join(words * (300 if i % 1000 == 7 else 1))))
        labels.append((i, i % 2, 0))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, SCHEMA), docs


def _merged(found):
    while len(found) > 1:
        found = [x[0] if len(x) == 1 else Q._dictionary(x) for x in (found[i : i + Q.TOGETHER] for i in range(0, len(found), Q.TOGETHER))]
    return found[0]


def test_model_comes_from_every_text(spark, monkeypatch):
    monkeypatch.setattr(Q, "PART_BYTES", 50_000)
    monkeypatch.setattr(Q, "TOGETHER", 3)
    docs, labels, rows = _tables(spark)
    model = Q.train(docs, labels)
    want = Counter((i % 2, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5)
    texts = labelled_texts(docs, labels, "quality").collect()
    assert Counter((r.label, r.text) for r in texts) == want and min(Counter(y for y, _ in want).values()) > 1500
    dictionaries, x, y = {}, [], []
    for k in (0, 1):
        own = [r for r in texts if r.label == k]
        n = sum(len(r.text) for r in own) // Q.PART_BYTES
        assert n > Q.TOGETHER
        parts = [sorted({(r.h, r.text) for r in own if r.at % n == p and r.h % 2 == 0}) for p in range(n)]
        dictionaries[k] = _merged([Q._dictionary([t.encode() for _, t in part]) for part in parts])
        rest = [r.text for r in own if r.h % 2]
        x += rest
        y += [k] * len(rest)
    assert dictionaries == {0: model.bad, 1: model.good}
    sizes = Q.Sizes(model.good, model.bad)
    w = logistic(np.array([sizes.measures(t) for t in x]) * 10, np.array(y, dtype=float))
    counts = Counter(k for k, _ in want.elements())
    shift = np.log(counts[1] / counts[0]) - np.log(sum(y) / (len(y) - sum(y)))
    assert np.allclose(model.curve, [*w[:3] * 10, w[3] + shift], rtol=1e-5, atol=1e-5)


def test_long_texts_are_learned_from(spark):
    docs, labels, _ = _tables(spark)
    long = docs.filter("doc_id < 200").selectExpr("doc_id", "repeat(concat(text, ' '), 400) text")
    assert long.filter("length(text) <= 20000").count() == 0
    model = Q.train(long, labels)
    got = {r.doc_id: r.score_ for r in Q.score(long, model, "score_").collect()}
    assert model.curve is not None and np.mean([s for i, s in got.items() if i % 2]) > np.mean([s for i, s in got.items() if i % 2 == 0])
