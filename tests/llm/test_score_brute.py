"""Scores of the two trained classifiers, recomputed one text at a time in plain Python."""

import math
import sys
from pathlib import Path

import numpy as np
import zstandard
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import quality as Q
from gridspark.llm import toxic as X
from gridspark.llm.common import held_out

SF = "/root/testdata/sf0.001"


def _tables(spark):
    return (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_quality_scores(spark):
    docs, labels = _tables(spark)
    model = Q.train(docs, labels)
    some = odd_docs(spark, [*TEXTS, *[(r.doc_id + 1000, r.text) for r in docs.limit(60).collect()]])
    coders = [zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in Q.score(some, model, "score_").collect():
        raw = (r.text or "").encode()
        x = [0.0, 1.0, 0.0]
        if raw:
            good, bad = (sum(len(c.compress(raw[i : i + Q.BLOCK])) for i in range(0, len(raw), Q.BLOCK)) for c in coders)
            x = [(bad - good) / min(good, bad), min(good, bad) / len(raw), (bad - good) / len(raw)]
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip([*x, 1.0], model.curve, strict=True))))))
        assert math.isclose(r.score_, want, rel_tol=1e-6), r.doc_id


def _marginals(scores, trans):
    """Forward and backward sums over the two tags of each word, scaled at every step."""
    n = len(scores)
    e = [[math.exp(trans[i][j]) for j in (0, 1)] for i in (0, 1)]
    own = [[1.0, math.exp(s)] for s in scores]
    f, b = [own[0]], [[1.0, 1.0]]
    for t in range(1, n):
        row = [own[t][j] * sum(f[-1][i] * e[i][j] for i in (0, 1)) for j in (0, 1)]
        f.append([x / sum(row) for x in row])
    for t in range(n - 2, -1, -1):
        row = [sum(e[i][j] * own[t + 1][j] * b[0][j] for j in (0, 1)) for i in (0, 1)]
        b.insert(0, [x / sum(row) for x in row])
    return [f[t][1] * b[t][1] / (f[t][0] * b[t][0] + f[t][1] * b[t][1]) for t in range(n)]


def test_toxic_scores(spark):
    docs, labels = _tables(spark)
    model = X.train(docs, labels)
    assert np.abs(model.weights).sum() > 0
    texts = [*[(i, t) for i, t in TEXTS if len(t or "") < 5000], *[(r.doc_id + 1000, r.text) for r in docs.filter(F.length("text") < 5000).limit(80).collect()]]
    got = {}
    for r in X.score(odd_docs(spark, texts), model).collect():
        got.setdefault(r.doc_id, []).append(round(r.score, 6))
    want = {}
    for i, t in texts:
        p = _marginals([model.constant + sum(float(model.weights[k]) for k in X.features(w)) for w in (t or "").split()], model.trans) if (t or "").split() else []
        top = min(max(max(p, default=0.0), 1e-6), 1 - 1e-6)
        x = [math.log(top / (1 - top)), math.log1p(sum(p))] if p else [-12.0, 0.0]
        z = x[0] * model.curve[0] + x[1] * model.curve[1] + model.curve[2]
        want.setdefault(i, []).append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), atol=2e-5), i


def test_toxic_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = _tables(spark)
    other = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.train(docs, labels), X.train(docs, other)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.curve, b.curve) and a.constant == b.constant
