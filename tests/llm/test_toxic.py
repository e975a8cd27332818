import itertools
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import toxic as X

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 3, 5])
    scores = rng.normal(size=(3, 5)) * (np.arange(5)[None, :] < lengths[:, None])
    trans = rng.normal(size=(2, 2))
    got = X.marginals(scores, lengths, trans)
    for d, n in enumerate(lengths):
        total, by = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(s for s, t in zip(scores[d], tags, strict=False) if t) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            by += w * np.array(tags)
        assert np.allclose(got[d, :n], by / total) and not got[d, n:].any()


def test_spans():
    assert X.spans("a bad  worse b", np.array([0.1, 0.9, 0.8, 0.2])) == [(2, 12)]
    assert X.spans("", np.zeros(0)) == []


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in X.QUERY(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.predicted == int(r.score >= 0.5)
        for s in r.spans:
            assert texts[i][s.start : s.end].strip() == texts[i][s.start : s.end] != ""
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.toxic for r in labels) >= 0.9 * len(labels)


def test_odd_rows(spark):
    docs = odd_docs(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in X.score(docs, X.train(docs, none)).collect()} == {0.5}
    model = X.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = X.score(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert X.score(odd_docs(spark, []), model).count() == 0
