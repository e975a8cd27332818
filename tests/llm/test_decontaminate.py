import re
import sys
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert D.lcs_length(a, b) == t[-1, -1]


def test_query_against_whole_text_search(spark):
    words = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        t = words(r.text)
        if found := sorted(i for i, x in items if x in t):
            want[r.doc_id] = found
    got = {r.doc_id: list(r.item_ids) for r in D.QUERY(spark, SF).collect()}
    assert set(got) == set(want) and all(set(want[d]) <= set(got[d]) for d in want)


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_paraphrases_and_clean_texts(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    items = [text(40) for _ in range(30)]
    docs, leaks = [], set()
    for i in range(200):
        w = text(300)
        if i % 4 == 0:
            own = list(items[i % 30])
            for _ in range(6):
                own[rng.integers(0, 40)] = "other"
            del own[5]
            w[100:100] = own
            leaks.add(i)
        docs.append((i, " ".join(w)))
    got = D.matched(odd_docs(spark, docs), _items(spark, [(i, " ".join(t)) for i, t in enumerate(items)]), "found_items", "best_share").filter("size(found_items) > 0").collect()
    assert {r.doc_id for r in got} == leaks
    assert all(i.doc_id % 30 in i.found_items for i in got)


def test_several_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 2)
    docs = odd_docs(spark, [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "nothing of that sort stands here at all"), (3, None)])
    items = _items(spark, [(1, "alpha beta gamma delta epsilon"), (2, "one two three four five six"), (3, "seven eight nine ten"), (4, ""), (5, None)])
    got = D.matched(docs, items, "found_items", "best_share")
    assert got.columns == [*docs.columns, "found_items", "best_share"]
    assert {r.doc_id: r.found_items for r in got.collect()} == {1: [1], 2: [], 3: []}


def test_odd_rows(spark):
    items = _items(spark, [(1, " ".join(f"i{k}" for k in range(20)))])
    assert D.matched(odd_docs(spark, TEXTS), items, "found_items", "best_share").filter("size(found_items) = 0").count() == len(TEXTS)
    assert D.matched(odd_docs(spark, []), items, "found_items", "best_share").count() == 0
    assert D.matched(odd_docs(spark, TEXTS), _items(spark, []), "found_items", "best_share").count() == len(TEXTS)


def test_space_comes_from_all_documents(spark):
    """The fitted range is that of every passage and item, by plain matrices."""
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(150)]
    texts = [" ".join(vocabulary[k] for k in rng.integers(0, 150, rng.integers(0, 60))) for _ in range(9000)]
    items = [" ".join(vocabulary[k] for k in rng.integers(0, 150, 20)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    counts, (whole, n) = D.word_counts(docs), D.texts_of(docs)
    space = D.fit(counts, whole, n, items, rank=6)
    h, at = D._words(texts + items)
    names, b = np.unique(D._bucket(h), return_inverse=True)
    starts, doc = D._halves(at)
    a, _ = D.passages(np.eye(len(names))[b] * space.idf[names], starts, doc)
    q = np.random.default_rng(11).standard_normal((1 << D.BUCKETS_LOG2, 6), dtype=np.float32)[names].astype(np.float64)
    weight = np.where(doc < len(texts), 1.0, 8 * len(texts) / len(items))
    want, _ = np.linalg.qr(a.T @ (weight[:, None] * (a @ q)))
    idf = space.idf[names][:, None]
    got = np.divide(space.basis[names], idf, out=np.zeros((len(names), 6)), where=idf > 0)
    assert n == 9000 and np.allclose(got.T @ got, np.eye(6), atol=1e-4)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)


@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.integers(2, 9))
@settings(max_examples=100, deadline=None)
def test_run_sums(lengths, group):
    rng = np.random.default_rng(sum(lengths))
    rows, vectors = rng.integers(0, 30, sum(lengths)), rng.integers(0, 99, (30, 3)).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    assert (D.run_sums(vectors, rows, starts, group) == np.add.reduceat(vectors[rows], starts, axis=0)).all()
