import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import jaccard as J


def brute(rows, size=3, percent=90):
    """(doc_id, shingles, smallest doc_id of the component) of each row, from all pairs of sets that share a shingle."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    index = {}
    for i, own in enumerate(sets):
        for s in own:
            index.setdefault(s, []).append(i)
    near = {(a, b) for own in index.values() for a in own for b in own if a < b}
    for a, b in near:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def answers(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_shingles():
    texts = ["", " a ", "A b", "a b c", "x a b c\td\n", "a B c a b c"]
    h, at = J.shingle_hashes(texts)
    own = [h[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
    assert [len(o) for o in own] == [0, 1, 1, 1, 3, 4]
    assert own[4][1] == own[3][0] == own[5][0] == own[5][3]
    assert len({own[1][0], own[2][0], own[3][0]}) == 3


def _close(n, rng):
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w[: rng.randrange(54, 61)])))
    return rows


@pytest.mark.parametrize("unit, ids", [(128, 1_000_000), (7, -1)])
def test_near_copies(spark, monkeypatch, unit, ids):
    """Also with followers in many rows, and with every table shuffled."""
    monkeypatch.setattr(J, "UNIT", unit)
    monkeypatch.setattr(J, "BROADCAST_IDS", ids)
    rng = random.Random(4)
    rows = _close(150, rng) + [(1000 + i, t) for i, t in _close(40, rng)] + [(2000 + i, f"only {i} some words that common common common") for i in range(50)] + [(None if i is None else 5000 + i, t) for i, t in TEXTS]
    assert answers(J.join(odd_docs(spark, rows))) == brute(rows)


def test_groups_that_meet_at_their_edges(spark):
    """Two families whose first members don't link, while some of their followers do; thresholds in reach from many sides."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for family in range(2):
        for i in range(60):
            w = list(base)
            for p in rng.sample(range(0, 120, 4), rng.randrange(5)):
                w[p] = f"f{family}p{p}" if rng.random() < 0.8 else f"x{rng.randrange(9)}"
            rows.append((100 * family + i, " ".join(w)))
    for size, percent in ((3, 90), (5, 80), (1, 95)):
        assert answers(J.join(odd_docs(spark, rows), size, percent)) == brute(rows, size, percent)


def test_derived_counts():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, w = (np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(2))
        sides = []
        for leader in (x, w):
            members = [np.unique(np.concatenate([leader[rng.random(len(leader)) < 0.9], rng.integers(0, 70, 3).astype(np.uint64)])) for _ in range(5)]
            sides.append((members, J._signs([J._packed(np.setdiff1d(m, leader)) for m in members], [J._packed(np.setdiff1d(leader, m)) for m in members])))
        got = J.derived(len(np.intersect1d(x, w)), x, w, sides[0][1], sides[1][1], 5, 5)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sides[1][0]] for a in sides[0][0]]


def test_many_near_copies(spark):
    """Ten thousand near copies of one text are one component."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(10_000):
        w = list(base)
        w[i % 200] = f"c{i}"
        rows.append((i, " ".join(w)))
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 10_000)]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert answers(J.QUERY(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_empty_and_stage(spark):
    assert J.join(odd_docs(spark, [])).count() == 0
    kept = J.stage(spark, odd_docs(spark, TEXTS), "")
    assert kept.columns == odd_docs(spark, TEXTS).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, 1, 2, 3, 4, 7, 8, 9, 10, 10, 10, None])  # the numberless text is a near copy of 4
