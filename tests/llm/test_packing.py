from collections import Counter
import sys
import zlib
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import packing as P
from gridspark.llm.tokens import encoder, tokenizer_path


def _fewest(sizes, capacity):
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, bins + [sizes[i]])

    place(0, [])
    return best[0]


@given(st.lists(st.integers(1, 20), max_size=7))
@settings(max_examples=100, deadline=None)
def test_bound_and_bins(sizes):
    a = np.array(sizes, dtype=np.int64)
    bins, offsets, n = P.best_fit_decreasing(a, 20)
    least = _fewest(sorted(sizes, reverse=True), 20) if sizes else 0
    assert P.lower_bound(a, 20) <= least <= n
    for b in range(n):
        own = sorted(zip(offsets[bins == b], a[bins == b], strict=True))
        at = 0
        for o, s in own:
            assert o == at
            at += s
        assert at <= 20


def check(rows, capacity, least=None):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, s in sorted(own):
            assert o == at
            at += s
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by) >= -(-total // capacity)
    if least:
        assert len(by) <= least
    return len(by)


def test_rounds_keep_every_piece(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), 0, int(s)) for i, s in enumerate(rng.integers(1, 101, 3000))]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, part int, length long")
    got = P.pack(df, 100, 150).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[2]) for r in rows + rows[:5])
    whole = P.best_fit_decreasing(np.array([r[2] for r in rows + rows[:5]]), 100)[2]
    check(got, 100, whole * 1.04)  # partitions of only 150 rows


def test_documents(spark):
    t = encoder(tokenizer_path()).t
    got = P.pack(P.token_pieces(odd_docs(spark, TEXTS), tokenizer_path(), 0)).collect()
    check(got, 2048)
    want = []
    for i, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)


def test_clashing_names(spark):
    rows = [(i % 7 + 1, i, 1, 2, 3, 4) for i in range(50)]
    df = spark.createDataFrame(rows, "length long, part int, released int, part__ int, `a.b c` int, offset int")
    got = P.pack(df, 10, 5)
    assert got.count() == 50 and got.select("`a.b c`", "part", "released").distinct().count() == 50


def test_empty(spark):
    assert P.pack(P.token_pieces(odd_docs(spark, []), tokenizer_path(), 0)).count() == 0


def test_query(spark):
    got = P.QUERY(spark, "/root/testdata/sf0.001").collect()
    n = check(got, 2048)
    assert n <= 1.02 * P.lower_bound(np.array([r.length for r in got])) + 1
