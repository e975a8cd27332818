import hashlib
import random
import sys
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import suffixes as S


@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.sampled_from([3, 8, 20]), st.sampled_from([1, 7, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_order_and_common_prefixes(symbols, limit, held):
    t = bytes(symbols)
    got = list(S.sorted_suffixes(np.frombuffer(t, dtype=np.uint8), limit, held))
    s, k = (np.concatenate([g[i] for g in got]).tolist() for i in (0, 1))
    assert sorted(s) == list(range(len(t)))
    for x, y, c in zip(s, s[1:], k[1:], strict=False):
        assert t[x : x + limit] >= t[y : y + limit]
        n = 0
        while n < limit and x + n < len(t) and y + n < len(t) and t[x + n] == t[y + n]:
            n += 1
        assert c == n


def brute(rows):
    raw = [(S.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, r in raw:
        for p in range(len(r) - 49):
            k = r[p : p + 50]
            first[k] = min(i, first.get(k, i))
    out = []
    for i, r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for p in range(len(r) - 49):
            if first[r[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(r) else 0
        kept = bytes(b for b, g in zip(r, gone[:-1], strict=True) if not g)
        out.append((i if i < S.LAST else -1, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def answers(df):
    return sorted((-1 if r.column_0 is None else r.column_0, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def test_made_up_repeats(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_CHARS", 3000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 8)))
    shared = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            parts += [p[a:] if rng.random() < 0.5 else p, " ".join(word() for _ in range(rng.randrange(0, 30)))]
        rows.append((i, " ".join(parts)))
    rows += [(500, "ab" * 300), (501, "b" + "ab" * 200), (502, "a" * 5000), (503, "a" * 49), (504, "a" * 50), (505, rows[3][1])]
    assert answers(S.deduplicated(odd_docs(spark, rows))) == brute(rows)
    # by shuffles, with shards of many blocks, and with every hash of two distinct runs split
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(S, "BLOCK_BYTES", 200)
    monkeypatch.setattr(S, "HELD", 50)
    assert answers(S.deduplicated(odd_docs(spark, rows))) == brute(rows)
    monkeypatch.setattr(S, "SPLIT_RUNS", 1)
    assert answers(S.deduplicated(odd_docs(spark, rows))) == brute(rows)


def test_a_phrase_of_most_documents(spark, monkeypatch):
    """A common phrase files only what lies within it; rows of one doc_id with different texts are one document."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    phrase = "the same fifty bytes and some more stand in nearly every one of these documents"
    rows = [(i, " ".join([word() for _ in range(30)] + [phrase] * (i % 3 > 0) + [word() for _ in range(30)])) for i in range(300)]
    rows += [(7, phrase + " twice the number seven"), (None, phrase), (None, phrase + " and more without any number")]
    monkeypatch.setattr(S, "SPLIT_RUNS", 20)
    assert answers(S.deduplicated(odd_docs(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    assert answers(S.deduplicated(odd_docs(spark, TEXTS))) == brute(TEXTS)
    assert S.deduplicated(odd_docs(spark, [])).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(tuple(r) for r in S.QUERY(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)


def test_stage(spark):
    docs = odd_docs(spark, [(1, "x y " * 40), (2, "x y " * 40), (3, "some other text that stays as it is")])
    got = {r.doc_id: r.text for r in S.stage(spark, docs, "").collect()}
    assert got == {1: "x y " * 40, 3: "some other text that stays as it is"}
    assert S.stage(spark, docs, "").columns == docs.columns
    few = docs.select("text", "doc_id")
    assert {(r.doc_id, r.text) for r in S.stage(spark, few, "").collect()} == set(got.items())
