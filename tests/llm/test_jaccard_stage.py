import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs
from test_jaccard import answers, brute

from gridspark.llm import jaccard as J


def _changed(words, n, rng, tag):
    """The words with n of them changed, no two within five words."""
    out = list(words)
    for k, p in enumerate(sorted(rng.sample(range(len(words) // 8), n))):
        out[8 * p + 4] = f"{tag}x{k}"
    return out


def _rows():
    rng = random.Random(8)
    rows = []
    for d, n in enumerate((80, 200, 500)):
        base = [f"d{d}w{i}" for i in range(n)]
        for i in range(24):
            rows.append((100 * d + i, " ".join(_changed(base, round(n * i / 600), rng, f"c{d}n{i}"))))
    return rows + [(None if i is None else 5000 + i, t) for i, t in TEXTS]


def test_ten_changed_words_of_500_are_one_document(spark):
    base = [f"w{i}" for i in range(500)]
    rows = [(1, " ".join(base)), (2, " ".join(_changed(base, 10, random.Random(1), "y"))), (3, " ".join(_changed(base, 14, random.Random(2), "z")))]
    assert [r.doc_id for r in J.stage(spark, odd_docs(spark, rows), "").orderBy("doc_id").collect()] == [1, 3]


def test_join_of_five_words_at_80(spark):
    rows = _rows()
    want = brute(rows, 5, 80)
    assert answers(J.join(odd_docs(spark, rows), 5, 80)) == want != brute(rows, 3, 90)


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 5, 80)
    assert sorted(r.doc_id for r in J.stage(spark, docs, "").collect()) == sorted(d for d, n, c in want.elements() if c == d)
