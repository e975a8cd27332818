import numpy as np
import pytest

from gridspark.llm import decontaminate as D

LENGTHS = (3, 8, 16, 20, 33, 40, 80)
EDITS = (0.0, 0.25, 0.4)


def _planted(seed):
    """Items of all lengths, and texts that each hold one item with a share of its words changed."""
    rng = np.random.default_rng(seed)
    text = lambda n: [f"w{i}" for i in (rng.zipf(1.3, n) % 3000)]
    items = [(i, text(LENGTHS[i % len(LENGTHS)])) for i in range(210)]
    texts, truth = [], []
    for i, own in items:
        edit = EDITS[i % len(EDITS)]
        own = list(own)
        for p in rng.choice(len(own), int(edit * len(own)), replace=False):
            own[p] = f"other{rng.integers(0, 50)}"
        a = text(rng.integers(0, 90))
        texts.append(" ".join(a + own + text(rng.integers(0, 90))))
        truth.append((i, edit))
    return [(i, " ".join(w)) for i, w in items], [*texts, "", "w1"], truth


def _brute(searcher, texts):
    """Every item row against the words around every passage of every text."""
    out = [{} for _ in texts]
    h, at = D._words(texts)
    for d in range(len(texts)):
        words = h[at[d] : at[d + 1]].tolist()
        for c, own in enumerate(searcher.words):
            more = max(D.HALF, len(own) - D.HALF)
            for s in range(0, len(words), D.HALF):
                around = words[max(0, s - more) : s + 2 * D.HALF + more]
                have = set(around)
                if len(searcher.telling[c] & have) >= D.ANSWER * len(searcher.telling[c]) and sum(w in have for w in own) >= D.LCS * len(own):
                    share = D.lcs_length(own, around) / len(own)
                    if share >= D.LCS:
                        out[d][searcher.ids[c]] = max(share, out[d].get(searcher.ids[c], 0.0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_item_that_the_checks_accept_is_found_whatever_the_cosine(seed):
    items, texts, truth = _planted(seed)
    # a space that tells nothing apart: two random directions
    rng = np.random.default_rng(seed)
    h, _ = D._words([t for _, t in items])
    counts = np.bincount(D._bucket(h), minlength=1 << D.BUCKETS_LOG2) + 1
    space = D.Space(np.log1p(counts.sum() / counts).astype(np.float32), rng.normal(size=(1 << D.BUCKETS_LOG2, 2)).astype(np.float32), np.ones(2))
    searcher = D.Searcher(space, items)
    got = searcher.search(texts)
    assert got == _brute(searcher, texts)
    assert all(got[d].get(i) == 1.0 for d, (i, edit) in enumerate(truth) if edit == 0)


def test_cosine_alone_finds_nine_in_ten(spark):
    """Items cut from documents and planted in others with up to 40 % of the words changed are near by cosine, short ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.filter("length(text) > 400").orderBy("doc_id").collect()]
    rng = np.random.default_rng(5)
    own = []
    for i, t in enumerate(texts[:300]):
        w = t.split()
        n = int(rng.integers(6, 21)) if i % 2 else int(rng.integers(21, 60))
        s = int(rng.integers(0, max(1, len(w) - n)))
        own.append(w[s : s + n])
    items = [(i, " ".join(w)) for i, w in enumerate(own)]
    counts, (sample, n) = D.word_counts(docs), D.sample_of(docs)
    searcher = D.Searcher(D.fit(counts, sample, n, [t for _, t in items]), items)
    rows = {}
    for k, i in enumerate(searcher.ids):
        rows.setdefault(i, []).append(k)
    cells = {}
    for i, w in enumerate(own):
        edit = EDITS[i % len(EDITS)]
        free = [p for p in range(len(w)) if not set(D._words([w[p]])[0].tolist()) & searcher.telling[rows[i][0]]]
        changed, host = list(w), texts[300 + i % (len(texts) - 300)].split()
        for p in rng.choice(free, min(int(edit * len(w)), len(free)), replace=False):
            changed[p] = host[int(rng.integers(0, len(host)))]
        at = int(rng.integers(0, len(host)))
        h, ends = D._words([" ".join(host[max(0, at - 100) : at] + changed + host[at : at + 100])])
        starts, doc = D._halves(ends)
        p, _ = D.passages(searcher.space.basis[D._bucket(h)], starts, doc)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        near = (p @ searcher.matrix[rows[i]].T >= searcher.least[rows[i]]).any()
        cells.setdefault((len(w) > 20, edit), []).append(near)
    assert len(cells) == 6 and all(np.mean(x) >= 0.9 for x in cells.values()), {k: np.mean(x) for k, x in cells.items()}
