"""Codes and centroids against brute force in whole numbers, with every awkward row."""

import hashlib

import duckdb
import numpy as np
import pytest

from gridspark.llm import centroids, codes
from gridspark.llm.common import written
from gridspark.llm.vectors import dimension, whole

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, code int, x string, n long, `a.b c` int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], SCHEMA)


def _rows(n, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    real = lambda v: [float(np.float32(x)) for x in v]
    base = [real(rng.normal(0, 1, dim)) for _ in range(n)]
    rows = [(i, base[i] if i % 3 else base[0], i % 4 if i % 7 else None) for i in range(n)]  # a third of all is one vector
    rows += [(n, None, 0), (n + 1, base[1][:-1] + [None], 0), (n + 2, base[1][:-1] + [NAN], 1), (n + 3, [-INF] + base[1][1:], 1), (n + 4, [], 0), (n + 5, base[1][:7], 0)]
    rows += [(5, base[2], 1), (5, base[2], 1), (None, base[3], None), (n + 6, [0.0] * dim, 9), (n + 7, [1e30] + [0.0] * (dim - 1), 2), (n + 8, [-3.0] * dim, 2)]
    return rows


def _whole(rows, scale, dim):
    good = lambda v: v is not None and len(v) == dim and all(x is not None and np.isfinite(x) and abs(x) * scale < 1 << 27 for x in v)
    return [(i, [int(np.floor(x * scale)) for x in v], label) for i, v, label in rows if good(v)]


def _nearest(x, entries):
    d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
    return d.index(min(d)), min(d)


def _brute_codes(rows, parts=8, entries=16, rounds=6, dim=64):
    kept, w = _whole(rows, 4096, dim), dim // parts
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            of = [_nearest(cut(r[1], p), books[p])[0] for r in kept]
            for e in range(len(books[p])):
                mine = [cut(r[1], p) for r, c in zip(kept, of, strict=True) if c == e]
                if mine:
                    books[p][e] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    out, by = [], {}
    for i, x, label in kept:
        got = [_nearest(cut(x, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{c:02x}" for c, _ in got), sum(d for _, d in got), label])
        by[label] = by.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, e, by[label], sha) for i, c, e, label in out), key=repr)


def _brute_clusters(rows, k=8, rounds=10, dim=64):
    kept = _whole(rows, 1024, dim)
    h = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, h(r[0]), r[1]))[:k]
    cs = [r[1] for r in first]
    for _ in range(rounds):
        of = [_nearest(r[1], cs)[0] for r in kept]
        for c in range(len(cs)):
            mine = [r[1] for r, a in zip(kept, of, strict=True) if a == c]
            if mine:
                cs[c] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    got = [(i, *_nearest(x, cs)) for i, x, _ in kept]
    inertia = {c: sum(d for _, a, d in got if a == c) for c in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in got), key=repr)


def test_codes(spark):
    rows = _rows(120)
    found, books = codes.compress(_table(spark, rows))
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], codes.digest(books)) for r in found.collect()]
    assert sorted(got, key=repr) == _brute_codes(rows)
    back = codes.decode(found, books).collect()
    full = {(r[0], tuple(r[1])) for r in _whole(rows, 4096, 64)}
    errors = {(i, sum((a - b) ** 2 for a, b in zip(x, r["x"], strict=True))) for i, x in full for r in back if r["vec_id"] == i}
    assert {(r["vec_id"], r["error"]) for r in back} <= errors


def test_label_sums_shuffled(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT_SHARE", 3)
    rows = _rows(60)
    found, books = codes.compress(_table(spark, rows), rounds=2)
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], codes.digest(books)) for r in found.collect()], key=repr) == _brute_codes(rows, rounds=2)


def test_centroids(spark):
    rows = _rows(150, seed=2)
    found, _ = centroids.cluster_vectors(_table(spark, rows))
    got = [(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found.collect()]
    assert sorted(got, key=repr) == _brute_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few(spark, n):
    rows = _rows(5)[:n]
    df = _table(spark, rows)
    found, books = codes.compress(df)
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], codes.digest(books)) for r in found.collect()], key=repr) == _brute_codes(rows)
    got = [(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in centroids.cluster_vectors(df)[0].collect()]
    assert sorted(got, key=repr) == _brute_clusters(rows)


def test_only_bad_rows(spark):
    df = _table(spark, [(1, None, 0), (2, [NAN] * 64, 1), (3, [None] * 64, None)])
    assert codes.compress(df)[0].count() == 0 and centroids.cluster_vectors(df)[0].count() == 0
    assert dimension(df.limit(0), 8) == 0


def test_masks_hold_the_nearest():
    """Masks leave few entries where these lie apart, and never lose one within the radius."""
    rng = np.random.default_rng(3)
    entries = rng.integers(-10_000, 10_000, (64, 8))
    x = entries[rng.integers(0, 64, 500)] + rng.integers(-300, 300, (500, 8))
    s = codes.Slices(entries)
    d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    radius = np.full(500, 4000)
    mask = s.candidates(x, radius)
    inside = (np.abs(x[:, None, :] - entries[None]) <= radius[:, None, None]).all(2)
    assert (((mask[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool) == inside).all()
    code, best = s.nearest(x)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
    assert inside.sum(1).mean() < 4


def test_ties_take_the_lower():
    s = codes.Slices(np.array([[5, 0], [0, 0], [0, 0], [10, 0]]))
    code, best = s.nearest(np.array([[0, 0], [5, 1], [7, 0], [8, 0], [-100, 3]]))
    assert code.tolist() == [1, 0, 0, 3, 1] and best.tolist() == [0, 1, 4, 4, 10009]


def test_dictionaries_lose_nothing(spark):
    rows = _rows(100, dim=20)
    df = written(whole(_table(spark, rows), 1024, 20))
    back, entries, n = [], 0, 0
    for r in centroids.encode(df.coalesce(1), 20, 8, 64).collect():
        s = centroids.Stretch(r["ids"], r["codes"], r["entries"], 20, 8, "<u2")
        x = np.concatenate([e[s.codes[:, b]] for b, e in enumerate(s.entries)], axis=1)
        back += list(zip(r["ids"], map(tuple, x.tolist()), strict=True))
        entries += len(s.entries[0])
        n += len(x)
        cluster, d = s.nearest(x[:3])
        full = ((x[:, None, :] - x[None, :3]) ** 2).sum(2)
        assert (cluster == full.argmin(1)).all() and (d == full.min(1)).all()
        sums = s.sums(cluster, 3)
        assert all((sums[c, :20] == x[cluster == c].sum(0)).all() and sums[c, 20] == (cluster == c).sum() for c in range(3))
    assert sorted(back, key=repr) == sorted(((r["vec_id"], tuple(r["x"])) for r in df.collect()), key=repr)
    assert entries < 0.8 * n  # copies share an entry


@pytest.mark.parametrize("module", [codes, centroids])
def test_sql(spark, module):
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(module.sql().replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'"))
    got = module.QUERY(spark, sf)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
