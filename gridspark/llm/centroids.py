"""Centroid clustering over subvector dictionaries.

Vectors are kept as codes: each block of dimensions of a stretch of rows has a
dictionary of its distinct subvectors, and a row holds one code a block, so
nothing is lost.  In a round the distance of every dictionary entry to every
centroid's block is computed once, and a vector's distance is the sum of its
codes' parts; sums for new centroids count codes by cluster first and multiply
by the dictionary.  So copies, and vectors that agree in a block, cost a lookup.

A dictionary belongs to the stretch that one task wrote, so no key gathers
rows, and a third of all rows being one vector makes the work smaller.  The
driver holds centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table, trim, written
from gridspark.llm.vectors import long_sums, matrix, whole

SCALE = 1024
DIM = 64
CENTROIDS = 8
ROUNDS = 10
#: Dimensions of a block, and rows that share dictionaries.
BLOCK = 8
STRETCH = 16384

_ENCODED = "ids array<bigint>, codes binary, entries array<binary>"


def encode(rows: DataFrame, dim: int = DIM, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """Rows of ``whole`` in stretches: their ids, a code for each block of dimensions, and the blocks' dictionaries.

    ``dim`` need not be a multiple of ``block``.  Null ids and repeated rows stay.
    """
    cuts = range(block, dim, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            x = np.concatenate(held)
            codes, entries = [], []
            for b in np.split(x, cuts, axis=1):
                distinct, code = np.unique(b, axis=0, return_inverse=True)
                codes.append(code.reshape(-1).astype("<u2" if stretch <= 1 << 16 else "<u4"))
                entries.append(distinct.astype("<i4").tobytes())
            names = pa.array([v for a in ids for v in a.to_pylist()], pa.int64())
            one = pa.ListArray.from_arrays([0, len(names)], names)
            return pa.RecordBatch.from_arrays([one, pa.array([np.column_stack(codes).tobytes()], pa.binary()), pa.array([entries], pa.list_(pa.binary()))], names=["ids", "codes", "entries"])

        n = 0
        for b in batches:
            ids.append(b.column(0))
            held.append(matrix(b.column(1), dim))
            n += b.num_rows
            if n + b.num_rows > stretch:
                yield flush()
                ids, held, n = [], [], 0
        if n:
            yield flush()
        trim()

    return rows.select("vec_id", "x").mapInArrow(run, _ENCODED)


class Stretch:
    """One encoded stretch of rows."""

    def __init__(self, ids: pa.Array, codes: bytes, entries: list[bytes], dim: int, block: int, kind: str):
        self.ids = ids
        widths = [min(block, dim - at) for at in range(0, dim, block)]
        self.codes = np.frombuffer(codes, dtype=kind).reshape(-1, len(widths))
        self.entries = [np.frombuffer(e, dtype="<i4").reshape(-1, w).astype(np.int64) for e, w in zip(entries, widths, strict=True)]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (ties: the smaller number) and its squared distance."""
        total, at = np.zeros((len(self.codes), len(centroids)), dtype=np.int64), 0
        for b, e in enumerate(self.entries):
            w = e.shape[1]
            parts = ((e[:, None, :] - centroids[None, :, at : at + w]) ** 2).sum(2)  # once for each distinct subvector
            total += parts[self.codes[:, b]]
            at += w
        cluster = total.argmin(1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Component sums and numbers of rows by cluster."""
        out = []
        for b, e in enumerate(self.entries):
            m = len(e)
            times = np.bincount(cluster * m + self.codes[:, b], minlength=k * m).reshape(k, m)
            out.append(times @ e)
        return np.column_stack([*out, np.bincount(cluster, minlength=k)])


def _stretches(batches: Iterator[pa.RecordBatch], dim: int, block: int, stretch: int) -> Iterator[Stretch]:
    kind = "<u2" if stretch <= 1 << 16 else "<u4"
    for b in batches:
        for i in range(b.num_rows):
            yield Stretch(b.column(0)[i].values, b.column(1)[i].as_py(), b.column(2)[i].as_py(), dim, block, kind)


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: int = 3) -> np.ndarray:
    """The k vectors whose "seed:id" has the smallest sha256 (null ids last; equal ids by their vectors)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["x"] for r in rows.select(h.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()], dtype=np.int64)


def fit(encoded: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, block: int = BLOCK, stretch: int = STRETCH) -> np.ndarray:
    """Centroids after ``rounds`` of assigning all rows and taking floors of means; an empty one stays."""
    k, dim = centroids.shape
    centroids = centroids.copy()
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> np.ndarray:
            total = np.zeros((k, dim + 1), dtype=np.int64)
            for s in _stretches(batches, dim, block, stretch):
                total += s.sums(s.nearest(now)[0], k)
            return total.ravel()

        got = np.array(long_sums(encoded, sums, k * (dim + 1)), dtype=object).reshape(k, dim + 1)
        for c in range(k):
            if n := got[c, dim]:
                centroids[c] = [int(s // n) for s in got[c, :dim]]
    return centroids


def assign(encoded: DataFrame, centroids: np.ndarray, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """vec_id, cluster and squared distance of each encoded row."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches, dim, block, stretch):
            cluster, d = s.nearest(centroids)
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])
        trim()

    return encoded.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector, and the centroids.

    Rows that ``whole`` leaves out have no cluster.  Fewer vectors than ``k`` make
    fewer clusters, an empty table gives no rows; repeated rows count each time.
    A sum that fits no long is null.
    """
    rows = written(whole(vectors, scale, dim))
    start = first_centroids(rows, k, seed)
    if not len(start):
        null = [F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return rows.select("vec_id", *null), start
    encoded = written(encode(rows, dim))
    centroids = fit(encoded, start, rounds)
    found = written(assign(encoded, centroids))
    # one row a cluster, so at most k rows are broadcast
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    sums = {r["cluster"]: int(r["s"]) for r in by.collect()}
    fits = lambda s: s if s < 1 << 63 else None
    about = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    few = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 3) -> str:
    """The same for DuckDB, a step a round, for vec_ids told apart."""
    steps = [
        f"kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, j, floor({scale} * c)::BIGINT AS v FROM (SELECT vec_id, unnest(range({dim})) AS j, unnest(embedding)::DOUBLE AS c FROM kept))",
        f"firsts AS (SELECT vec_id, (row_number() OVER (ORDER BY h) - 1)::INT AS e FROM (SELECT vec_id, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k}))",
        "c0 AS MATERIALIZED (SELECT e, j, v FROM x JOIN firsts USING (vec_id))",
    ]
    near = "a{r} AS MATERIALIZED (SELECT vec_id, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c ON x.j = c.j GROUP BY ALL) GROUP BY ALL)"
    for r in range(rounds):
        steps.append(near.format(r=r))
        steps.append(
            f"m{r} AS (SELECT e, j, sum(v)::HUGEINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY ALL),\n"
            f"c{r + 1} AS MATERIALIZED (SELECT c.e, c.j, CASE WHEN n IS NULL THEN v ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS v FROM c{r} c LEFT JOIN m{r} m ON c.e = m.e AND c.j = m.j)"
        )
    steps.append(near.format(r=rounds))
    steps.append(f"book AS (SELECT e, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY e)")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"\nSELECT vec_id, e AS cluster, d AS distance, (sum(d) OVER (PARTITION BY e))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN book USING (e)"
    )
