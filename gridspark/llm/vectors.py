"""What the vector operators share: whole-number vectors and exact sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components as whole numbers stay below this, so that squared distances of 64 of them fit a long.
LARGEST = 1 << 27


def whole(vectors: DataFrame, scale: int, dim: int) -> DataFrame:
    """vec_id, label (if there is one) and ``x``: floor(scale * component) of each vector of ``dim`` components.

    Vectors that are null, of another length, or hold null or non-finite
    components are left out; so are those with a component of which the whole
    number would be LARGEST or more in size, as their distances fit no long.
    Equal vec_ids stay separate rows; other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *[c for c in vectors.columns if c.lower() == "label"], F.col("embedding").cast("array<double>").alias("x"))
    fits = F.forall("x", lambda c: c.isNotNull() & (F.floor(c * scale) < LARGEST) & (F.floor(c * scale) > -LARGEST) & ~F.isnan(c))
    # floor() of a number that no long holds would fail, so plain size comes first
    near = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2 * LARGEST / scale))
    kept = v.filter((F.size("x") == dim) & near).filter(fits)
    return kept.withColumn("x", F.transform("x", lambda c: F.floor(c * scale).cast("int")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of one length as an array of longs, a row a vector."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def long_sums(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> list[int]:
    """The exact sum of the arrays of ``length`` longs that ``of`` makes of each task's rows.

    A task sends a row for each place that isn't zero; Spark sums them by place,
    and the driver gets ``length`` numbers, however many rows there were.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = of(batches)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["place", "x"])

    out = [0] * length
    for r in df.mapInArrow(run, "place int, x long").groupBy("place").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect():
        out[r["place"]] = int(r["x"])
    return out


def dimension(vectors: DataFrame, parts: int) -> int:
    """The commonest length of the vectors that ``parts`` divides (of equally common ones the smaller), 0 if there is none."""
    n = F.size("embedding")
    got = vectors.filter((n > 0) & (n % parts == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), "n").first()
    return got["n"] if got else 0
