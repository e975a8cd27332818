"""Best-fit packing of token sequences, certified by lower bounds.

Pieces are dealt into partitions of bounded size.  Each partition runs best-fit
decreasing and compares its bin count with lower bounds from dual-feasible
functions.  Where a gap remains, the loosest bins give their pieces back; eight
partitions' pieces meet in the next round and are packed again.  A round's
result is taken only if it needs no more bins than it was given.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from gridspark.llm.common import ids_and_text, table, trim, written
from gridspark.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
PART_ROWS = 20_000
MERGE = 8
#: Of the bins of a partition with a gap, the share that gives its pieces back.
RELEASED = 1 / MERGE


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and offset of each size (1 to capacity), and the number of bins; ties in given order."""
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    left = 0  # bit r: a bin with r left
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = left >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                left &= ~(1 << r)
        else:
            r, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - r
        r -= s
        if r:
            room[r].append(b)
            left |= 1 << r
    return bins, offsets, n


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest of the bounds that dual-feasible functions give."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    # f_e: below e nothing, above capacity - e a whole bin, between its size
    n_from = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])
    sum_from = np.concatenate([np.cumsum((count * size)[::-1])[::-1], [0]])
    e = np.arange(1, capacity // 2 + 1)
    whole = n_from[capacity - e + 1]
    between = sum_from[e] - sum_from[capacity - e + 1]
    best = max(best, int((whole + -(-between // capacity)).max()))
    # u_k: sizes rounded down to k-ths, but for exact (k+1)-ths
    for k in range(1, 64):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        value = np.where(exact, k * size, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of a whole text's ids and end_id.

    A document longer than the capacity is cut; its first piece is the shorter one.
    Repeated rows give their pieces again, a null or empty text a piece of the end
    alone, an empty table none; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            numbers = b["doc_id"].to_pylist()
            for first, last, ids, per in enc.encode(b["text"]):
                raw = np.insert(ids, per[1:], np.uint32(end_id)).astype("<u4").tobytes()
                cols: list[list[int]] = [[], [], [], [], []]
                begin = 0
                for doc, n in zip(numbers[first:last], (np.diff(per) + 1).tolist(), strict=True):
                    at, size, piece = 0, n % capacity or capacity, 0
                    while at < n:
                        crc = zlib.crc32(raw[4 * (begin + at) : 4 * (begin + at + size)])
                        for c, v in zip(cols, (doc, piece, at, size, crc), strict=True):
                            c.append(v)
                        at, size, piece = at + size, capacity, piece + 1
                    begin += n
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return ids_and_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _rerun(number: int, last: bool, capacity: int):
    """Packs one partition again; keeps its earlier places if they need fewer bins."""

    def rerun(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(sizes, capacity)
        base = (number << 54) | (int(key[0]) << 22)
        if number == 0 or used <= rows["sequence_id"].nunique():
            rows = rows.assign(sequence_id=base + bins, offset=offsets)
        ids, where = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
        fill = np.bincount(where, weights=sizes)
        back = np.zeros(len(ids), dtype=bool)
        if not last and len(ids) > lower_bound(sizes, capacity):
            back[np.argsort(fill, kind="stable")[: max(2, int(len(ids) * RELEASED))]] = True
        return rows.assign(released=back[where])

    return rerun


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows with length (1 to capacity); all rows and columns stay, whatever the columns' names.

    Full pieces need no packing.  The partitions' number follows the number of
    rows, so that none holds much more than ``part_rows``, whatever is equal among them.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # under names of our own meanwhile, which no other column has
    own = ["length" if c == "length" else f"column_{i}" for i, c in enumerate(kept)]
    pieces = written(pieces.select(*map(_named, kept)).toDF(*own))
    full = pieces.filter(F.col("length") == capacity).select("*", (F.monotonically_increasing_id() + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    n = rest.count()
    parts = max(1, -(-n // part_rows))
    spread = F.pmod(F.xxhash64(*own, F.monotonically_increasing_id()), F.lit(parts))
    todo = rest.select("*", F.lit(-1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), spread.cast("long").alias("part"))
    schema = StructType([*todo.schema.fields, StructField("released", BooleanType())])
    out = full
    number = 0
    while True:
        last = parts == 1
        packed = written(todo.groupBy("part").applyInPandas(_rerun(number, last, capacity), schema))
        out = out.unionByName(packed.filter(~F.col("released")).drop("part", "released"))
        if last or packed.filter("released").isEmpty():
            break
        parts, number = -(-parts // MERGE), number + 1
        todo = packed.filter("released").drop("released").withColumn("part", F.floor(F.col("part") / MERGE))
    return out.toDF(*kept, "sequence_id", "offset")


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), 0))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: every document's pieces with their places."""
    return pack(token_pieces(docs, tokenizer_path(), 0))
