"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from gridspark.session import ship

#: Separators of words in the query contracts: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows that go to a Python worker at once; Spark's own 10,000 rows of long texts would fill it.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(ship(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's Arrow batches to ARROW_ROWS where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, the folder that driver and executors share.

    Only where the setting is absent and all runs on one machine (tests) a
    temporary folder of this machine serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            base = f"file://{tempfile.mkdtemp(prefix='gridspark-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder; cuts the lineage.

    Unlike a cached plan it survives lost executors, and unlike a second use
    of the plan it never repeats the work.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so that other columns are never read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def trim() -> None:
    """Gives memory that a task no longer uses back to the machine; a worker that goes on to other stages stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that isn't taken (Spark's names don't tell case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def with_columns(docs: DataFrame, fields: list[StructField], start: Callable[[], Callable[[pa.RecordBatch], list[list]]]) -> DataFrame:
    """All columns of docs, whatever their names, and new ones: ``start`` is called once a task and gives what makes their values from a batch.

    No name of ``fields`` may be a column of docs.  In a batch, text keeps its name.
    """
    own = docs.toDF(*["text" if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)])
    out = StructType([*own.schema.fields, *(StructField(f"new_{k}", f.dataType) for k, f in enumerate(fields))])
    arrow = to_arrow_schema(out)
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for b in batches:
            columns = [b.column(i).cast(arrow.field(i).type) for i in range(n)]
            new = [pa.array(x, arrow.field(n + k).type) for k, x in enumerate(of(b))]
            yield pa.RecordBatch.from_arrays([*columns, *new], schema=arrow)
        trim()

    return own.mapInArrow(run, out).toDF(*docs.columns, *[f.name for f in fields])


def held_out() -> F.Column:
    """Rows that no model learns from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1) of the rows that models learn from."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter(~held_out())


#: Bits of the map in which a doc_id is looked up before its text is shuffled.
MAP_BITS = 1 << 25


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids, and few others: a bitmap of hashes of one size tells; it spares the texts of other rows the shuffle."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    bits = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    own = docs.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "bucket")
    return own.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*docs.columns)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Every learnable row with a text that isn't empty: label, text, its bytes and its hash h; ``at`` deals out rows, copies too.

    A doc_id's equal labels are one; texts meet labels by a shuffle, whatever the tables' sizes.
    """
    known = learnable(labels, label).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter((F.octet_length("text") > 0) & ~held_out())
    own = among(own, known).withColumns({"bytes": F.octet_length("text"), "h": F.xxhash64("text"), "at": F.xxhash64("doc_id", "text")})
    return own.join(known.hint("shuffle_hash"), "doc_id").select("label", "text", "bytes", "h", "at")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``per_class`` learnable texts of each label, and how many learnable labels there are.

    The sample is bounded so that it fits the driver: the labels with the
    smallest hashes of their doc_id, of texts with 1 to ``max_chars`` characters
    (a text is taken whole or not at all).  The picked ids are broadcast: at most
    four times ``per_class`` a label.
    """
    rows = learnable(labels, label)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    picked = None
    for k in (0, 1):
        some = rows.filter(F.col("label") == k).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.char_length("text").between(1, max_chars))
    found = texts.join(F.broadcast(picked), "doc_id").select("label", "text").distinct()
    best = None
    for k in (0, 1):
        some = found.filter(F.col("label") == k).orderBy(F.xxhash64("text")).limit(per_class)
        best = some if best is None else best.unionByName(some)
    return [(r["text"], r["label"]) for r in best.collect()], counts


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression (the last is the constant) by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    return newton(lambda w: logistic_sums(a, y, w), a.shape[1], ridge)


def logistic_sums(a: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature at ``w`` over rows that each count ``n`` times."""
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return a.T @ (n * (p - y)), (a * (n * (p * (1 - p) + 1e-9))[:, None]).T @ a


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], k: int, ridge: float = 1e-2) -> np.ndarray:
    """The ``k`` weights at which the gradient of logistic_sums() over all rows, and the ridge's, vanish."""
    w = np.zeros(k)
    for _ in range(50):
        g, h = sums(w)
        d = np.linalg.solve(h + ridge * np.eye(k), g + ridge * w)
        w -= np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-8:
            break
    return w


_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes between words: the six ASCII separators; or all ASCII but letters and digits.
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str], gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts in a row (A-Z lowered), and where each text's begin (one more than texts).

    Works on the bytes of all texts at once: a word's hash is the sum of its
    byte values times powers of an odd base.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    gap = gaps[data]
    if gap.all():
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    word = ~gap
    first = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    after = np.flatnonzero(gap & np.concatenate([[False], word[:-1]]))
    length = after - first
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(data)]])))
    powers = np.full(int(length.max()) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    value = np.where(word, _BYTE[data] * powers[np.where(word, place, 0)], np.uint64(0))
    run = np.cumsum(value, dtype=np.uint64)
    h = mix(run[after - 1] - run[first] + value[first] + length.astype(np.uint64))
    per = np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(texts))
    return h, np.concatenate([[0], np.cumsum(per)])


def split(texts: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``most`` characters."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def order_classes(counts: np.ndarray) -> np.ndarray:
    """A class from 0 to 15 for each bucket, by how far its count stands above the usual one."""
    usual = max(1.0, float(np.median(counts)))
    return np.clip(np.ceil(np.log2(np.maximum(counts / usual, 1.0)) * 2), 0, 15).astype(np.uint64)


#: Pieces of a task's array, and tasks whose pieces are summed together in a first round.
CHUNKS = 64
TOGETHER = 256


def array_sum(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, real: bool = False) -> np.ndarray:
    """The sum of the arrays (of one ``length``; whole numbers below 2**32, or ``real`` ones) that ``of`` makes of each task's rows.

    Arrays travel in pieces and are summed in two rounds by shuffle; the driver gets one sum.
    """
    step = -(-length // CHUNKS)
    # real sums are made in double precision, but travel as they came
    sent, summed, to = ("<f4", "<f8", "<f4") if real else ("<u4", "<i8", "<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = of(batches).astype(sent).ravel()
        if total.any():
            pieces = [total[i * step : (i + 1) * step].tobytes() for i in range(CHUNKS)]
            some = [TaskContext.get().partitionId() // TOGETHER] * CHUNKS
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(some, pa.int32()), pa.array(pieces, pa.binary())], names=["chunk", "some", "x"])
        trim()

    def add(kind: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(rows["x"].iloc[0]) // np.dtype(kind).itemsize, dtype=summed)
            for r in rows["x"]:
                total += np.frombuffer(r, dtype=kind)
            return pd.DataFrame({"chunk": [key[0]], "some": [0], "x": [total.astype(to).tobytes()]})

        return sums

    schema = "chunk int, some int, x binary"
    parts = df.mapInArrow(run, schema).groupBy("chunk", "some").applyInPandas(add(sent), schema).groupBy("chunk").applyInPandas(add(to), schema)
    out = np.zeros(length, dtype=to)
    for r in parts.collect():
        out[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(r["x"], dtype=to)
    trim()
    return out
