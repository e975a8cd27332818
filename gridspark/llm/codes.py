"""Vector code compression: a code a part, its nearest entry found by slices and masks.

A vector is cut into equal parts; a part's code is the index of its nearest
entry in a codebook of up to 64 entries.  Of every dimension of a codebook the
coordinates are kept sorted, with a prefix mask at each place: the bits of the
entries before it.  The distance to one entry is an initial radius.  Entries
within it have every coordinate within it, so two binary searches a dimension
give a range, the difference of two prefix masks the entries of the range, and
the AND of all dimensions the only entries that can be as near.  These are
compared exactly, so a code is always that of the nearest entry.

Vectors are read by tasks; the driver holds codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table, trim, written
from gridspark.llm.vectors import dimension, long_sums, matrix, whole

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: A label of more than this share of all rows is joined by broadcast: there are fewer than 1,000 of these.
HOT_SHARE = 1000


class Slices:
    """One codebook, its coordinates sorted by dimension with prefix masks of entries."""

    def __init__(self, entries: np.ndarray):
        if not 0 < len(entries) <= 64:
            raise ValueError("a codebook has 1 to 64 entries")
        self.entries = np.asarray(entries, dtype=np.int64)
        self.order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.entries, self.order, 0).T)
        bits = np.uint64(1) << self.order.astype(np.uint64)
        before = np.zeros((1, bits.shape[1]), dtype=np.uint64)
        self.prefix = np.ascontiguousarray(np.concatenate([before, np.bitwise_or.accumulate(bits, axis=0)]).T)
        #: the dimension in which the entries lie farthest apart
        self.widest = int(np.argmax(self.sorted[:, -1] - self.sorted[:, 0]))

    def start(self, x: np.ndarray) -> np.ndarray:
        """An entry for each row: the one nearest in the widest dimension."""
        line, q = self.sorted[self.widest], x[:, self.widest]
        after = np.clip(np.searchsorted(line, q), 0, len(line) - 1)
        before = np.maximum(after - 1, 0)
        return self.order[np.where(q - line[before] < line[after] - q, before, after), self.widest]

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row a mask of the entries that are within ``radius`` in every dimension."""
        mask = np.full(len(x), ~np.uint64(0))
        for j, line in enumerate(self.sorted):
            low = np.searchsorted(line, x[:, j] - radius, side="left")
            high = np.searchsorted(line, x[:, j] + radius, side="right")
            mask &= self.prefix[j][high] ^ self.prefix[j][low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (ties: the lower index) and its squared distance."""
        first = self.entries[self.start(x)]
        radius = np.sqrt(((x - first) ** 2).sum(1).astype(np.float64)).astype(np.int64) + 1  # never below the root
        mask = self.candidates(x, radius)
        code, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(mask & (np.uint64(1) << np.uint64(e)))
            d = ((x[rows] - entry) ** 2).sum(1)
            nearer = d < best[rows]
            rows = rows[nearer]
            code[rows], best[rows] = e, d[nearer]
        return code, best


def _slices(books: np.ndarray) -> list[Slices]:
    return [Slices(b) for b in books]


def fit(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) for rows of ``whole``, which are read once a round.

    They start as the parts of the vectors with the smallest vec_ids (null ids
    last; equal ids by their vectors); fewer vectors make fewer entries, none an
    array without entries.  Repeated rows count each time.
    """
    starts = [r["x"] for r in rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    width = dim // parts
    books = np.array(starts, dtype=np.int64).reshape(len(starts), parts, width).transpose(1, 0, 2)
    k = len(starts)

    for _ in range(rounds if k else 0):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> np.ndarray:
            found = _slices(books)
            total = np.zeros((parts, k, width + 1), dtype=np.int64)
            for b in batches:
                x = matrix(b.column(0), dim)
                for p, s in enumerate(found):
                    mine = x[:, p * width : (p + 1) * width]
                    code, _ = s.nearest(mine)
                    np.add.at(total[p], (code, slice(0, width)), mine)
                    total[p, :, width] += np.bincount(code, minlength=k)
            return total.ravel()

        got = np.array(long_sums(rows.select("x"), sums, parts * k * (width + 1)), dtype=object).reshape(parts, k, width + 1)
        for p in range(parts):
            for e in range(k):
                if n := got[p, e, width]:
                    books[p, e] = [int(s // n) for s in got[p, e, :width]]
    return books


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed) of rows of ``whole``."""
    parts, _, width = books.shape
    names = ["vec_id", "label"]
    fields = rows.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _slices(books)
        for b in batches:
            x = matrix(b.column(2), parts * width)
            got = [s.nearest(x[:, p * width : (p + 1) * width]) for p, s in enumerate(found)]
            codes = np.column_stack([c for c, _ in got]).astype(np.uint8).tobytes().hex()
            text = [codes[i : i + 2 * parts] for i in range(0, len(codes), 2 * parts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(sum(d for _, d in got), pa.int64())], names=[*names, "code", "error"])
        trim()

    schema = fields.add("code", "string").add("error", "long")
    return rows.select(*names, "x").mapInArrow(run, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: ``error`` summed over the rows of a label (null labels are one; null where the sum fits no long).

    Sums are made within tasks first.  Labels with a large share of all rows are
    few by definition and are joined by broadcast; the others are shuffled by label.
    """
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n"), F.expr("try_cast(sum(cast(error as decimal(20,0))) as bigint)").alias("label_error")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    same = F.col("label").eqNullSafe(F.col("of"))
    few, rest = F.broadcast(sums.filter(hot)), sums.filter(~hot)
    return coded.join(few, same).unionByName(coded.join(few, same, "left_anti").join(rest, same)).drop("of", "n")


def digest(books: np.ndarray) -> str:
    """Lower-case hex sha256 of all components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds ``x``: the whole numbers that a code stands for (null for a null code)."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in b]) for b in books])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    parts = [F.get(F.get(flat, F.lit(p)), at(p)) for p in range(len(books))]
    return coded.withColumn("x", F.when(F.col("code").isNotNull(), F.concat(*parts)))


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, label_error of each vector, and the codebooks.

    Vectors of another length than the table's commonest that ``parts`` divides
    have no code and are left out, as are those that ``whole`` leaves out.  An
    empty table gives no rows and codebooks without entries.
    """
    dim = dimension(vectors, parts)
    rows = written(whole(vectors, scale, dim or parts))
    books = fit(rows, dim or parts, parts, entries, rounds)
    coded = written(assign(rows, books)) if books.size else rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return with_label_error(coded), books


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same for DuckDB, a step a round, for vectors of one length and vec_ids told apart."""
    steps = [
        "kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "dims AS (SELECT vec_id, label, len(embedding) // %d AS w, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS c FROM kept)" % parts,
        f"x AS MATERIALIZED (SELECT vec_id, (i // w)::INT AS p, (i %% w)::INT AS j, floor({scale} * c)::BIGINT AS v FROM dims)".replace("%%", "%"),
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
        "c0 AS MATERIALIZED (SELECT p, e, j, v FROM x JOIN firsts USING (vec_id))",
    ]
    near = "a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, x.p, e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c ON x.p = c.p AND x.j = c.j GROUP BY ALL) GROUP BY ALL)"
    for r in range(rounds):
        steps.append(near.format(r=r))
        steps.append(
            f"m{r} AS (SELECT x.p, e, j, sum(v)::HUGEINT AS s, count(*) AS n FROM x JOIN a{r} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL),\n"
            f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, c.j, CASE WHEN n IS NULL THEN v ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS v FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e AND c.j = m.j)"
        )
    steps.append(near.format(r=rounds))
    steps.append("coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{r} GROUP BY vec_id)".format(r=rounds))
    steps.append(f"book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id) CROSS JOIN book"
