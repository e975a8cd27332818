"""Exact quantiles of groups of any size.

A bounded sketch brackets each quantile, then only the values inside the bracket are
counted by value and ranked.  No group's values ever meet in one task as they do in an
exact percentile aggregate: what is ranked is about 8 in ``ACCURACY`` of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.safe import masked_invalid

#: The sketch's rank error is one in this many rows; its size a group and series follows from it.
ACCURACY = 10_000


def join_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Joins one row a group to rows of the groups; a NULL group meets itself."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({b: f"{b}__r" for b in by})
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{b}__r")) for b in by])
    return left.join(other, on).drop(*[f"{b}__r" for b in by])


def quantiles(df: DataFrame, series: dict[str, Column], points: list[float], by: list[str] | None = None) -> DataFrame:
    """One row a group: for each series an array of its values at the points, between neighbours by a line.

    NULL, NaN and infinite values are left out; a series without values gives NULLs.
    """
    by, names = list(by or []), list(series)
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("s__"), c.cast("double").alias("v__")) for k, c in enumerate(series.values())])).alias("x__"))
    long = long.select(*by, "x__.s__", masked_invalid(F.col("x__.v__")).alias("v__"))
    margin = 4.0 / ACCURACY
    cuts = F.array(*[F.lit(min(1.0, max(0.0, p + m))) for p in points for m in (-margin, margin)])
    found = long.groupBy(*by, "s__").agg(F.count("v__").alias("n__"), F.percentile_approx("v__", cuts, F.lit(ACCURACY)).alias("q__"))
    # below (-1) and above (1) the bracket values are only counted, and the nearest to it is known
    v, q = F.col("v__"), F.col("q__")
    sides = [F.when(v.isNull(), 2).when(v < q[2 * i], -1).when(v > q[2 * i + 1], 1).otherwise(0) for i in range(len(points))]
    filed = F.array(*[F.struct(F.lit(i).alias("i__"), F.lit(p).cast("double").alias("p__"), s.alias("side__"), F.when(s == 0, v).alias("key__")) for i, (p, s) in enumerate(zip(points, sides, strict=True))])
    each = join_groups(long, found, [*by, "s__"]).select(*by, "s__", "n__", "v__", F.explode(filed).alias("x__")).select(*by, "s__", "n__", "v__", "x__.*")
    own = [*by, "s__", "i__"]
    counted = each.groupBy(*own, "p__", "n__", "side__", "key__").agg(F.count("*").alias("c__"), F.min("v__").alias("lo__"), F.max("v__").alias("hi__"))
    upto = F.sum("c__").over(Window.partitionBy(*own).orderBy("side__", "key__"))
    ranked = counted.withColumns({"upto__": upto, "at__": F.col("p__") * (F.col("n__") - 1)})

    def value(rank: Column) -> Column:
        """The value of a rank (from 1), kept by the one row that holds it."""
        here = (F.col("upto__") >= rank) & (F.col("upto__") - F.col("c__") < rank)
        known = F.when(F.col("side__") == 0, F.col("lo__")).when((F.col("side__") < 0) & (F.col("upto__") == rank), F.col("hi__")).when((F.col("side__") > 0) & (F.col("upto__") - F.col("c__") + 1 == rank), F.col("lo__"))
        return F.max(F.when(here & (F.col("n__") > 0), F.coalesce(known, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))))

    one = ranked.groupBy(*own).agg(value(F.floor("at__") + 1).alias("a__"), value(F.ceil("at__") + 1).alias("b__"), F.first("at__").alias("at__"))
    got = one.select(*own, (F.col("a__") + (F.col("b__") - F.col("a__")) * (F.col("at__") - F.floor("at__"))).alias("v__"))
    at = [F.array(*[F.max(F.when((F.col("s__") == k) & (F.col("i__") == i), F.col("v__"))) for i in range(len(points))]).alias(n) for k, n in enumerate(names)]
    return got.groupBy(*by).agg(*at)


def medians(df: DataFrame, series: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """One row a group: the median of each series."""
    q = quantiles(df, series, [0.5], by)
    return q.select(*(by or []), *[F.col(n)[0].alias(n) for n in series])
