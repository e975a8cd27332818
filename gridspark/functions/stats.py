"""Model evaluation: statistics of observed and modelled pairs as aggregates.

Rows come from a full outer join, so terms of both sides use complete pairs and
terms of one side use all valid cells of that side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.quantiles import join_groups, medians
from gridspark.safe import bias180, div, masked_invalid
from gridspark.session import stored


# Columns are made when a statistic is asked for: at import there may be no session.
def o() -> Column:
    return F.col("obs")


def m() -> Column:
    return F.col("mod")


def e() -> Column:
    return m() - o()


def c() -> Column:
    return bias180(e())


def om() -> Column:
    """The mean of all observations of the group; ``evaluate`` adds it where it is needed."""
    return F.col("obs_mean__")


def cm() -> Column:
    return bias180(m() - om())


def co() -> Column:
    return bias180(o() - om())


Agg = Callable[[], Column]


def _ratio(a: Column, b: Column, k: float = 1.0) -> Column:
    return div(a, b) * k


def _slope() -> tuple[Column, Column]:
    return F.regr_slope(m(), o()), F.regr_intercept(m(), o())


_PLAIN: dict[str, Agg] = {
    "STDO": lambda: F.stddev_pop(o()), "STDP": lambda: F.stddev_pop(m()),
    "NO": lambda: F.count(o()), "NP": lambda: F.count(m()), "NOP": lambda: F.count_if(o().isNotNull() & m().isNotNull()),
    "MO": lambda: F.avg(o()), "MP": lambda: F.avg(m()),
    "RM": lambda: F.avg(div(o(), m())),
    "MB": lambda: F.avg(e()), "WDMB": lambda: F.avg(c()),
    "NMB": lambda: _ratio(F.sum(e()), F.sum(o()), 100),
    "FB": lambda: F.avg(div(e(), m() + o())) * 200, "MNB": lambda: F.avg(div(e(), o())) * 100,
    "ME": lambda: F.avg(F.abs(e())), "WDME": lambda: F.avg(F.abs(c())),
    "NME": lambda: _ratio(F.sum(F.abs(e())), F.sum(o()), 100),
    "FE": lambda: F.avg(div(F.abs(e()), m() + o())) * 200, "MNE": lambda: F.avg(div(F.abs(e()), o())) * 100,
    "USUTPB": lambda: _ratio(F.max(m()) - F.max(o()), F.max(o()), 100), "USUTPE": lambda: _ratio(F.abs(F.max(m()) - F.max(o())), F.max(o()), 100),
    "R2": lambda: F.pow(F.corr(o(), m()), 2),
    "RMSE": lambda: F.sqrt(F.avg(e() * e())), "WDRMSE": lambda: F.sqrt(F.avg(c() * c())),
    # systematic and unsystematic parts about the regression line
    "RMSEs": lambda: F.sqrt(F.greatest(F.lit(0.0), F.avg(F.when(m().isNotNull(), F.pow(F.col("line__") - o(), 2))))),
    "RMSEu": lambda: F.sqrt(F.avg(F.pow(F.col("line__") - m(), 2))),
    "d1": lambda: 1 - _ratio(F.sum(F.abs(e())), F.sum(F.abs(m() - om()) + F.abs(o() - om()))),
    "E1": lambda: 1 - _ratio(F.sum(F.abs(e())), F.sum(F.abs(o() - om()))),
    "IOA": lambda: 1 - _ratio(F.sum(e() * e()), F.sum(F.pow(F.abs(m() - om()) + F.abs(o() - om()), 2))),
    "WDIOA": lambda: 1 - _ratio(F.sum(c() * c()), F.sum(F.pow(F.abs(cm()) + F.abs(co()), 2))),
    "AC": lambda: div(F.sum((m() - om()) * (o() - om())), F.sqrt(F.sum(F.pow(m() - om(), 2)) * F.sum(F.pow(o() - om(), 2)))),
    "WDAC": lambda: div(F.sum(cm() * co()), F.sqrt(F.sum(cm() * cm()) * F.sum(co() * co()))),
}
TWO_PASS = {"d1", "E1", "IOA", "WDIOA", "AC", "WDAC"}
ON_LINE = {"RMSEs", "RMSEu"}

#: What medians are taken of.
SERIES: dict[str, Agg] = {
    "obs": o, "mod": m, "ratio": lambda: div(o(), m()), "e": e, "abs_e": lambda: F.abs(e()), "c": c, "abs_c": lambda: F.abs(c()), "e_obs": lambda: div(e(), o()), "abs_e_obs": lambda: div(F.abs(e()), o()),
}
#: A statistic of medians: the series above the line, the one below it (or none), and the factor.
MEDIANS: dict[str, tuple[str, str | None, float]] = {
    "MdnO": ("obs", None, 1), "MdnP": ("mod", None, 1), "RMdn": ("ratio", None, 1), "MdnB": ("e", None, 1), "WDMdnB": ("c", None, 1), "NMdnB": ("e", "obs", 100), "MdnNB": ("e_obs", None, 100),
    "MdnE": ("abs_e", None, 1), "WDMdnE": ("abs_c", None, 1), "NMdnE": ("abs_e", "obs", 100), "MdnNE": ("abs_e_obs", None, 100),
}
#: Every statistic by name.
STATS = {**_PLAIN, **MEDIANS}

#: Statistics of peaks: of each group the largest values, then these over the groups.
_PEAK: dict[str, Agg] = {
    "MNPB": lambda: F.avg(div(e(), o())) * 100, "MNPE": lambda: F.avg(div(F.abs(e()), o())) * 100, "NMPB": lambda: _ratio(F.avg(e()), F.avg(o()), 100), "NMPE": lambda: _ratio(F.avg(F.abs(e())), F.avg(o()), 100),
}
_PEAK_MEDIANS: dict[str, tuple[str, str | None, float]] = {"MdnNPB": ("e_obs", None, 100), "MdnNPE": ("abs_e_obs", None, 100), "NMdnPB": ("e", "obs", 100), "NMdnPE": ("abs_e", "obs", 100)}
PEAK = ["MNPB", "MdnNPB", "MNPE", "MdnNPE", "NMPB", "NMdnPB", "NMPE", "NMdnPE"]
#: The same with the peaks taken along the first dimension, under the names of space-paired, time-unpaired peaks.
PAIRED_PEAK = [f"PSUT{k}" for k in PEAK]


#: Of so many rows in all medians are taken by the exact aggregate, in one pass with the rest.
SMALL = 100_000


def _aggregate(df: DataFrame, pairs: DataFrame, names: list[str], by: list[str], plain: dict[str, Agg], of_medians: dict[str, tuple[str, str | None, float]], small: bool) -> DataFrame:
    """Plain aggregates in one aggregation; medians of many rows by their own bounded ranking, joined by group."""
    sums = [n for n in names if n in plain]
    if small:
        middle = lambda s: F.median(masked_invalid(SERIES[s]().cast("double")))
        one = {n: middle(above) * k if not below else div(middle(above), middle(below)) * k for n, (above, below, k) in of_medians.items() if n in names}
        return df.groupBy(*by).agg(*[(plain[n]() if n in plain else one[n]).alias(n) for n in names])
    out = df.groupBy(*by).agg(*([plain[n]().alias(n) for n in sums] or [F.count("*").alias("n__")]))
    asked = [n for n in names if n in of_medians]
    if asked:
        used = dict.fromkeys(s for n in asked for s in of_medians[n][:2] if s)
        found = medians(pairs, {s: SERIES[s]() for s in used}, by).withColumnsRenamed({s: f"{s}__m" for s in used})
        out = join_groups(out, found, by)
        for n in asked:
            above, below, k = of_medians[n]
            top = F.col(f"{above}__m")
            out = out.withColumn(n, (div(top, F.col(f"{below}__m")) if below else top) * k)
    return out.select(*by, *names)


def evaluate(pairs: DataFrame, names: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """One row of statistics a group, from columns obs and mod.

    One aggregation; where a statistic needs the group's mean or regression line, one
    more gives these, and the few rows of groups are joined back.  Pairs that are read
    more than once are written first, so what made them runs once.
    """
    names, by = list(names or STATS), list(by or [])
    rows = pairs = pairs.select(*by, "obs", "mod")
    small = False
    if set(names) & (TWO_PASS | ON_LINE | set(MEDIANS)):
        rows = pairs = stored(pairs)
        small = pairs.count() <= SMALL
    if set(names) & (TWO_PASS | ON_LINE):
        slope, start = _slope()
        first = pairs.groupBy(*by).agg(F.avg(o()).alias("obs_mean__"), slope.alias("m__"), start.alias("b__"))
        rows = join_groups(pairs, first, by).withColumn("line__", F.col("m__") * o() + F.col("b__"))
    return _aggregate(rows, pairs, names, by, _PLAIN, MEDIANS, small)


def peaks(pairs: DataFrame, inner: list[str], names: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Statistics of the largest values of each inner group."""
    by, names = list(by or []), list(names or PEAK)
    top = pairs.groupBy(*by, *inner).agg(F.max(o()).alias("obs"), F.max(m()).alias("mod"))
    plain = _PEAK | {f"PSUT{k}": f for k, f in _PEAK.items()}
    of_medians = _PEAK_MEDIANS | {f"PSUT{k}": x for k, x in _PEAK_MEDIANS.items()}
    top = stored(top)
    return _aggregate(top, top, names, by, plain, of_medians, top.count() <= SMALL)


def table_of(one: DataFrame, names: list[str]) -> DataFrame:
    """Statistics as rows (stat, value)."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
