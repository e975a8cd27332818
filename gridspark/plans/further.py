"""More registered queries with their SQL; ``catalog`` collects them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import geo, met, stats, times, units
from gridspark.model import Dataset, Var, idx
from gridspark.operators import combine, extract, reduce, regrid, select, window
from gridspark.plans.catalog import _CUBE, _H, _K, _NCUBE, _PAIRS, _PT, _QUERIES, _SQL, _VEC, _W, _n_cube, _spots, _weights_sql, event_cube, load, order_pairs, query, r6, vectors


def _v(spark, sf_dir) -> Dataset:
    return select.subset(event_cube(spark, sf_dir), ["v"])


for _name, _f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("var", "var_pop")):

    def _day(spark, sf_dir, name=_name):
        return r6(reduce.day_blocks(_v(spark, sf_dir), "hour", name).to_frame(), "v")

    _QUERIES[f"day_{_name}"] = _day
    _SQL[f"day_{_name}"] = _CUBE + f"SELECT (hour__i // 24)::INT AS hour__i, etype__i, round({_f}(v), 6) AS v FROM cube GROUP BY ALL"

for _name, _f in (("sum", "sum(v)"), ("var", "var_pop(v)"), ("median", "median(v)"), ("ptp", "max(v) - min(v)"), ("count", "count(v)")):

    def _more(spark, sf_dir, name=_name):
        return r6(reduce.apply_along(_v(spark, sf_dir), hour=name).to_frame(), "v")

    _QUERIES[f"reduce_{_name}"] = _more
    _SQL[f"reduce_{_name}"] = _CUBE + f"SELECT 0 AS hour__i, etype__i, round(({_f})::DOUBLE, 6) AS v FROM cube GROUP BY etype__i"

_OTHER = {
    "floordiv": ("//", "floor(a.v / nullif(b.v, 0))"), "mod": ("%", "a.v - floor(a.v / nullif(b.v, 0)) * b.v"), "lt": ("<", "(a.v < b.v)::INT"), "le": ("<=", "(a.v <= b.v)::INT"), "gt": (">", "(a.v > b.v)::INT"), "ge": (">=", "(a.v >= b.v)::INT"),
    "eq": ("==", "(a.n = b.n)::INT"), "ne": ("!=", "(a.n <> b.n)::INT"), "and": ("&", "a.n & b.n"), "or": ("|", "a.n | b.n"), "xor": ("^", "xor(a.n, b.n)"), "pow": ("**", "pow(a.n % 5, b.n % 5)"),
}
for _key, (_op, _expr) in _OTHER.items():

    def _binary(spark, sf_dir, op=_op, column="n" if ".n" in _expr else "v"):
        ds = select.subset(event_cube(spark, sf_dir), [column])
        if op == "**":
            ds = combine.apply_function(lambda c: c % 5, ds)
        half = ds.dims["hour"] // 2
        a, b = (select.slice_dims(ds, hour=slice(k, k + half)) for k in (0, half))
        out = combine.binary(op, a, b).to_frame().withColumnRenamed(column, "out")
        return r6(out, "out") if column == "v" and op in ("//", "%") or op == "**" else out.withColumn("out", F.col("out").cast("int"))

    _QUERIES[f"binary_op_{_key}"] = _binary
    _round = f"round({_expr}, 6)" if _op in ("//", "%", "**") else f"({_expr})::INT"
    _SQL[f"binary_op_{_key}"] = _CUBE + f"SELECT a.hour__i, a.etype__i, {_round} AS out FROM cube a CROSS JOIN axis JOIN cube b ON b.hour__i = a.hour__i + h // 2 AND b.etype__i = a.etype__i WHERE a.hour__i < h // 2"


# ---------------------------------------------------------------- structure


@query(_CUBE + "SELECT hour__i, etype__i, CASE WHEN v BETWEEN 20 AND 60 THEN NULL ELSE round(v, 6) END AS v, CASE WHEN n BETWEEN 20 AND 60 THEN NULL ELSE n END AS n FROM cube")
def q_mask_inside(spark, sf_dir):
    return r6(select.mask_text(event_cube(spark, sf_dir), "inside,20,60").to_frame(), "v")


@query(_CUBE + "SELECT hour__i, etype__i, CASE WHEN v > 50 AND n < 3 THEN NULL ELSE round(v, 6) END AS v, CASE WHEN v > 50 AND n < 3 THEN NULL ELSE n END AS n FROM cube")
def q_mask_where(spark, sf_dir):
    return r6(select.mask_text(event_cube(spark, sf_dir), "where,(v > 50) & (n < 3)").to_frame(), "v")


@query(_CUBE + "SELECT hour__i - 100 AS hour__i, etype__i - 1 AS etype__i, round(v, 6) AS v FROM cube WHERE hour__i BETWEEN 100 AND 219 AND etype__i BETWEEN 1 AND 3")
def q_window_from(spark, sf_dir):
    ds = _v(spark, sf_dir).set_attrs(XORIG=0.0, XCELL=1000.0, YORIG=0.0, YCELL=12000.0)
    other = {"XORIG": 100_000.0, "XCELL": 4000.0, "NCOLS": 30, "YORIG": 12_000.0, "YCELL": 4000.0, "NROWS": 9}
    return r6(select.window_from(ds, other, "hour", "etype").to_frame(), "v")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_quality_flags(spark, sf_dir):
    return select.flagged(load(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey")


@query(_CUBE + "SELECT hour__i AS t__i, etype__i, round(v, 6) AS v FROM cube")
def q_rename_dim(spark, sf_dir):
    return r6(select.rename_dims(_v(spark, sf_dir), {"hour": "t"}).to_frame(), "v")


@query(_CUBE + "SELECT a.hour__i, a.etype__i, round(a.v, 6) AS v, round(s.m, 6) AS m FROM cube a JOIN (SELECT hour__i, min(v) AS m FROM cube GROUP BY 1) s USING (hour__i)")
def q_file_master(spark, sf_dir):
    ds = select.rename_dims(_v(spark, sf_dir), {"etype": "LAY"})
    surface = select.rename_vars(reduce.apply_along(ds, LAY="min"), {"v": "m"})
    out = combine.master([ds, surface])
    rows = out.frames[("hour", "LAY")].join(out.frames[("hour", "SURFLAY")].drop(idx("SURFLAY")), idx("hour"))
    return r6(rows.withColumnRenamed(idx("LAY"), idx("etype")), "v", "m")


# ---------------------------------------------------------------- reductions and neighbourhoods


@query(_CUBE + "SELECT (hour__i // 6)::INT AS hour__i, etype__i, round(min(v - 1), 6) AS lo, round(max(v + 2), 6) AS hi FROM cube GROUP BY ALL")
def q_reduce_bounds(spark, sf_dir):
    ds = _v(spark, sf_dir)
    ds = select.new_var(select.new_var(ds, "lo", F.col("v") - 1, "v"), "hi", F.col("v") + 2, "v")
    return r6(reduce.bounds_along(ds, "hour", "lo", "hi", 6).to_frame(), "lo", "hi")


@query(_CUBE + "SELECT 0 AS hour__i, etype__i, round(sum(v * n), 4) AS v FROM cube GROUP BY etype__i")
def q_reduce_weighted_sum(spark, sf_dir):
    return reduce.weighted(event_cube(spark, sf_dir), "hour", "n").to_frame().withColumn("v", F.round("v", 4))


@query(_NCUBE + "SELECT hour__i, etype__i, sum(n) OVER (PARTITION BY etype__i ORDER BY hour__i) AS n FROM z")
def q_apply_fibres(spark, sf_dir):
    import numpy as np

    ds = _n_cube(spark, sf_dir)
    return reduce.apply_fibres(ds, "hour", np.cumsum, ds.dims["hour"]).to_frame()


@query(_CUBE + f"SELECT hour__i, etype__i, round(coalesce((v + lead(v) OVER w) / 2, v), 6) AS v FROM cube {_W}")
def q_destagger(spark, sf_dir):
    return r6(window.destagger(_v(spark, sf_dir), "hour", "v").to_frame(), "v")


@query(_NCUBE + f"SELECT * FROM (SELECT hour__i, etype__i, lead(n) OVER w - n AS n FROM z {_W}) WHERE n IS NOT NULL")
def q_interval_steps(spark, sf_dir):
    return window.steps(_n_cube(spark, sf_dir), "hour").to_frame()


def _keys(spark, sf_dir) -> Dataset:
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias(idx("k")), (F.col("n_nationkey") * F.col("n_nationkey")).cast("double").alias("x"))
    return Dataset.from_frame(n, {"k": 25}, ["x"]).set_coords("x")


@query("""WITH t AS (SELECT n_nationkey::INT AS k__i, (n_nationkey * n_nationkey)::DOUBLE AS x FROM nation), n AS (SELECT *, lag(x) OVER (ORDER BY k__i) AS p, lead(x) OVER (ORDER BY k__i) AS q FROM t)
SELECT k__i, x, coalesce((x + p) / 2, x - (q - x) / 2) AS x_bounds_lo, coalesce((x + q) / 2, x + (x - p) / 2) AS x_bounds_hi FROM n""")
def q_coordinate_bounds(spark, sf_dir):
    return window.edges(_keys(spark, sf_dir), "x").to_frame()


@query("WITH t AS (SELECT n_nationkey::INT AS k__i, (n_nationkey * n_nationkey)::DOUBLE AS x FROM nation) SELECT k__i, x, x - (SELECT max(x) / 48 FROM t) AS x_bounds_lo, x + (SELECT max(x) / 48 FROM t) AS x_bounds_hi FROM t")
def q_time_bounds(spark, sf_dir):
    return window.time_edges(_keys(spark, sf_dir), "x").to_frame()


# ---------------------------------------------------------------- regridding and lookups

_LEVELS = [1 - k / 64 for k in range(65)]
_TO = [1.0, 0.9, 0.55, 0.2, 0.0]


def _layers_sql(w: regrid.Weights) -> str:
    return _VEC + f"SELECT vec__i, j AS k__i, round(sum(v * w), 6) AS v FROM vec JOIN (VALUES {_weights_sql(w)}) AS t(i, j, w) ON k__i = i GROUP BY ALL"


_SHIFTED = [(s * 91_325.0 + 10_000.0 - 5_000.0) / 96_325.0 for s in _LEVELS]


@query(_layers_sql(regrid.linear_weights(geo.middles(_SHIFTED), geo.middles(_TO))))
def q_interp_sigma_linear(spark, sf_dir):
    return r6(regrid.interpolate_sigma(vectors(spark, sf_dir), "k", _LEVELS, _TO, 10_000.0, 5_000.0).to_frame(), "v")


@query(_layers_sql(regrid.overlap_weights(_LEVELS, _TO)))
def q_interp_sigma_conserve(spark, sf_dir):
    return r6(regrid.interpolate_sigma(vectors(spark, sf_dir), "k", _LEVELS, _TO, kind="conserve").to_frame(), "v")


_LOG_AT = [0.0, 10.25, 100.5, 700.0]


@query(_CUBE + f"SELECT j AS hour__i, etype__i, round(exp(sum(ln(v) * w)), 6) AS v FROM cube JOIN (VALUES {_weights_sql(regrid.linear_weights(list(range(702)), _LOG_AT))}) AS t(i, j, w) ON hour__i = i GROUP BY ALL")
def q_interp_log(spark, sf_dir):
    ds = _v(spark, sf_dir)
    return r6(regrid.interpolate(ds, "hour", [float(x) for x in range(ds.dims["hour"])], _LOG_AT, log=True).to_frame(), "v")


_AT = {"a": [0.5, 1.25, 3.0], "b": [2.75, 0.0, 1.5], "c": [1.0, 2.5, 2.9]}


def _trilinear_sql() -> str:
    rows = []
    for p in range(3):
        sides = [regrid.linear_weights([0, 1, 2, 3], [_AT[d][p]]) for d in "abc"]
        rows += [f"({16 * i + 4 * j + k}, {p}, {u * v * w!r}::DOUBLE)" for i, _, u in sides[0] for j, _, v in sides[1] for k, _, w in sides[2]]
    return _VEC + f"SELECT vec__i, p AS POINTS__i, round(sum(v * w), 6) AS v FROM vec JOIN (VALUES {', '.join(rows)}) AS t(i, p, w) ON k__i = i GROUP BY ALL"


@query(_trilinear_sql())
def q_interp_table_points(spark, sf_dir):
    ds = select.split_dim(vectors(spark, sf_dir), "k", {"a": 4, "b": 4, "c": 4})
    axis = [0.0, 1.0, 2.0, 3.0]
    return r6(regrid.interpolate_points(ds, "v", {d: axis for d in "abc"}, _AT).to_frame(), "v")


def _profile(spark, sf_dir) -> Dataset:
    ds = reduce.apply_along(_v(spark, sf_dir), hour="mean")
    return select.rename_dims(select.remove_singleton(ds, "hour"), {"etype": "LAY"})


_PROF = _CUBE + ", prof AS (SELECT etype__i AS LAY__i, round(avg(v), 6) AS v FROM cube GROUP BY ALL)\n"


@query(_PROF + "SELECT t.range::INT AS TSTEP__i, LAY__i, r.range::INT AS ROW__i, c.range::INT AS COL__i, v FROM prof, range(2) t, range(3) r, range(4) c")
def q_profile_to_grid(spark, sf_dir):
    return r6(regrid.to_grid(_profile(spark, sf_dir), 3, 4, 2).to_frame(), "v")


@query(_PROF + "SELECT LAY__i, p.range::INT AS PERIM__i, v FROM prof, range(18) p")
def q_profile_to_perimeter(spark, sf_dir):
    return r6(regrid.to_perimeter(_profile(spark, sf_dir), 3, 4).to_frame(), "v")


_XY = "SELECT c_custkey, ((c_custkey * 7919) % 7250)::DOUBLE / 10 AS x, ((c_custkey * 104729) % 43)::DOUBLE / 10 AS y FROM customer"


@query(_NCUBE + f""", p AS ({_XY}), c AS (SELECT *, least(floor(x), {_H} - 2)::INT AS i, least(floor(y), {_K} - 2)::INT AS j FROM p), t AS (SELECT *, x - i AS s, y - j AS u FROM c)
SELECT c_custkey, CASE WHEN x <= {_H} - 1 AND y <= {_K} - 1 THEN round(a.n * (1 - s) * (1 - u) + b.n * s * (1 - u) + d.n * (1 - s) * u + e.n * s * u, 6) END AS matched FROM t
JOIN z a ON a.hour__i = i AND a.etype__i = j JOIN z b ON b.hour__i = i + 1 AND b.etype__i = j JOIN z d ON d.hour__i = i AND d.etype__i = j + 1 JOIN z e ON e.hour__i = i + 1 AND e.etype__i = j + 1""")
def q_extract_bilinear(spark, sf_dir):
    k = F.col("c_custkey")
    p = load(spark, sf_dir, "customer").select(k, (F.pmod(k * 7919, F.lit(7250)).cast("double") / 10).alias("x"), (F.pmod(k * 104729, F.lit(43)).cast("double") / 10).alias("y"))
    ds = _n_cube(spark, sf_dir)
    axes = tuple((idx(d), [float(i) for i in range(ds.dims[d])]) for d in ("hour", "etype"))
    return r6(extract.bilinear(p, ds.to_frame(), ("x", "y"), axes, "n"), "matched").select("c_custkey", "matched")


@query(f"SELECT floor((lon + 180) / 5)::INT AS i, floor((lat + 70) / 4)::INT AS j, count(*) AS n FROM ({_PT}) GROUP BY ALL")
def q_extract_unique(spark, sf_dir):
    p = _spots(load(spark, sf_dir, "customer"), "c_custkey", 7919, 104729)
    return extract.unique_points(extract.ll2ij(p, F.col("lon"), F.col("lat"), -180, -70, 5, 4, 72, 35), ["i", "j"])


@query("""SELECT s_suppkey, s_nationkey, coalesce(n_name, (k)::VARCHAR) AS name, coalesce('unit ' || n_regionkey, '') AS unit, coalesce((n_nationkey * 0.5)::DOUBLE, 1.0) AS factor
FROM (SELECT *, s_nationkey + CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 0 END AS k FROM supplier) LEFT JOIN nation ON n_nationkey = k""")
def q_tracer_lookup(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 3).cast("int").alias("kind"))
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("name"), F.concat(F.lit("unit "), F.col("n_regionkey").cast("string")).alias("unit"), (F.col("n_nationkey") * 0.5).cast("double").alias("factor"))
    d = spark.createDataFrame([(0, 0), (1, 10)], "kind int, offset int")
    return extract.described(s, "s_nationkey", n, d, "kind").drop("kind")


# ---------------------------------------------------------------- functions


@query(_PAIRS + """, t AS (SELECT o_orderpriority, month, max(obs) AS obs, max(mod) AS mod FROM p GROUP BY ALL), x AS (SELECT *, mod - obs AS e FROM t)
SELECT o_orderpriority, round(avg(e / obs) * 100, 4) AS PSUTMNPB, round(median(e / obs) * 100, 4) AS PSUTMdnNPB, round(avg(abs(e) / obs) * 100, 4) AS PSUTMNPE, round(median(abs(e) / obs) * 100, 4) AS PSUTMdnNPE, round(avg(e) / avg(obs) * 100, 4) AS PSUTNMPB, round(median(e) / median(obs) * 100, 4) AS PSUTNMdnPB, round(avg(abs(e)) / avg(obs) * 100, 4) AS PSUTNMPE, round(median(abs(e)) / median(obs) * 100, 4) AS PSUTNMdnPE FROM x GROUP BY 1""")
def q_paired_peak_stats(spark, sf_dir):
    out = stats.peaks(order_pairs(spark, sf_dir), ["month"], stats.PAIRED_PEAK, ["o_orderpriority"])
    return out.select("o_orderpriority", *[F.round(n, 4).alias(n) for n in stats.PAIRED_PEAK])


@query("""WITH t AS (SELECT event_id, (event_id % 101)::DOUBLE / 100 AS s, 90000 + (user_id % 120)::DOUBLE * 100 AS ps FROM events)
SELECT event_id, round(s * (101325 - 5000) + 5000, 4) AS p, round(s * 1000 + (1 - s) * ps, 4) AS hybrid, round(-ln((ps / 100) / 1013.25) * 7.6, 9) AS km FROM t""")
def q_vertical_pressure(spark, sf_dir):
    s, ps = (F.col("event_id") % 101).cast("double") / 100, (F.col("user_id") % 120).cast("double") * 100 + 90_000
    return load(spark, sf_dir, "events").select("event_id", F.round(geo.pressure(s, 5_000.0), 4).alias("p"), F.round(geo.hybrid_pressure(s * 1000, 1 - s, ps), 4).alias("hybrid"), F.round(geo.standard_height(ps / 100), 9).alias("km"))


_HORNER = f"{met.WOBUS[-1]!r}::DOUBLE"
for _c in reversed(met.WOBUS[:-1]):
    _HORNER = f"({_HORNER} * t + {_c!r}::DOUBLE)"


@query(f"""WITH t AS (SELECT event_id, (event_id % 90)::DOUBLE - 45 AS t, 700 + (user_id % 300)::DOUBLE AS p FROM events), e AS (SELECT *, {met.WOBUS_E0}::DOUBLE / pow({_HORNER}, 8) AS es, 0.02::DOUBLE * (t - 12.5 + 7500 / p) AS x FROM t),
f AS (SELECT *, (1 + 4.5e-6 * p + 1.4e-3 * x * x) * es AS fe FROM e) SELECT event_id, round(es, 8) AS es, round(1000 * (0.62197 * fe / (p - fe)), 6) AS w FROM f""")
def q_met_saturation(spark, sf_dir):
    t, p = (F.col("event_id") % 90).cast("double") - 45, (F.col("user_id") % 300).cast("double") + 700
    return load(spark, sf_dir, "events").select("event_id", F.round(met.saturation_wobus(t), 8).alias("es"), F.round(met.saturation_mixing_ratio(p, t), 6).alias("w"))


@query("SELECT o_orderkey, epoch_us(date_trunc('minute', o_orderdate)) AS us FROM orders")
def q_time_pieces(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    at = times.from_pieces(F.year("t") % 100, F.month("t"), F.day("t"), F.hour("t"), F.minute("t"))
    return o.select("o_orderkey", F.unix_micros(at).alias("us"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'micrograms/m**3' WHEN 1 THEN '#/m**3' WHEN 2 THEN 'm**2/m**3' WHEN 3 THEN 'ppmV' ELSE 'micrograms/m**3' END AS profile, CASE p_partkey % 5 WHEN 0 THEN 'micrograms/m**3' WHEN 4 THEN 'g/ha' ELSE 'ppm' END AS average FROM part")
def q_species_units(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("ASO4J", "NUMATKN", "SRFACC", "O3", "ASEAPM_DD")])
    part = load(spark, sf_dir, "part").withColumn("s", F.get(names, (F.col("p_partkey") % 5).cast("int")))
    return part.select("p_partkey", units.profile_units(F.col("s")).alias("profile"), units.species_units(F.col("s"), "AVERAGE   ", ["ASO4J", "ASEAPM"]).alias("average"))


@query("""WITH r AS (SELECT l_returnflag AS flag, l_linestatus AS status, 'S' || l_linenumber AS s, round(sum(l_quantity) - 25.5 * count(*), 3) AS v FROM lineitem GROUP BY ALL)
SELECT flag, status, coalesce(string_agg(printf('%.6f %s', -v, s), ' + ' ORDER BY s) FILTER (v < 0), '') || ' <-> ' || coalesce(string_agg(printf('%.6f %s', v, s), ' + ' ORDER BY s) FILTER (v > 0), '') AS reaction FROM r GROUP BY ALL""")
def q_net_reactions(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("s")).agg(F.round(F.sum("l_quantity") - F.count("*") * 25.5, 3).alias("v"))
    return combine.reaction_texts(li, ["flag", "status"], "s", "v")
