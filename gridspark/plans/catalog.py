"""The registered queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import expr, geo, met, stats, times, units
from gridspark.model import Dataset, Var, idx
from gridspark.operators import combine, extract, reduce, regrid, select, window

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    from gridspark.plans import further, gridded, stored  # noqa: F401  they register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from gridspark.plans import further, gridded, stored  # noqa: F401

    return dict(_SQL)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded as the SQL rounds them."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


# ---------------------------------------------------------------- datasets

def event_cube(spark: SparkSession, sf_dir: str, dense: bool = True, hours: tuple[int, int] | None = None) -> Dataset:
    """(hour, etype): mean value and count of events; cells without events are masked.

    The first hour is that of the first event's day, the last that of the last
    event's day, and every kind of event has its place: one aggregate tells them.
    ``hours`` (from, to): only these hours' events are read, by bounds that reach the
    scan; the other cells are masked.
    """
    raw = load(spark, sf_dir, "events")
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts").isNotNull() & F.col("event_type").isNotNull())
    # names of kinds are as few as the dimension is long
    first, last, kinds = e.agg(F.unix_micros(F.date_trunc("day", F.min("ts"))), F.unix_micros(F.date_trunc("day", F.max("ts"))), F.array_sort(F.collect_set("event_type"))).first()
    first, n_hours = first or 0, (last - first) // 3_600_000_000 + 24 if kinds else 0
    hour = F.floor((F.unix_micros("ts") - F.lit(first)) / 3_600_000_000).cast("int")
    if hours:
        low, high = (F.timestamp_micros(F.lit(first + h * 3_600_000_000)).cast(raw.schema["ts"].dataType) for h in hours)
        e = raw.filter((F.col("ts") >= low) & (F.col("ts") < high) & F.col("event_type").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    cells = e.groupBy(hour.alias(idx("hour")), "event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]).cast("array<string>"), F.col("event_type")) - 1
    rows = cells.withColumn(idx("etype"), place.cast("int"))
    return Dataset.from_frame(rows, {"hour": n_hours, "etype": len(kinds)}, ["v", "n"], {"title": "events"}, {"v": {"units": "ppb"}, "n": {"units": "1"}}, dense=not dense)


# h hours and k kinds of event
_CUBE = """
WITH ev AS (SELECT * FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
axis AS (SELECT epoch_us(date_trunc('day', min(ts))) AS origin, (epoch_us(date_trunc('day', max(ts))) - epoch_us(date_trunc('day', min(ts)))) // 3600000000 + 24 AS h, count(DISTINCT event_type) AS k FROM ev),
kinds AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT AS etype__i FROM (SELECT DISTINCT event_type FROM ev)),
cells AS (SELECT (epoch_us(ts) - origin) // 3600000000 AS hh, event_type, avg(value) AS v, count(*) AS n FROM ev, axis GROUP BY ALL),
sparse AS (SELECT hh::INT AS hour__i, etype__i, v, n FROM cells JOIN kinds USING (event_type)),
grid AS (SELECT hour__i, unnest(range(k))::INT AS etype__i FROM (SELECT unnest(range(h))::INT AS hour__i, k FROM axis)),
cube AS (SELECT hour__i, etype__i, v, n FROM grid LEFT JOIN sparse USING (hour__i, etype__i))
"""
_H, _K = "(SELECT h FROM axis)", "(SELECT k FROM axis)"


def vectors(spark: SparkSession, sf_dir: str) -> Dataset:
    """(vec, k): the cells of all embeddings."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias(idx("vec")), F.posexplode("embedding").alias(idx("k"), "v")).withColumn("v", F.col("v").cast("double"))
    n, k = load(spark, sf_dir, "embeddings").agg(F.max("vec_id"), F.max(F.size("embedding"))).first()
    return Dataset.from_frame(e, {"vec": n + 1, "k": k}, ["v"])


_VEC = "WITH vec AS (SELECT vec_id::INT AS vec__i, (unnest(range(len(embedding))))::INT AS k__i, unnest(embedding)::DOUBLE AS v FROM embeddings)\n"


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs: an order's price; mod: its lines' charges.  Orders without lines have no mod."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("obs"), "o_orderpriority", F.date_format("o_orderdate", "yyyyMM").cast("int").alias("month"))
    m = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("mod"))
    return o.join(m, "k", "full")


_PAIRS = """
WITH m AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS mod FROM lineitem GROUP BY 1),
p AS (SELECT k, o_totalprice AS obs, mod, o_orderpriority, strftime(o_orderdate, '%Y%m')::INT AS month FROM orders o FULL JOIN m ON o.o_orderkey = m.k)
"""

# ---------------------------------------------------------------- structure


@query(_CUBE + "SELECT (hour__i - 100) // 2 AS hour__i, 0 AS etype__i, round(v, 6) AS v, n FROM cube WHERE hour__i >= 100 AND hour__i < 200 AND (hour__i - 100) % 2 = 0 AND etype__i = 1")
def q_slice_dim(spark, sf_dir):
    ds = event_cube(spark, sf_dir, hours=(100, 200))
    return r6(select.slice_text(select.slice_dims(ds, etype=1), "hour,100,200,2").to_frame(), "v")


@query(_VEC + "SELECT p.i AS points__i, round(v, 6) AS v FROM vec JOIN (VALUES (0, 3, 5), (1, 7, 0), (2, 3, 5), (3, 11, 63)) AS p(i, a, b) ON vec__i = a AND k__i = b")
def q_pointwise_extract(spark, sf_dir):
    return r6(select.slice_dims(vectors(spark, sf_dir), "points", vec=[3, 7, 3, 11], k=[5, 0, 5, 63]).to_frame(), "v")


@query("SELECT o_orderkey::INT AS order__i, o_totalprice AS totalS FROM orders")
def q_subset_rename(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias(idx("order")), F.col("o_totalprice").alias("total$"), F.col("o_custkey").alias("cust"))
    ds = Dataset.from_frame(o, {"order": 1}, ["total$", "cust"])
    return select.mangle(select.subset(ds, ["total$"])).to_frame()


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount < 0.02 OR l_discount >= 0.08 OR abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05 THEN NULL ELSE l_discount END AS d FROM lineitem")
def q_mask_range(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = load(spark, sf_dir, "lineitem").select(*keys, F.col("l_discount").alias("d"))
    c = select.mask(Dataset({}, {k: Var(()) for k in df.columns}, {(): df}, coords=frozenset(keys)), less=0.02, greater_equal=0.08, values=0.05)
    return c.to_frame(())


@query(_VEC + "SELECT vec__i, (k__i // 8) AS row__i, (k__i % 8) AS col__i, round(v, 6) AS v FROM vec")
def q_split_dim(spark, sf_dir):
    return r6(select.split_dim(vectors(spark, sf_dir), "k", {"row": 8, "col": 8}).to_frame(), "v")


@query(_VEC + "SELECT k__i, vec__i, c.range::INT AS copy__i, round(v, 6) AS v FROM vec, range(3) c")
def q_insert_dim(spark, sf_dir):
    ds = select.remove_singleton(select.insert_dim(select.insert_dim(vectors(spark, sf_dir), one=1), after="vec", copy=3))
    return r6(select.reorder(ds, ["k", "vec", "copy"]).to_frame(), "v")


# ---------------------------------------------------------------- reductions

for _name in ("min", "max", "mean", "std"):
    _f = {"min": "min", "max": "max", "mean": "avg", "std": "stddev_pop"}[_name]

    def _reduce(spark, sf_dir, name=_name):
        return r6(reduce.apply_along(select.subset(event_cube(spark, sf_dir), ["v"]), hour=name).to_frame(), "v")

    _QUERIES[f"reduce_{_name}"] = _reduce
    _SQL[f"reduce_{_name}"] = _CUBE + f"SELECT 0 AS hour__i, etype__i, round({_f}(v), 6) AS v FROM cube GROUP BY etype__i"


@query(_CUBE + "SELECT 0 AS hour__i, 0 AS etype__i, round(avg(m), 6) AS v FROM (SELECT hour__i, avg(v) AS m FROM cube GROUP BY hour__i)")
def q_reduce_mean_of_means(spark, sf_dir):
    return r6(reduce.apply_along(select.subset(event_cube(spark, sf_dir), ["v"]), hour="mean", etype="mean").to_frame(), "v")


@query(_CUBE + "SELECT 0 AS hour__i, 0 AS etype__i, max(v) AS v FROM cube")
def q_reduce_fused_max(spark, sf_dir):
    return reduce.apply_along(select.subset(event_cube(spark, sf_dir), ["v"]), hour="max", etype="max").to_frame()


@query(_CUBE + "SELECT 0 AS hour__i, etype__i, round(sum(v * n) / sum(n), 6) AS v FROM cube GROUP BY etype__i")
def q_reduce_weighted(spark, sf_dir):
    ds = select.copy_var(event_cube(spark, sf_dir), "n", "den")
    return r6(reduce.weighted(ds, "hour", "n", "den").to_frame(), "v")


@query(_CUBE + "SELECT (hour__i // 7)::INT AS hour__i, etype__i, round(avg(v), 6) AS v FROM cube GROUP BY ALL")
def q_mesh_coarsen(spark, sf_dir):
    return r6(reduce.coarsen(select.subset(event_cube(spark, sf_dir), ["v"]), "hour", 7, "mean").to_frame(), "v")


@query(_CUBE + "SELECT (hour__i * 3 + r.range)::INT AS hour__i, etype__i, round(v, 6) AS v FROM cube, range(3) r")
def q_mesh_refine(spark, sf_dir):
    return r6(reduce.refine(select.subset(event_cube(spark, sf_dir), ["v"]), "hour", 3).to_frame(), "v")


@query(_CUBE + "SELECT (hour__i // 24)::INT AS hour__i, etype__i, round(stddev_pop(v), 6) AS v FROM cube GROUP BY ALL")
def q_day_std(spark, sf_dir):
    return r6(reduce.day_blocks(select.subset(event_cube(spark, sf_dir), ["v"]), "hour", "std").to_frame(), "v")


_RUN8 = """run AS (SELECT hour__i, etype__i, CASE WHEN count(v) OVER w >= 6 THEN avg(v) OVER w END AS m FROM cube
  WINDOW w AS (PARTITION BY etype__i ORDER BY hour__i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))"""


@query(_CUBE + f", {_RUN8} SELECT (hour__i // 24)::INT AS hour__i, etype__i, round(max(m), 6) AS v FROM run WHERE hour__i < ({_H} - 7) // 24 * 24 GROUP BY ALL")
def q_mda8(spark, sf_dir):
    return r6(reduce.mda8(select.subset(event_cube(spark, sf_dir), ["v"]), "hour").to_frame(), "v")


@query("SELECT extract('hour' FROM ts)::INT AS hour, min(value) AS v_min, round(avg(value), 6) AS v_mean, max(value) AS v_max, count(value) AS n, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY 1")
def q_diurnal(spark, sf_dir):
    return r6(reduce.group_stats(load(spark, sf_dir, "events"), [F.hour("ts").alias("hour")], "value", (0.25, 0.5, 0.75)), "v_mean", "p25", "p50", "p75")


@query("SELECT coalesce(p_brand, '') AS p_brand, coalesce(p_type, '') AS p_type, round(sum(p_retailprice), 4) AS price FROM part GROUP BY CUBE (p_brand, p_type)")
def q_osat_rollup(spark, sf_dir):
    return reduce.tagged_sums(load(spark, sf_dir, "part").withColumnRenamed("p_retailprice", "price"), ["p_brand", "p_type"], "price", []).withColumn("price", F.round("price", 4))


@query("""WITH a AS (SELECT quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
b AS (SELECT quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM events WHERE event_type = (SELECT max(event_type) FROM events))
SELECT i.range::INT AS i, round(a.q[i.range + 1], 6) AS qa, round(b.q[i.range + 1], 6) AS qb FROM a, b, range(5) i""")
def q_qq_quantiles(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    lo, hi = (e.join(e.agg(f("event_type").alias("event_type")), "event_type") for f in (F.min, F.max))
    return r6(reduce.quantile_pairs(lo, hi, "value", [0.1, 0.25, 0.5, 0.75, 0.9]), "qa", "qb")


@query("""WITH e AS (SELECT ((user_id * 37) % 360)::DOUBLE AS d, value FROM events), t AS (SELECT count(*) AS n FROM e)
SELECT floor(((d + 22.5) % 360) / 45)::INT AS sector, round(count(*) FILTER (value < 10) * 100.0::DOUBLE / max(n), 6) AS below_0, round(count(*) FILTER (value < 50) * 100.0::DOUBLE / max(n), 6) AS below_1, round(count(*) FILTER (value < 1000) * 100.0::DOUBLE / max(n), 6) AS below_2 FROM e, t GROUP BY 1""")
def q_wind_rose(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.pmod(F.col("user_id") * 37, F.lit(360)).cast("double").alias("d"), "value")
    return r6(reduce.wind_rose(e, "d", "value", 8, [10.0, 50.0, 1000.0]), "below_0", "below_1", "below_2")


@query("SELECT (epoch_us(ts) // 300000000)::BIGINT AS bin, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def q_time_window_mean_count(spark, sf_dir):
    w = load(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "300 seconds")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return r6(w.select(F.floor(F.unix_micros("window.start") / 300_000_000).alias("bin"), "mean", "n"), "mean")


@query("SELECT CASE WHEN epoch_us(ts) % 3600000000 = 0 THEN epoch_us(ts) // 3600000000 - 1 ELSE epoch_us(ts) // 3600000000 END AS bin, event_type, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def q_hour_bins_closed_right(spark, sf_dir):
    b = F.floor(F.unix_micros(times.hour_bin(F.col("ts"))) / 3_600_000_000).alias("bin")
    return r6(load(spark, sf_dir, "events").groupBy(b, "event_type").agg(F.avg("value").alias("mean")), "mean")


@query("""WITH l AS (SELECT k.range AS layer, (ARRAY[50.5, 40, 25, 10, 1])[k.range + 1] AS hi, (ARRAY[50.5, 40, 25, 10, 1])[k.range + 2] AS lo FROM range(4) k),
g AS (SELECT DISTINCT l_returnflag FROM lineitem)
SELECT l_returnflag, layer::INT AS layer, round(sum(l_extendedprice) / sum(l_quantity), 6) AS mean FROM g CROSS JOIN l LEFT JOIN lineitem USING (l_returnflag) WHERE l_quantity <= hi AND l_quantity > lo GROUP BY ALL""")
def q_avg_sigma(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return r6(regrid.layer_mean(li, ["l_returnflag"], "l_quantity", "l_extendedprice", "l_quantity", [50.5, 40.0, 25.0, 10.0, 1.0]), "mean")


# ---------------------------------------------------------------- neighbourhoods

_W = "WINDOW w AS (PARTITION BY etype__i ORDER BY hour__i)"


def _n_cube(spark, sf_dir):
    ds = select.subset(event_cube(spark, sf_dir), ["n"])
    return ds.map_frames(lambda k, df: df.withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("double")))


_NCUBE = _CUBE + ", z AS (SELECT hour__i, etype__i, coalesce(n, 0)::DOUBLE AS n FROM cube)\n"


@query(_NCUBE + f"SELECT * FROM (SELECT hour__i, etype__i, 0.25 * lead(n, 2) OVER w + 0.5 * lead(n, 1) OVER w + 1.0 * n AS n FROM z {_W}) WHERE hour__i < {_H} - 2")
def q_convolve_valid(spark, sf_dir):
    return window.convolve(_n_cube(spark, sf_dir), "hour", [0.25, 0.5, 1.0]).to_frame()


@query(_NCUBE + f"SELECT hour__i, etype__i, 0.25 * coalesce(lead(n, 1) OVER w, 0) + 0.5 * n + 1.0 * coalesce(lag(n, 1) OVER w, 0) AS n FROM z {_W}")
def q_convolve_same(spark, sf_dir):
    return window.convolve(_n_cube(spark, sf_dir), "hour", [0.25, 0.5, 1.0], "same").to_frame()


@query(_NCUBE + f", p AS (SELECT g.hour__i, g.etype__i, coalesce(n, 0) AS n FROM (SELECT hour__i, unnest(range(k))::INT AS etype__i FROM (SELECT unnest(range(h + 2))::INT AS hour__i, k FROM axis)) g LEFT JOIN z USING (hour__i, etype__i)) SELECT hour__i, etype__i, 0.25 * n + 0.5 * coalesce(lag(n, 1) OVER w, 0) + 1.0 * coalesce(lag(n, 2) OVER w, 0) AS n FROM p {_W}")
def q_convolve_full(spark, sf_dir):
    return window.convolve(_n_cube(spark, sf_dir), "hour", [0.25, 0.5, 1.0], "full").to_frame()


@query(_CUBE + f"SELECT * FROM (SELECT hour__i, etype__i, round((v + lead(v) OVER w) / 2, 6) AS v FROM cube {_W}) WHERE hour__i < {_H} - 1")
def q_center_time(spark, sf_dir):
    return r6(window.center(select.subset(event_cube(spark, sf_dir), ["v"]), "hour").to_frame(), "v")


@query(_NCUBE + f"SELECT hour__i, etype__i, n - lag(n, 1, 0) OVER w AS n FROM z {_W}")
def q_layer_depth(spark, sf_dir):
    return window.depth(_n_cube(spark, sf_dir), "hour").to_frame()


@query(_NCUBE + f"SELECT hour__i, etype__i, sum(n) OVER (PARTITION BY etype__i ORDER BY hour__i) AS n FROM z")
def q_cumsum_unpack(spark, sf_dir):
    return window.running_total(_n_cube(spark, sf_dir), "hour").to_frame()


# ---------------------------------------------------------------- datasets with datasets

for _op, _key in (("+", "add"), ("-", "sub"), ("*", "mul"), ("/", "div")):
    _expr = f"a.v {_op} b.v" if _op != "/" else "a.v / NULLIF(b.v, 0)"

    def _binary(spark, sf_dir, op=_op):
        ds = select.subset(event_cube(spark, sf_dir), ["v"])
        half = ds.dims["hour"] // 2
        a, b = (select.slice_dims(ds, hour=slice(k, k + half)) for k in (0, half))
        return r6(combine.binary(op, a, b).to_frame(), "v")

    _QUERIES[f"binary_op_{_key}"] = _binary
    _SQL[f"binary_op_{_key}"] = _CUBE + f"SELECT a.hour__i, a.etype__i, round({_expr}, 6) AS v FROM cube a CROSS JOIN axis JOIN cube b ON b.hour__i = a.hour__i + h // 2 AND b.etype__i = a.etype__i WHERE a.hour__i < h // 2"


@query(_CUBE + "SELECT a.hour__i, a.etype__i, round((a.v + b.v) * c.v, 4) AS v FROM cube a CROSS JOIN axis JOIN cube b ON b.hour__i = a.hour__i + h // 3 AND b.etype__i = a.etype__i JOIN cube c ON c.hour__i = a.hour__i + h // 3 * 2 AND c.etype__i = a.etype__i WHERE a.hour__i < h // 3")
def q_seq_binary_op(spark, sf_dir):
    ds = select.subset(event_cube(spark, sf_dir), ["v"])
    third = ds.dims["hour"] // 3
    out = combine.sequence(["+", "*"], [select.slice_dims(ds, hour=slice(k * third, (k + 1) * third)) for k in range(3)]).to_frame()
    return out.withColumn("v", F.round("v", 4))


@query(_CUBE + "SELECT hour__i, etype__i, round(v - m, 6) AS v FROM cube JOIN (SELECT hour__i AS h, avg(v) AS m FROM cube GROUP BY 1) ON h = hour__i")
def q_anomaly_broadcast(spark, sf_dir):
    ds = select.subset(event_cube(spark, sf_dir), ["v"])
    return r6(combine.binary("-", ds, reduce.apply_along(ds, etype="mean")).to_frame(), "v")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS REV, round(sqrt(l_quantity) + CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.5 END, 6) AS Q FROM lineitem")
def q_expr_eval(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("qty"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ds = Dataset({}, {c: Var(()) for c in df.columns}, {(): df}, coords=frozenset(keys))
    return r6(expr.evaluate(ds, "REV = price * (1 - disc) * (1 + tax); Q = np.sqrt(qty) + np.where(tax > 0.04, 1.0, 0.5)").to_frame(()), "REV", "Q")


@query(_CUBE + "SELECT hour__i, etype__i, round(v, 6) AS v FROM cube")
def q_stack(spark, sf_dir):
    ds = select.subset(event_cube(spark, sf_dir), ["v"])
    return r6(combine.stack([select.slice_dims(ds, hour=slice(0, 300)), select.slice_dims(ds, hour=slice(300, ds.dims["hour"]))], "hour").to_frame(), "v")


@query(_CUBE + "SELECT hour__i, etype__i, round(v, 6) AS v, n, round(v * 1000, 6) AS w FROM cube")
def q_merge(spark, sf_dir):
    ds = event_cube(spark, sf_dir)
    other = select.rename_vars(combine.apply_function(lambda c: units.convert(c, "ppm", "ppb"), select.subset(ds, ["v"])), {"v": "w"})
    return r6(combine.merge([ds, other]).to_frame(), "v", "w")


# ---------------------------------------------------------------- evaluation

_ONE_PASS = {
    "STDO": "stddev_pop(obs)", "STDP": "stddev_pop(mod)", "NO": "count(obs)", "NP": "count(mod)", "NOP": "count(*) FILTER (obs IS NOT NULL AND mod IS NOT NULL)", "MO": "avg(obs)", "MP": "avg(mod)", "MdnO": "median(obs)", "MdnP": "median(mod)",
    "RM": "avg(obs / mod)", "RMdn": "median(obs / mod)", "MB": "avg(e)", "MdnB": "median(e)", "NMB": "sum(e) / sum(obs) * 100", "NMdnB": "median(e) / median(obs) * 100", "FB": "avg(e / (mod + obs)) * 200", "MNB": "avg(e / obs) * 100", "MdnNB": "median(e / obs) * 100",
    "ME": "avg(abs(e))", "MdnE": "median(abs(e))", "NME": "sum(abs(e)) / sum(obs) * 100", "NMdnE": "median(abs(e)) / median(obs) * 100", "FE": "avg(abs(e) / (mod + obs)) * 200", "MNE": "avg(abs(e) / obs) * 100", "MdnNE": "median(abs(e) / obs) * 100",
    "USUTPB": "(max(mod) - max(obs)) / max(obs) * 100", "USUTPE": "abs(max(mod) - max(obs)) / max(obs) * 100", "R2": "corr(obs, mod) ** 2", "RMSE": "sqrt(avg(e * e))",
    "WDMB": "avg(c)", "WDMdnB": "median(c)", "WDME": "avg(abs(c))", "WDMdnE": "median(abs(c))", "WDRMSE": "sqrt(avg(c * c))",
}
_TWO_PASS = {
    "d1": "1 - sum(abs(e)) / sum(abs(mod - om) + abs(obs - om))", "E1": "1 - sum(abs(e)) / sum(abs(obs - om))", "IOA": "1 - sum(e * e) / sum((abs(mod - om) + abs(obs - om)) ** 2)", "AC": "sum((mod - om) * (obs - om)) / sqrt(sum((mod - om) ** 2) * sum((obs - om) ** 2))",
    "WDIOA": "1 - sum(c * c) / sum((abs(cm) + abs(co)) ** 2)", "WDAC": "sum(cm * co) / sqrt(sum(cm * cm) * sum(co * co))", "RMSEs": "sqrt(avg(CASE WHEN mod IS NOT NULL THEN (line - obs) ** 2 END))", "RMSEu": "sqrt(avg((line - mod) ** 2))",
}


def _bias(x: str) -> str:
    return f"CASE WHEN {x} > 180 THEN {x} - 360 WHEN {x} < -180 THEN {x} + 360 ELSE {x} END"


def _stat_sql(source: str, by: str | None, names: dict[str, str]) -> str:
    """All statistics by one group column (or none), rounded to 4 places."""
    g = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return source + f""", f AS (SELECT *, mod - obs AS e, avg(obs) OVER ({over}) AS om, regr_slope(mod, obs) OVER ({over}) AS sl, regr_intercept(mod, obs) OVER ({over}) AS ic FROM p),
x AS (SELECT *, {_bias('e')} AS c, {_bias('(mod - om)')} AS cm, {_bias('(obs - om)')} AS co, sl * obs + ic AS line FROM f)
SELECT {g}{', '.join(f'round(({s})::DOUBLE, 4) AS {n}' for n, s in names.items())} FROM x {f'GROUP BY {by}' if by else ''}"""


def _stat_table(df: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    out = stats.evaluate(df, names, by)
    return out.select(*by, *[F.round(F.col(n).cast("double"), 4).alias(n) for n in names])


@query(_stat_sql(_PAIRS, None, _ONE_PASS))
def q_stats_table(spark, sf_dir):
    return _stat_table(order_pairs(spark, sf_dir), list(_ONE_PASS), [])


@query(_stat_sql(_PAIRS, "o_orderpriority", _ONE_PASS | _TWO_PASS))
def q_stats_by_group(spark, sf_dir):
    return _stat_table(order_pairs(spark, sf_dir), [*_ONE_PASS, *_TWO_PASS], ["o_orderpriority"])


_DIR = "WITH p AS (SELECT event_type, ((user_id * 37) % 360)::DOUBLE AS obs, ((user_id * 53 + event_id) % 360)::DOUBLE AS mod FROM events)\n"
_DIR_STATS = {k: v for k, v in (_ONE_PASS | _TWO_PASS).items() if k.startswith("WD")}


@query(_stat_sql(_DIR, "event_type", _DIR_STATS))
def q_circ_bias(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", F.pmod(F.col("user_id") * 37, F.lit(360)).cast("double").alias("obs"), F.pmod(F.col("user_id") * 53 + F.col("event_id"), F.lit(360)).cast("double").alias("mod"))
    return _stat_table(e, list(_DIR_STATS), ["event_type"])


@query(_PAIRS + """, t AS (SELECT o_orderpriority, month, max(obs) AS obs, max(mod) AS mod FROM p GROUP BY ALL), x AS (SELECT *, mod - obs AS e FROM t)
SELECT o_orderpriority, round(avg(e / obs) * 100, 4) AS MNPB, round(median(e / obs) * 100, 4) AS MdnNPB, round(avg(abs(e) / obs) * 100, 4) AS MNPE, round(median(abs(e) / obs) * 100, 4) AS MdnNPE, round(avg(e) / avg(obs) * 100, 4) AS NMPB, round(median(e) / median(obs) * 100, 4) AS NMdnPB, round(avg(abs(e)) / avg(obs) * 100, 4) AS NMPE, round(median(abs(e)) / median(obs) * 100, 4) AS NMdnPE FROM x GROUP BY 1""")
def q_peak_stats(spark, sf_dir):
    out = stats.peaks(order_pairs(spark, sf_dir), ["month"], list(stats.PEAK), ["o_orderpriority"])
    return out.select("o_orderpriority", *[F.round(n, 4).alias(n) for n in stats.PEAK])


# ---------------------------------------------------------------- lookups

_SIZES = [float(x) for x in range(900, 2101, 150)]


@query(f"""WITH t AS (SELECT p_partkey, least(8.0, greatest(0.0, (p_retailprice - 900) / 150)) AS t FROM part)
SELECT p_partkey, (CASE WHEN t - floor(t) = 0.5 THEN 2 * round(t / 2) ELSE round(t) END)::INT AS i FROM t""")
def q_val2idx_nearest(spark, sf_dir):
    return extract.val2idx(load(spark, sf_dir, "part"), "p_retailprice", _SIZES).select("p_partkey", "i")


@query("SELECT p_partkey, CASE WHEN p_retailprice = 2175 THEN 8 WHEN p_retailprice >= 825 AND p_retailprice < 2175 THEN floor((p_retailprice - 825) / 150)::INT END AS i FROM part")
def q_val2idx_bounds(spark, sf_dir):
    return extract.val2idx(load(spark, sf_dir, "part"), "p_retailprice", _SIZES, "bounds").select("p_partkey", "i")


@query("SELECT p_partkey, CASE p_size WHEN 5 THEN 0 WHEN 10 THEN 1 WHEN 20 THEN 2 END AS i FROM part")
def q_val2idx_exact(spark, sf_dir):
    return extract.val2idx(load(spark, sf_dir, "part"), "p_size", [5.0, 10.0, 20.0], "exact").select("p_partkey", "i")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events)), r AS (SELECT user_id, ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
j AS (SELECT l.event_id, r.value, abs(epoch_us(r.ts) - epoch_us(l.ts)) AS gap, r.ts FROM l JOIN r USING (user_id) WHERE abs(epoch_us(r.ts) - epoch_us(l.ts)) <= 21600000000),
b AS (SELECT event_id, value, gap FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, ts) AS n FROM j) WHERE n = 1)
SELECT event_id, b.value AS matched, b.gap / 1e6::DOUBLE AS gap_s FROM l LEFT JOIN b USING (event_id)""")
def q_asof_tolerance(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    lo, hi = (e.join(F.broadcast(e.agg(f("event_type").alias("event_type"))), "event_type") for f in (F.min, F.max))
    return extract.asof(hi, lo, ["user_id"], "ts", "value", 21_600).select("event_id", "matched", "gap_s")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events)), r AS (SELECT user_id, ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT event_id, value AS matched FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def q_asof_last(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    lo, hi = (e.join(F.broadcast(e.agg(f("event_type").alias("event_type"))), "event_type") for f in (F.min, F.max))
    return extract.asof_last(hi.select("event_id", "user_id", "ts"), lo, ["user_id"], "ts", "value").select("event_id", "matched")


_PT = "SELECT c_custkey, ((c_custkey * 7919) % 3600)::DOUBLE / 10 - 180 AS lon, ((c_custkey * 104729) % 1400)::DOUBLE / 10 - 70 AS lat FROM customer"
_GR = "SELECT s_suppkey, ((s_suppkey * 6101) % 3600)::DOUBLE / 10 - 180 AS lon, ((s_suppkey * 3571) % 1400)::DOUBLE / 10 - 70 AS lat FROM supplier"


def _spots(df: DataFrame, key: str, a: int, b: int) -> DataFrame:
    k = F.col(key)
    return df.select(key, (F.pmod(k * a, F.lit(3600)).cast("double") / 10 - 180).alias("lon"), (F.pmod(k * b, F.lit(1400)).cast("double") / 10 - 70).alias("lat"))


@query(f"""WITH p AS ({_PT}), g AS ({_GR}), j AS (SELECT c_custkey, s_suppkey, (p.lon - g.lon) ** 2 + (p.lat - g.lat) ** 2 AS d2 FROM p, g)
SELECT c_custkey, s_suppkey, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) AS n FROM j) WHERE n = 1""")
def q_extract_nn(spark, sf_dir):
    p = _spots(load(spark, sf_dir, "customer"), "c_custkey", 7919, 104729)
    g = _spots(load(spark, sf_dir, "supplier"), "s_suppkey", 6101, 3571)
    return r6(extract.nearest_points(p, g, ["c_custkey"], "s_suppkey"), "d2")


_CORNERS = [(-100.0, -40.0), (60.0, -55.0), (120.0, 20.0), (0.0, 65.0), (-20.0, 0.0)]
_RAY = " + ".join(f"((({y1} > lat) != ({y2} > lat)) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1})::INT" for (x1, y1), (x2, y2) in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True)).replace("--", "+")
_RAY = _RAY.replace("- -", "+ ")


@query(f"WITH p AS ({_PT}) SELECT c_custkey, ({_RAY}) % 2 = 1 AS inside FROM p")
def q_point_in_polygon(spark, sf_dir):
    p = _spots(load(spark, sf_dir, "customer"), "c_custkey", 7919, 104729)
    return p.select("c_custkey", extract.in_polygon(F.col("lon"), F.col("lat"), _CORNERS).alias("inside"))


@query(f"WITH p AS ({_PT}), g AS ({_GR}) SELECT c_custkey FROM p WHERE EXISTS (SELECT 1 FROM g WHERE p.lon BETWEEN g.lon - 15 AND g.lon + 15 AND p.lat BETWEEN g.lat - 8 AND g.lat + 8)")
def q_matchspace(spark, sf_dir):
    p = _spots(load(spark, sf_dir, "customer"), "c_custkey", 7919, 104729)
    g = _spots(load(spark, sf_dir, "supplier"), "s_suppkey", 6101, 3571)
    boxes = g.select((F.col("lon") - 15).alias("x0"), (F.col("lon") + 15).alias("x1"), (F.col("lat") - 8).alias("y0"), (F.col("lat") + 8).alias("y1"))
    return extract.in_any_box(p, boxes, "lon", "lat").select("c_custkey")


# ---------------------------------------------------------------- regridding

_NEW = [0.0, 0.25, 10.5, 31.75, 63.0, 70.0]


def _weights_sql(w: regrid.Weights) -> str:
    return ", ".join(f"({i}, {j}, {x!r}::DOUBLE)" for i, j, x in w)


@query(_VEC + f"SELECT vec__i, j AS k__i, round(sum(v * w), 6) AS v FROM vec JOIN (VALUES {_weights_sql(regrid.linear_weights(list(range(64)), _NEW))}) AS t(i, j, w) ON k__i = i GROUP BY ALL")
def q_interp_linear(spark, sf_dir):
    return r6(regrid.interpolate(vectors(spark, sf_dir), "k", [float(x) for x in range(64)], _NEW).to_frame(), "v")


_EDGES = ([float(x) for x in range(65)], [0.0, 2.5, 8.0, 30.25, 64.0])


@query(_VEC + f"SELECT vec__i, j AS k__i, round(sum(v * w), 6) AS v FROM vec JOIN (VALUES {_weights_sql(regrid.overlap_weights(*_EDGES))}) AS t(i, j, w) ON k__i = i GROUP BY ALL")
def q_interp_conserve(spark, sf_dir):
    w = regrid.overlap_weights(*_EDGES)
    return r6(regrid.apply_weights(vectors(spark, sf_dir), "k", w, 4).to_frame(), "v")


def _order_columns(lines):
    s = lines.groupBy("l_orderkey", F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    t = s.select("l_orderkey").distinct().withColumn("t", F.explode(F.array(F.lit(5.0), F.lit(20.5), F.lit(40.0))))
    return r6(regrid.interpolate_columns(s, ["l_orderkey"], "x", ["y"], t, "t"), "y")


@query("""WITH s AS (SELECT l_orderkey, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY x)),
t AS (SELECT DISTINCT l_orderkey, u.t FROM s, (VALUES (5.0::DOUBLE), (20.5), (40.0)) AS u(t))
SELECT l_orderkey, t, round(y + coalesce((y2 - y) * greatest(0.0, least(1.0, (t - x) / (x2 - x))), 0), 6) AS y FROM t JOIN n USING (l_orderkey) WHERE (t >= x OR k = 1) AND (x2 IS NULL OR t < x2)""")
def q_interp_columns(spark, sf_dir):
    return _order_columns(load(spark, sf_dir, "lineitem"))


@query("""WITH s AS (SELECT l_orderkey, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY x)),
t AS (SELECT DISTINCT l_orderkey, u.t FROM s, (VALUES (5.0::DOUBLE), (20.5), (40.0)) AS u(t))
SELECT l_orderkey, t, round(y + coalesce((y2 - y) * greatest(0.0, least(1.0, (t - x) / (x2 - x))), 0), 6) AS y FROM t JOIN n USING (l_orderkey) WHERE (t >= x OR k = 1) AND (x2 IS NULL OR t < x2)""")
def q_interp_columns_all(spark, sf_dir):
    return _order_columns(load(spark, sf_dir, "lineitem"))


# ---------------------------------------------------------------- functions


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%j')::INT AS date, strftime(o_orderdate, '%H%M%S')::INT AS time, round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1990-01-01')) / 3600000000.0::DOUBLE, 6) AS hours, true AS back FROM orders")
def q_tflag(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    o = o.select("o_orderkey", "t", times.yyyyjjj(F.col("t")).alias("date"), times.hhmmss(F.col("t")).alias("time"), F.round(times.to_number(F.col("t"), "hours since 1990-01-01 00:00:00+0000"), 6).alias("hours"))
    back = (times.from_yyyyjjj(F.col("date"), F.col("time")) == F.date_trunc("second", "t")) & (times.from_number(F.col("hours"), "hours since 1990-01-01") == F.col("t"))
    return o.withColumn("back", back).drop("t")


@query("SELECT event_id, round(value * 1.8 - 273.2 * 1.8 + 32, 6) AS f, round(value / 1000, 6) AS ppm, round((value - 32) / 1.8, 6) AS c FROM events")
def q_unit_convert(spark, sf_dir):
    v = F.col("value")
    return r6(load(spark, sf_dir, "events").select("event_id", units.convert(v, "K", "F").alias("f"), units.convert(v, "ppb", "ppm").alias("ppm"), units.convert(v, "F", "C").alias("c")), "f", "ppm", "c")


@query("""WITH t AS (SELECT event_id, (event_id % 45)::DOUBLE - 5 AS t, (event_id % 45)::DOUBLE - 5 - (user_id % 12) AS td, 700 + (user_id % 300)::DOUBLE AS p FROM events),
e AS (SELECT *, 6.112 * exp(17.67 * td / (td + 243.5)) AS e, 6.112 * exp(17.67 * t / (t + 243.5)) AS es FROM t)
SELECT event_id, round(0.622 * e / (p - 0.378 * e), 9) AS q, round(e / es * 100, 6) AS rh FROM e""")
def q_met_humidity(spark, sf_dir):
    t = (F.col("event_id") % 45).cast("double") - 5
    td, p = t - F.col("user_id") % 12, (F.col("user_id") % 300).cast("double") + 700
    return load(spark, sf_dir, "events").select("event_id", F.round(met.specific_humidity(p, td), 9).alias("q"), F.round(met.relative_humidity(t, td), 6).alias("rh"))


@query("""WITH t AS (SELECT event_id, value AS s, ((user_id * 37) % 360)::DOUBLE AS d FROM events), w AS (SELECT *, -s * sin(radians(d)) AS u, -s * cos(radians(d)) AS v FROM t)
SELECT event_id, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(sqrt(u * u + v * v), 6) AS s FROM w""")
def q_wind_uv(spark, sf_dir):
    u, v = met.wind_components(F.col("value"), F.pmod(F.col("user_id") * 37, F.lit(360)).cast("double"))
    s, _ = met.wind_speed_direction(u, v)
    out = r6(load(spark, sf_dir, "events").select("event_id", u.alias("u"), v.alias("v"), s.alias("s")), "u", "v", "s")
    return out.withColumns({n: F.col(n) + 0.0 for n in ("u", "v")})  # no negative zeros


_LCC = geo.Projection("lcc", 33, 45, 40, -97)
_N, _FF, _R0 = _LCC._cone()


@query(f"""WITH p AS ({_PT}), r AS (SELECT *, {geo.RADIUS * _FF!r}::DOUBLE / pow(tan(pi() / 4 + radians(lat) / 2), {_N!r}::DOUBLE) AS r, radians(((lon + 97 + 180) % 360 + 360) % 360 - 180) * {_N!r}::DOUBLE AS a FROM p)
SELECT c_custkey, round(r * sin(a), 3) AS x, round({_R0!r}::DOUBLE - r * cos(a), 3) AS y, true AS back FROM r""")
def q_projection_lcc(spark, sf_dir):
    p = _spots(load(spark, sf_dir, "customer"), "c_custkey", 7919, 104729)
    x, y = _LCC.forward(F.col("lon"), F.col("lat"))
    lon, lat = _LCC.inverse(x, y)
    back = (F.abs(F.pmod(lon - F.col("lon") + 180, F.lit(360.0)) - 180) < 1e-6) & (F.abs(lat - F.col("lat")) < 1e-6)
    return p.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), back.alias("back"))


@query("SELECT c_custkey, floor((lon + 180) / 5)::INT AS i, floor((lat + 70) / 4)::INT AS j FROM (" + _PT + ")")
def q_ll2ij(spark, sf_dir):
    p = _spots(load(spark, sf_dir, "customer"), "c_custkey", 7919, 104729)
    return extract.ll2ij(p, F.col("lon"), F.col("lat"), -180, -70, 5, 4, 72, 35).select("c_custkey", "i", "j")


@query("""WITH h AS (SELECT event_id, printf('%05x%05x%05x', event_id % 1048576, (event_id * 7) % 1048576, user_id % 1048576) AS hex FROM events)
SELECT event_id, l.range::INT AS level, ('0x' || substr(hex, (5 * l.range + 1)::INT, 5))::INT AS back FROM h, range(3) l""")
def q_ceilometer_hex(spark, sf_dir):
    from gridspark.sources.text import hex_profile

    h = load(spark, sf_dir, "events").select("event_id", F.lower(F.concat(*[F.lpad(F.hex(c), 5, "0") for c in (F.col("event_id") % 1048576, F.col("event_id") * 7 % 1048576, F.col("user_id") % 1048576)])).alias("hex"))
    return hex_profile(h, "hex", 5, 3)


@query(_CUBE + "SELECT hour__i, etype__i, coalesce(round(v, 6), -999) AS v FROM cube")
def q_densify_fill(spark, sf_dir):
    return r6(event_cube(spark, sf_dir).to_frame().drop("n"), "v").fillna(-999.0, ["v"])


@query("SELECT n_name AS species, r_name AS rxn, count(*) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def q_unpivot_net(spark, sf_dir):
    n = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    names = [r[0] for r in load(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]
    wide = n.groupBy(F.col("n_name").alias("species")).pivot("r_name", names).count()
    return wide.unpivot("species", names, "rxn", "value").filter(F.col("value").isNotNull())
