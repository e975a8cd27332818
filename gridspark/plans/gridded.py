"""Registered queries on conventions, moving layers and cells without a formula, with their SQL."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from gridspark.functions import geo

from gridspark.conventions import Ioapi
from gridspark.model import idx
from gridspark.operators import extract, regrid, select
from gridspark.plans.catalog import _PT, _VEC, _spots, load, query, r6, vectors
from gridspark.session import scratch
from gridspark.sources import records
from gridspark.streaming import events

_GRID = {
    "SDATE": 2024001, "STIME": 0, "TSTEP": 10000, "GDTYP": 2, "P_ALP": 33.0, "P_BET": 45.0, "P_GAM": -97.0, "XORIG": -2736000.0, "YORIG": -2088000.0, "XCELL": 36000.0, "YCELL": 36000.0,
    "VGTYP": 7, "VGTOP": 5000.0, "VGLVLS": [1.0, 0.9975, 0.995, 0.9925, 0.99],
}


def model_file(spark, sf_dir) -> Ioapi:
    """All vectors as hourly fields of 4 layers, 4 rows and 4 columns."""
    ds = select.split_dim(vectors(spark, sf_dir), "k", {"LAY": 4, "ROW": 4, "COL": 4})
    return Ioapi.of(select.rename_dims(ds, {"vec": "TSTEP"}), **_GRID)


_FILE = _VEC + ", f AS (SELECT vec__i AS t, k__i // 16 AS l, k__i // 4 % 4 AS r, k__i % 4 AS c, v FROM vec)\n"
_TIMES = "strftime(tm, '%Y%j')::INT AS date, strftime(tm, '%H%M%S')::INT AS time"


def _hour(text: str) -> str:
    return f"TIMESTAMP '2024-01-01' + to_hours({text})"


@query(_FILE + f"""SELECT ((t - 10) // 3)::INT AS TSTEP__i, (l - 1)::INT AS LAY__i, 0 AS ROW__i, (c - 1)::INT AS COL__i, round(v, 6) AS v, {_TIMES},
 (-2736000 + (c + 0.5) * 36000)::DOUBLE AS x, (-2088000 + 2.5 * 36000)::DOUBLE AS y, (1 - l * 0.0025)::DOUBLE AS lower, (1 - (l + 1) * 0.0025)::DOUBLE AS upper FROM (SELECT *, {_hour('t')} AS tm FROM f) WHERE t >= 10 AND (t - 10) % 3 = 0 AND l BETWEEN 1 AND 2 AND r = 2 AND c >= 1""")
def q_ioapi_slice(spark, sf_dir):
    return r6(model_file(spark, sf_dir).slice(TSTEP=slice(10, None, 3), LAY=slice(1, 3), ROW=2, COL=slice(1, 4)).located(), "v", "lower", "upper")


@query(_FILE + f"""SELECT d::INT AS TSTEP__i, 0 AS LAY__i, rr::INT AS ROW__i, 0 AS COL__i, round(avg(v), 6) AS v, {_TIMES}, (-2736000 + 2 * 36000.0)::DOUBLE AS x, (-2088000 + (2 * rr + 1) * 36000.0)::DOUBLE AS y, (0.99625)::DOUBLE AS lower, (0.99375)::DOUBLE AS upper
 FROM (SELECT d, r // 2 AS rr, {_hour('d * 24')} AS tm, v FROM (SELECT t // 24 AS d, l, r, max(v) AS v FROM (SELECT t, l, r, avg(v) AS v FROM (SELECT t, r, c, l, v FROM f) GROUP BY ALL) GROUP BY ALL)) GROUP BY ALL""")
def q_ioapi_reduce(spark, sf_dir):
    """Daily maxima of means over columns, then means of pairs of rows and all layers."""
    out = model_file(spark, sf_dir).apply(COL="mean").coarsen("TSTEP", 24, "max").coarsen("ROW", 2, "mean").apply(LAY="mean")
    return r6(out.located(), "v", "lower", "upper")


@query(_FILE + f""", s AS (SELECT DISTINCT (t - 5) // 2 AS s, {_hour('t')} AS tm FROM f WHERE t >= 5 AND (t - 5) % 2 = 0)
SELECT s::INT AS TSTEP__i, n.range::INT AS VAR__i, p.range::INT AS "DATE-TIME__i", (CASE p.range WHEN 0 THEN strftime(tm, '%Y%j') ELSE strftime(tm, '%H%M%S') END)::INT AS TFLAG FROM s, range(2) n, range(2) p""")
def q_ioapi_tflag(spark, sf_dir):
    """TFLAG of every second step after a variable has been added: two dates and times a step."""
    return model_file(spark, sf_dir).slice(TSTEP=slice(5, None, 2)).eval("w = v * 2", copy_all=True).with_tflag().to_frame(("TSTEP", "VAR", "DATE-TIME"))


@query(_FILE + f"""SELECT i::INT AS TSTEP__i, l::INT AS LAY__i, r::INT AS ROW__i, c::INT AS COL__i, round(v, 6) AS v, {_TIMES}, (-2736000 + (c + 0.5) * 36000)::DOUBLE AS x, (-2088000 + (r + 0.5) * 36000)::DOUBLE AS y, (1 - l * 0.0025)::DOUBLE AS lower, (1 - (l + 1) * 0.0025)::DOUBLE AS upper
 FROM (SELECT *, CASE WHEN t < 40 THEN t ELSE t - 20 END AS i, {_hour('t')} AS tm FROM f WHERE t < 40 OR t >= 60)""")
def q_ioapi_stack(spark, sf_dir):
    """Two pieces with a gap between: the steps keep their own times."""
    whole = model_file(spark, sf_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return r6(whole.slice(TSTEP=slice(0, 40)).stack(whole.slice(TSTEP=slice(60, None))).located(), "v", "lower", "upper")


@query(_FILE + f"""SELECT t::INT AS TSTEP__i, h::INT AS LAY__i, r::INT AS ROW__i, c::INT AS COL__i, round(avg(v), 6) AS v, {_TIMES}, (-2736000 + (c + 0.5) * 36000)::DOUBLE AS x, (-2088000 + (r + 0.5) * 36000)::DOUBLE AS y, (1 - h * 0.005)::DOUBLE AS lower, (1 - (h + 1) * 0.005)::DOUBLE AS upper
 FROM (SELECT t, l // 2 AS h, r, c, v, {_hour('t')} AS tm FROM f) GROUP BY ALL""")
def q_ioapi_sigma(spark, sf_dir):
    """Layers taken together in twos, by thickness."""
    return r6(model_file(spark, sf_dir).interpolate_sigma([1.0, 0.995, 0.99], kind="conserve").located(), "v", "lower", "upper")


# ---------------------------------------------------------------- layers that move

_A = [0.25 * k * (64 - k) / 16 for k in range(65)]
_B = [(1 - k / 64) ** 2 for k in range(65)]
_PS = "900 + vec__i * 37 % 150"


@query(_VEC + f""", old AS (SELECT vec__i, k__i AS o, v, a + b * ps AS hi, a2 + b2 * ps AS lo, ps FROM (SELECT *, ({_PS})::DOUBLE AS ps FROM vec) JOIN (VALUES {", ".join(f"({k}, {_A[k]!r}::DOUBLE, {_B[k]!r}::DOUBLE, {_A[k + 1]!r}::DOUBLE, {_B[k + 1]!r}::DOUBLE)" for k in range(64))}) AS e(k, a, b, a2, b2) ON k = k__i),
new AS (SELECT DISTINCT vec__i, j.range::INT AS layer, 50 + (ps - 50) * (1 - j.range / 10) AS hi, 50 + (ps - 50) * (1 - (j.range + 1) / 10) AS lo FROM old, range(10) j),
w AS (SELECT vec__i, layer, v, least(old.hi, new.hi) - greatest(old.lo, new.lo) AS w FROM old JOIN new USING (vec__i) WHERE least(old.hi, new.hi) > greatest(old.lo, new.lo))
SELECT vec__i, layer, round(m, 6) AS v FROM new LEFT JOIN (SELECT vec__i, layer, sum(v * w) / sum(w) AS m FROM w GROUP BY ALL) USING (vec__i, layer)""")
def q_remap_columns(spark, sf_dir):
    """Each column's hybrid layers, whose pressures follow its own surface, to ten sigma layers of that surface."""
    cells = vectors(spark, sf_dir).to_frame().withColumnRenamed("k__i", "layer")
    ps = F.expr(f"cast({_PS} as double)")
    columns = cells.select("vec__i").distinct().withColumn("ps", ps)
    old = regrid.hybrid_at(cells.withColumn("ps", ps), _A, _B, "ps")
    new = regrid.hybrid_edges(columns, [50 * j / 10 for j in range(11)], [1 - j / 10 for j in range(11)], "ps")
    return r6(regrid.remap_columns(old, new, ["vec__i"], ["v"]), "v")


@query(_VEC + """, n AS (SELECT max(vec__i) + 1 AS n FROM vec),
e AS (SELECT event_id, event_type, value, ((epoch_us(ts) // 3600000000) % n)::INT AS t FROM events, n)
SELECT event_id, k__i AS layer, round(v, 6) AS v FROM e LEFT JOIN vec ON vec__i = t AND value >= k__i * (0.5 + t % 7 * 0.25) AND value < (k__i + 1) * (0.5 + t % 7 * 0.25)""")
def q_pair_layers(spark, sf_dir):
    """Events paired with the hourly layer that holds their value; layers are thicker in some hours than in others."""
    ds = vectors(spark, sf_dir)
    thick = 0.5 + F.col("t") % 7 * 0.25
    layers = ds.to_frame().select(F.col("vec__i").alias("t"), F.col("k__i").alias("layer"), "v").withColumns({"lower": F.col("layer") * thick, "upper": (F.col("layer") + 1) * thick})
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    points = load(spark, sf_dir, "events").select("event_id", "value", F.pmod(hour, F.lit(ds.dims["vec"])).cast("int").alias("t"))
    return r6(extract.in_layers(points, layers, ["t"], "value", "lower", "upper"), "v").select("event_id", "layer", "v")


# ---------------------------------------------------------------- files of records


@query(_FILE + """SELECT (t // 24)::INT AS file, t % 24 AS step, strftime(tm, '%Y%j')::INT AS date, extract('hour' FROM tm)::DOUBLE AS hour, l::INT AS LAY__i, r::INT AS ROW__i, c::INT AS COL__i, round(v, 6) AS value
 FROM (SELECT *, TIMESTAMP '2024-01-01' + to_hours(t) AS tm FROM f) WHERE l >= 1 AND r = 2 AND c < 3 AND t % 24 >= 6""")
def q_record_files(spark, sf_dir):
    """All vectors written by tasks as daily files of records; layers, rows and steps are chosen before reading."""
    f = model_file(spark, sf_dir)
    rows = f.located().select(F.col(idx("TSTEP")).alias("step"), "date", (F.col("time") / 10000).alias("hour"), F.lit("V").alias("name"), *[idx(d) for d in ("LAY", "ROW", "COL")], F.col("v").alias("value"))
    path = scratch(spark)
    records.write_average(rows, path, ["V"], 4, 4, 4, note="vectors")
    got = records.read_records(spark, path).filter("LAY__i >= 1 AND ROW__i = 2 AND COL__i < 3 AND step >= 6")
    return r6(got.select(F.right("file", F.lit(6)).cast("int").alias("file"), "step", "date", F.col("hour").cast("double").alias("hour"), *[idx(d) for d in ("LAY", "ROW", "COL")], "value"), "value")


# ---------------------------------------------------------------- ellipsoids and streams

_WGS = geo.half_axes("12")
_ELLIPSOIDS = {
    "lcc": geo.Projection("lcc", 33, 45, 40, -97, radius=_WGS[0], minor=_WGS[1]),
    "stere": geo.Projection("stere", lat_1=60, lat_0=90, lon_0=-45, radius=_WGS[0], minor=_WGS[1]),
    "merc": geo.Projection("merc", lat_1=20, lon_0=10, radius=_WGS[0], minor=_WGS[1]),
}
_LN, _LF, _LR = _ELLIPSOIDS["lcc"]._cone()
_E = repr(_ELLIPSOIDS["lcc"].eccentricity)
_D = "radians((((lon - ({0})) + 180) % 360 + 360) % 360 - 180)"


@query(f"""WITH p AS (SELECT c_custkey, {_D.format(-97)} AS d1, {_D.format(-45)} AS d2, {_D.format(10)} AS d3, exp({_E} * atanh({_E} * sin(radians(lat)))) * tan(pi() / 4 - radians(lat) / 2) AS t FROM ({_PT}))
SELECT c_custkey, round({_WGS[0] * _LF!r}::DOUBLE * pow(t, {_LN!r}::DOUBLE) * sin(d1 * {_LN!r}::DOUBLE), 3) AS lcc_x, round({_LR!r}::DOUBLE - {_WGS[0] * _LF!r}::DOUBLE * pow(t, {_LN!r}::DOUBLE) * cos(d1 * {_LN!r}::DOUBLE), 3) AS lcc_y,
 round({_ELLIPSOIDS["stere"]._polar()!r}::DOUBLE * t * sin(d2), 3) AS stere_x, round(-{_ELLIPSOIDS["stere"]._polar()!r}::DOUBLE * t * cos(d2), 3) AS stere_y,
 round({_WGS[0] * _ELLIPSOIDS["merc"]._m(0.3490658503988659)!r}::DOUBLE * d3, 3) AS merc_x, round(-{_WGS[0] * _ELLIPSOIDS["merc"]._m(0.3490658503988659)!r}::DOUBLE * ln(t), 3) AS merc_y, true AS back FROM p""")
def q_projection_ellipsoid(spark, sf_dir):
    """Customers' places on an ellipsoid in three projections, and whether all inverses lead back."""
    p = _spots(load(spark, sf_dir, "customer"), "c_custkey", 7919, 104729)
    lon, lat, out, back = F.col("lon"), F.col("lat"), {}, F.lit(True)
    for name, proj in _ELLIPSOIDS.items():
        x, y = proj.forward(lon, lat)
        a, b = proj.inverse(x, y)
        back = back & (F.abs(F.pmod(a - lon + 180, F.lit(360.0)) - 180) < 1e-7) & (F.abs(b - lat) < 1e-7)
        out |= {f"{name}_x": F.round(x, 3), f"{name}_y": F.round(y, 3)}
    return p.select("c_custkey", *[c.alias(n) for n, c in out.items()], back.alias("back"))


@query("""WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h, avg(value) AS v FROM events GROUP BY ALL),
m AS (SELECT event_type, h - o.range AS s, avg(v) AS m FROM h, range(8) o GROUP BY ALL HAVING count(*) >= 6)
SELECT (DATE '1970-01-01' + (s // 24)::INT)::DATE::VARCHAR AS day, event_type, round(max(m), 6) AS maximum FROM m GROUP BY ALL""")
def q_stream_daily_maximum(spark, sf_dir):
    """Every day's largest eight-hour mean by the chained windows that also run on streams."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return r6(events.daily_maximum_of_means(e, "ts", "value", ["event_type"]), "maximum").withColumn("day", F.col("day").cast("string"))


_AXES = {"row": [0.0, 1.0, 2.5, 3.0, 4.0, 6.0, 6.5, 8.0], "col": [float(k) for k in range(8)]}
_BENT = {d: ", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for i, j, w in regrid.curvature_weights(c)) for d, c in _AXES.items()}
_KNOTS = {d: "[" + ", ".join(f"{x!r}::DOUBLE" for x in c) + "]" for d, c in _AXES.items()}


@query(_VEC + f""", n AS (SELECT max(vec__i) + 1 AS n FROM vec), f AS (SELECT vec__i AS t, k__i // 8 AS r, k__i % 8 AS c, v FROM vec),
fr AS (SELECT t, j AS r, c, sum(v * w) AS v FROM f JOIN (VALUES {_BENT["row"]}) AS b(i, j, w) ON i = r GROUP BY ALL),
fc AS (SELECT t, r, j AS c, sum(v * w) AS v FROM f JOIN (VALUES {_BENT["col"]}) AS b(i, j, w) ON i = c GROUP BY ALL),
frc AS (SELECT t, r, j AS c, sum(v * w) AS v FROM fr JOIN (VALUES {_BENT["col"]}) AS b(i, j, w) ON i = c GROUP BY ALL),
p AS (SELECT c_custkey, (c_custkey % n)::INT AS t, ((c_custkey * 7919) % 850)::DOUBLE / 100 AS x, ((c_custkey * 104729) % 700)::DOUBLE / 100 AS y, {_KNOTS["row"]} AS kr, {_KNOTS["col"]} AS kc FROM customer, n),
k AS (SELECT *, least(len(list_filter(kr, lambda z: z <= x)) - 1, 6) AS i, least(len(list_filter(kc, lambda z: z <= y)) - 1, 6) AS j FROM p),
s AS (SELECT *, kr[i + 2] - kr[i + 1] AS hr, kc[j + 2] - kc[j + 1] AS hc, (x - kr[i + 1]) / (kr[i + 2] - kr[i + 1]) AS u, (y - kc[j + 1]) / (kc[j + 2] - kc[j + 1]) AS q FROM k WHERE x <= 8),
z AS (SELECT c_custkey, t, i + a.range AS r, j + b.range AS c, CASE a.range WHEN 1 THEN u ELSE 1 - u END AS wr, CASE b.range WHEN 1 THEN q ELSE 1 - q END AS wc, hr, hc FROM s, range(2) a, range(2) b),
g AS (SELECT c_custkey, sum(wr * wc * f.v + (wr ** 3 - wr) * hr * hr / 6 * wc * fr.v + wr * (wc ** 3 - wc) * hc * hc / 6 * fc.v + (wr ** 3 - wr) * hr * hr / 6 * (wc ** 3 - wc) * hc * hc / 6 * frc.v) AS matched
 FROM z JOIN f USING (t, r, c) JOIN fr USING (t, r, c) JOIN fc USING (t, r, c) JOIN frc USING (t, r, c) GROUP BY c_custkey)
SELECT c_custkey, round(matched, 6) AS matched FROM p LEFT JOIN g USING (c_custkey)""")
def q_extract_cubic(spark, sf_dir):
    """A cubic spline through each vector as a plane of 8 by 8 uneven nodes, at a place for each customer; some lie outside."""
    ds = vectors(spark, sf_dir)
    k = F.col("c_custkey")
    points = load(spark, sf_dir, "customer").select(k, F.pmod(k, F.lit(ds.dims["vec"])).cast("int").alias("vec__i"), (F.pmod(k * 7919, F.lit(850)).cast("double") / 100).alias("x"), (F.pmod(k * 104729, F.lit(700)).cast("double") / 100).alias("y"))
    found = extract.bicubic(points, select.split_dim(ds, "k", {"row": 8, "col": 8}), "v", ("x", "y"), _AXES)
    return r6(found, "matched").select("c_custkey", "matched")
