"""Registered queries that go through files and back, and functions that no other query uses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark import conventions
from gridspark.functions import geo, met, times
from gridspark.model import Dataset, Var, idx
from gridspark.operators import select
from gridspark.plans.catalog import _CUBE, _PT, _VEC, _spots, event_cube, load, query, r6, vectors
from gridspark.plans.gridded import _FILE, _TIMES, _hour, model_file
from gridspark.session import scratch
from gridspark.sources import registry, text


@query(_FILE + f"""SELECT (t - 30)::INT AS TSTEP__i, l::INT AS LAY__i, r::INT AS ROW__i, c::INT AS COL__i, round(v, 6) AS V, round(v * 2, 6) AS W, {_TIMES}, (-2736000 + (c + 0.5) * 36000)::DOUBLE AS x, (-2088000 + (r + 0.5) * 36000)::DOUBLE AS y, (1 - l * 0.0025)::DOUBLE AS lower, (1 - (l + 1) * 0.0025)::DOUBLE AS upper
 FROM (SELECT *, {_hour('t')} AS tm FROM f) WHERE t >= 30""")
def q_ioapi_files(spark, sf_dir):
    """All vectors and their doubles written by tasks as files of 100 hours, read as one, and the later hours placed by the attributes."""
    f = model_file(spark, sf_dir)
    both = f.rename({"v": "V"}).eval("W = V * 2", copy_all=True)
    path = scratch(spark)
    conventions.write_ioapi(both, path, steps=100)
    back = conventions.read_ioapi(spark, path).slice(TSTEP=slice(30, None))
    return r6(back.located(), "V", "W", "lower", "upper")


@query(_CUBE + "SELECT hour__i AS time__i, etype__i AS layer__i, round(v, 6) AS v FROM cube WHERE v IS NOT NULL")
def q_csv_files(spark, sf_dir):
    """The event cube as delimited text and back."""
    cube = select.rename_dims(select.subset(event_cube(spark, sf_dir), ["v"]), {"hour": "time", "etype": "layer"})
    axis = lambda d: spark.range(cube.dims[d]).select(F.col("id").cast("int").alias(idx(d)), F.col("id").cast("int").alias(d))
    ds = cube.with_var("time", ("time",), axis("time")).with_var("layer", ("layer",), axis("layer")).set_coords("time", "layer")
    made = text.write_grid_csv(ds, scratch(spark))
    back = registry.open_dataset(spark, made[0], "csv")
    return r6(back.to_frame(("time", "layer")), "v").filter("v IS NOT NULL")


@query(_CUBE + "SELECT hour__i, etype__i, round(v, 6) AS v, n FROM cube")
def q_native_files(spark, sf_dir):
    """The event cube in the engine's own format and back."""
    path = scratch(spark)
    registry.save(event_cube(spark, sf_dir), path)
    return r6(registry.open_dataset(spark, path).to_frame(), "v")


@query("SELECT vec_id::INT AS POINTS__i, vec_id::DOUBLE AS place, CASE WHEN embedding[1] > 0 THEN round(embedding[1]::DOUBLE, 6) END AS a, round(embedding[2]::DOUBLE, 6) AS b FROM embeddings")
def q_icartt_files(spark, sf_dir):
    """Points as NASA Ames text and back; values not above zero are masked."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias(idx("POINTS")), F.col("vec_id").cast("double").alias("place"), F.when(F.col("embedding")[0] > 0, F.col("embedding")[0].cast("double")).alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    key = ("POINTS",)
    ds = Dataset({"POINTS": 1}, {v: Var(key, {"units": "1"}) for v in ("place", "a", "b")}, {key: e}, {"PI_NAME": "nobody", "SDATE": "2024, 01, 01", "note": "made"}).set_coords("place")
    path = scratch(spark)
    registry.save(ds, path, "ffi1001")
    return r6(registry.open_dataset(spark, path, "ffi1001").to_frame(key), "place", "a", "b")


@query("""SELECT event_type AS parameter, 'ppb' AS units, date_trunc('minute', ts)::TIMESTAMP AS time, printf('%02d%03d%04d', user_id % 50, user_id % 7, user_id) AS site, round(avg(value), 6) AS value, round(avg((user_id % 60)::DOUBLE), 6) AS lat, round(avg(-(user_id % 120)::DOUBLE), 6) AS lon
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL""")
def q_station_files(spark, sf_dir):
    """Events as station measurements in text: the mean of each parameter, site and minute within a span."""
    e, u = load(spark, sf_dir, "events"), F.col("user_id")
    rows = e.select(
        (u % 50).cast("string").alias("State Code"), (u % 7).cast("string").alias("County Code"), u.cast("string").alias("Site Num"), F.col("event_type").alias("Parameter Name"), F.lit("ppb").alias("Units of Measure"),
        (u % 60).cast("double").alias("Latitude"), (-(u % 120)).cast("double").alias("Longitude"), F.date_format("ts", "yyyy-MM-dd").alias("Date GMT"), F.date_format("ts", "HH:mm").alias("Time GMT"), F.col("value").alias("Sample Measurement"),
    )
    path = scratch(spark)
    rows.write.csv(path, header=True)
    got = text.read_aqs(spark, path, "2024-01-10 00:00:00", "2024-01-19 23:59:00")
    return r6(got, "value", "lat", "lon").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.622 * e / (p - e), 9) AS ratio, round(pow(l_tax * 10, 1.27), 6) AS rain, (l_quantity >= 5)::INT AS cloud
FROM (SELECT *, 800 + l_quantity * 4 AS p, 6.112 * exp(17.67 * (l_discount * 300 - 5) / (l_discount * 300 - 5 + 243.5)) AS e FROM lineitem)""")
def q_met_mixing(spark, sf_dir):
    """Mixing ratios from pressure and dew point, rain rates and cloud flags."""
    df, c = load(spark, sf_dir, "lineitem"), F.col
    ratio = met.mixing_ratio(c("l_quantity") * 4 + 800, c("l_discount") * 300 - 5)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(ratio, 9).alias("ratio"), F.round(met.rain_rate(c("l_tax")), 6).alias("rain"), met.cloudy(c("l_quantity")).alias("cloud"))


@query("""SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '1985-01-01')) / 3600000000.0, 6) AS hours, ts::TIMESTAMP AS back, date_trunc('second', ts)::TIMESTAMP AS pieces, strftime(ts, '%y%j')::INT + 2000000 AS day,
 CASE WHEN date_trunc('hour', ts) = ts THEN ts - INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END::TIMESTAMP AS bin FROM events""")
def q_time_numbers(spark, sf_dir):
    """Times as numbers since a date and back, as year-day and hour integers and back, with two-digit years widened, and in hours open at their start."""
    ts = F.col("ts").cast("timestamp")
    n = times.to_number(ts, "hours since 1985-01-01 00:00:00 UTC")
    back = times.from_number(times.to_number(ts, "seconds since 2024-01-01"), "seconds since 2024-01-01")
    pieces = times.from_yyyyjjj(times.yyyyjjj(ts), times.hhmmss(ts))
    day = times.widen_year(F.date_format(ts, "yyDDD").cast("int"))
    ntz = lambda c: c.cast("timestamp_ntz")
    return load(spark, sf_dir, "events").select("event_id", F.round(n, 6).alias("hours"), ntz(back).alias("back"), ntz(pieces).alias("pieces"), day.alias("day"), ntz(times.hour_bin(ts)).alias("bin"))


@query(f"""SELECT c_custkey, round((sin(radians(lat + 4)) - sin(radians(lat))) * radians(5.0) * {geo.RADIUS!r} ** 2, 3) AS area, round(101325.0 - (lat + 70) / 140 * 91325.0, 6) AS pressure, round(-ln((1013.25 - lat) / 1013.25) * 7.6, 9) AS height FROM ({_PT})""")
def q_grid_areas(spark, sf_dir):
    """Areas of cells of 4 by 5 degrees from their southern edge, pressures of sigma levels, heights of pressures."""
    p = _spots(load(spark, sf_dir, "customer"), "c_custkey", 7919, 104729)
    lat = F.col("lat")
    sigma = geo.pressure(1 - (lat + 70) / 140)
    return p.select("c_custkey", F.round(geo.cell_area(lat, lat + 4, F.lit(5.0)), 3).alias("area"), F.round(sigma, 6).alias("pressure"), F.round(geo.standard_height(1013.25 - lat), 9).alias("height"))


@query(_VEC + "SELECT vec__i, k__i, round(v, 6) AS kept, round(v * v + 1, 6) AS made FROM vec")
def q_copy_exclude(spark, sf_dir):
    """A variable copied, one made from it, and the first left out."""
    ds = select.copy_var(vectors(spark, sf_dir), "v", "kept")
    ds = select.new_var(ds, "made", F.col("v") * F.col("v") + 1, "v", units="1")
    return r6(select.subset(ds, ["v"], exclude=True).to_frame(), "kept", "made")
