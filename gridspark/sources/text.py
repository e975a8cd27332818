"""Readers and writers of text formats of observations and model inputs.

Paths go to Spark's own readers, so any store that Spark reads will do; only headers pass through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.model import Dataset, Var, idx

COORDS = ("time", "layer", "lay", "level", "lev", "latitude", "lat", "longitude", "lon", "row", "col", "site")


def hex_profile(df: DataFrame, column: str, width: int, levels: int) -> DataFrame:
    """A row for each level of a profile written as hexadecimal numbers of one width."""
    parts = F.array(*[F.conv(F.substring(column, width * k + 1, width), 16, 10).cast("int") for k in range(levels)])
    return df.select(*[c for c in df.columns if c != column], F.posexplode(parts).alias("level", "back"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and n: the lines of one text file and their numbers from 0, without passing through one task."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id__"))
    rows = rows.withColumn("p__", F.shiftright("id__", 33))
    counts = sorted((r["p__"], r["c"]) for r in rows.groupBy("p__").agg(F.count("*").alias("c")).collect())
    start, at = [], 0
    for p, c in counts:
        start.append((p, at))
        at += c
    base = spark.createDataFrame(start, "p__ long, s__ long")
    return rows.join(F.broadcast(base), "p__").select("value", (F.col("id__").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("s__")).alias("n"))


def read_fixed(spark: SparkSession, path: str, fields: dict[str, tuple[int, int, str]], skip: int = 0) -> DataFrame:
    """Fixed-width columns: name -> (first character from 1, width, type); blanks are masked."""
    rows = lines(spark, path).filter(F.col("n") >= skip)
    return rows.select(*[F.expr(f"try_cast(nullif(trim(substring(value, {a}, {w})), '') AS {t})").alias(c) for c, (a, w, t) in fields.items()])


def read_grid_csv(spark: SparkSession, path: str, coords: Sequence[str] = COORDS, sep: str = ",") -> Dataset:
    """A delimited table as a dense dataset: columns that name coordinates become dimensions, missing cells are masked."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    own = [c for c in df.columns if c.lower() in coords]
    names = [c for c in df.columns if c not in own]
    dims, out = {}, df
    axes = {}
    for c in own:
        values = df.select(c).distinct()
        axis = values.withColumn(idx(c), (F.row_number().over(Window.orderBy(c)) - 1).cast("int"))
        dims[c] = values.count()
        axes[c] = axis
        out = out.join(F.broadcast(axis) if dims[c] <= 100_000 else axis, c)
    ds = Dataset.from_frame(out, dims, names, dense=False)
    for c, axis in axes.items():
        ds = ds.with_var(c, (c,), axis.select(idx(c), c))
    return ds.set_coords(*own)


def write_grid_csv(ds: Dataset, path: str) -> list[str]:
    """One folder of CSV for each combination of dimensions, in index order; coordinates stand in place of indexes where there are some."""
    made = []
    for key in ds.frames:
        if len(key) == 1 and key[0] in ds.coords:
            continue
        df = ds.to_frame(key)
        for d in key:
            if d in ds.coords:
                axis = ds.frames[(d,)].select(idx(d), d)
                df = df.join(F.broadcast(axis) if ds.dims[d] <= 100_000 else axis, idx(d))
        df = df.orderBy(*ds.index(key)).select(*[d if d in ds.coords else idx(d) for d in key], *[v for v in ds.names(key) if v not in ds.coords])
        to = f"{path}/{'_'.join(key) or 'scalar'}"
        df.write.mode("overwrite").csv(to, header=True)
        made.append(to)
    return made


def read_icartt(spark: SparkSession, path: str) -> Dataset:
    """NASA Ames 1001: a header, then comma-separated points; scales apply and missing values are masked."""
    first = spark.read.text(path).first()[0]
    n_head = int(re.split(r"[,\s]+", first.strip())[0])
    head = [r[0] for r in spark.read.text(path).take(n_head)]
    n_var = int(head[9])
    numbers = lambda a, n: [float(x) for x in re.split(r"[,\s]+", " ".join(head[a : a + n]).strip().strip(",")) if x]
    scales, missing = numbers(10, 1), numbers(11, 1)
    at = 12
    described = head[at : at + n_var]
    clean = lambda s: s.split(",")[0].strip().replace(" ", "_")
    names = [x.strip() for x in re.split(r"[,\s]+", head[n_head - 1].strip()) if x.strip()]
    unit_of = {clean(d): (d.split(",")[1].strip() if "," in d else "unknown") for d in [head[8], *described]}
    names = names if len(names) == n_var + 1 else [clean(head[8]), *map(clean, described)]
    parts = F.split(F.trim("value"), r"[,\s]+")
    rows = lines(spark, path).filter((F.col("n") >= n_head) & (F.length(F.trim("value")) > 0))
    cols = []
    for k, c in enumerate(names):
        v = parts[k].cast("double")
        cols.append((v if k == 0 else F.when(v != missing[k - 1], v * scales[k - 1])).alias(c))
    df = rows.select((F.col("n") - n_head).cast("int").alias(idx("POINTS")), *cols)
    attrs = {"PI_NAME": head[1], "ORGANIZATION_NAME": head[2], "SOURCE_DESCRIPTION": head[3], "MISSION_NAME": head[4], "SDATE": head[6][:10]}
    for line in head[12 + n_var : -1]:
        if ":" in line:
            k, _, v = line.partition(":")
            attrs[k.strip()] = v.strip()
    ds = Dataset({"POINTS": df.count()}, {c: Var(("POINTS",), {"units": unit_of.get(c, unit_of.get(clean(c), "unknown"))}) for c in names}, {("POINTS",): df}, attrs)
    return ds.set_coords(names[0])


def write_icartt(ds: Dataset, path: str, missing: float = -9999.0) -> None:
    """NASA Ames 1001: one text of header and points, in the order of their index; masked values become ``missing``.

    The first variable (a coordinate, if there is one) stands first in each line.  The
    format is one stream, so one task writes it, sorted as Spark sorts, not in memory.
    """
    names = sorted(ds.names(("POINTS",)), key=lambda v: v not in ds.coords)
    unit = lambda v: f"{v}, {str(ds.vars[v].attrs.get('units', 'unknown')).strip()}"
    rest, a = names[1:], ds.attrs
    day = str(a.get("SDATE", "1970, 01, 01"))
    own = [f"{k}: {v}" for k, v in a.items() if k not in ("PI_NAME", "ORGANIZATION_NAME", "SOURCE_DESCRIPTION", "MISSION_NAME", "SDATE", "history")]
    head = [str(a.get(k, "unknown")) for k in ("PI_NAME", "ORGANIZATION_NAME", "SOURCE_DESCRIPTION", "MISSION_NAME")] + ["1, 1", f"{day}, {day}", "0", unit(names[0]), str(len(rest))]
    head += [", ".join(["1"] * len(rest)), ", ".join([repr(missing)] * len(rest)), *map(unit, rest), "0", str(len(own) + 1), *own, ",".join(names)]
    head.insert(0, f"{len(head) + 1}, 1001")
    spark = ds.spark
    top = spark.createDataFrame([(-len(head) + i, line) for i, line in enumerate(head)], "n long, value string")
    line = F.concat_ws(",", F.col(names[0]).cast("string"), *[F.coalesce(F.col(v).cast("string"), F.lit(repr(missing))) for v in rest])
    body = ds.to_frame(("POINTS",)).select(F.col(idx("POINTS")).cast("long").alias("n"), line.alias("value"))
    top.unionByName(body).repartition(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def read_icon_profile(spark: SparkSession, path: str, edges: int = 1) -> Dataset:
    """Species by layer (or, with four ``edges``, by side too) of an initial or boundary profile."""
    rows = [r[0] for r in spark.read.text(path).collect()]  # a profile has some dozens of lines
    head = rows[3].split()
    n_lay, n_spc = int(head[0]), int(head[1])
    sigma = [float(x) for x in head[2:]]
    cells, names = {}, []
    at = 5
    for e in range(edges):
        at += edges > 1  # a side's name stands before its table
        for line in rows[at : at + n_spc]:
            m = re.match(r"\s*[\"']?([^\"']+?)[\"']?\s+([-+\d.eEdD\s]+)$", line)
            name = m[1].strip()
            if name not in names:
                names.append(name)
            for k, x in enumerate(m[2].split()[:n_lay]):
                cells[k, e, name] = float(x.replace("D", "E").replace("d", "e"))
        at += n_spc
    dims = {"LAY": n_lay} if edges == 1 else {"LAY": n_lay, "south_east_north_west": edges}
    table = [tuple([k, *([e] if edges > 1 else []), *(cells.get((k, e, n)) for n in names)]) for k in range(n_lay) for e in range(edges)]
    df = spark.createDataFrame(table, ", ".join([*(f"{idx(d)} int" for d in dims), *(f"`{n}` double" for n in names)]))
    unit = lambda n: "m**2/m**3" if n.startswith("SRF") else "1/m**3" if n.startswith("NUM") else "ug/m**3" if n.startswith("A") and n != "ALD2" and n[1:2].isupper() and n[-1] in "IJK" else "ppmV"
    return Dataset.from_frame(df, dims, names, {"VGLVLS": sigma, "VGTOP": 5000.0}, {n: {"units": unit(n)} for n in names})


def read_griddesc(spark: SparkSession, path: str) -> dict[str, dict]:
    """Grids by name with their projection's and their own attributes; such files are small."""
    rows = [r[0].split("!")[0].strip() for r in spark.read.text(path).collect()]
    rows = [r for r in rows if r]
    projections: dict[str, list[float]] = {}
    grids: dict[str, dict] = {}
    section, k = 0, 0
    while k < len(rows):
        name = rows[k].strip("'\" ").strip()
        if not name:
            section, k = section + 1, k + 1
            continue
        body = re.split(r"[,\s]+", rows[k + 1].replace("D", "E").strip(" ,"))
        if section <= 1 and not any("'" in x for x in body):
            projections[name] = [float(x) for x in body]
        else:
            p = body[0].strip("'\"")
            x0, y0, dx, dy, nc, nr, *thick = (float(x) for x in body[1:])
            kind, a, b, g, xc, yc = projections[p]
            grids[name] = {"GDNAM": name, "GDTYP": int(kind), "P_ALP": a, "P_BET": b, "P_GAM": g, "XCENT": xc, "YCENT": yc, "XORIG": x0, "YORIG": y0, "XCELL": dx, "YCELL": dy, "NCOLS": int(nc), "NROWS": int(nr), "NTHIK": int(thick[0]) if thick else 1}
        k += 2
    return grids


def template(spark: SparkSession, grid: dict, layers: int = 1, steps: int = 1, names: Sequence[str] = ()) -> Dataset:
    """An empty dense dataset on a described grid."""
    dims = {"TSTEP": steps, "LAY": layers, "ROW": grid["NROWS"], "COL": grid["NCOLS"]}
    n = layers * grid["NROWS"] * grid["NCOLS"] * steps
    i = F.col("id")
    cols, rest = {}, n
    for d, m in dims.items():
        rest //= m
        cols[idx(d)] = (F.floor(i / rest) % m).cast("int")
    df = spark.range(n).select(*[c.alias(k) for k, c in cols.items()], *[F.lit(None).cast("float").alias(v) for v in names])
    return Dataset.from_frame(df, dims, names, grid)


def read_aqs(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hourly station measurements: the mean of each parameter, unit, hour and site.

    A site is its three codes, filled up to 2, 3 and 4 characters; longer codes stay whole.
    """
    df = spark.read.csv(path, header=True)
    t = F.to_timestamp(F.concat_ws(" ", "Date GMT", "Time GMT"), "yyyy-MM-dd HH:mm")
    # lpad alone would cut a longer code, and make one site of several
    code = lambda c, n: F.lpad(c, F.greatest(F.lit(n), F.length(c)), "0")
    site = F.concat(code("State Code", 2), code("County Code", 3), code("Site Num", 4))
    df = df.withColumns({"time": t, "site": site})
    if start:
        df = df.filter(F.col("time") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col("time") <= F.lit(end).cast("timestamp"))
    num = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    return df.groupBy(F.col("Parameter Name").alias("parameter"), F.col("Units of Measure").alias("units"), "time", "site").agg(F.avg(num("Sample Measurement")).alias("value"), F.avg(num("Latitude")).alias("lat"), F.avg(num("Longitude")).alias("lon"))
