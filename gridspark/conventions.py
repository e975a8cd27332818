"""Gridded-model conventions that stay true after every operator.

A convention ties attributes to dimensions: the start, length and number of time
steps to TSTEP, origin and cell size to COL and ROW, level edges to LAY, the list
of variables to VAR.  An operator reports what it did to a dimension as ``Cells``
(which old cells each new cell holds), and one rule a dimension renews or drops
the attributes; so an operator knows nothing of attributes, and a rule nothing of
operators.  Nothing of this reads data.  TFLAG is made from the attributes when
it is asked for, as rows that Spark spreads; only steps that a caller listed one by
one are kept as a list.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import expr
from gridspark.functions.times import hhmmss, yyyyjjj
from gridspark.model import Dataset, Var, idx
from gridspark.operators import combine, reduce, regrid, select, window

#: Attributes that a file of this convention has, and what they are without a source.
DEFAULTS = {
    "FTYPE": 1, "SDATE": 1970001, "STIME": 0, "TSTEP": 10000, "NTHIK": 1, "NCOLS": 1, "NROWS": 1, "NLAYS": 1, "NVARS": 0, "GDTYP": 1,
    "P_ALP": 0.0, "P_BET": 0.0, "P_GAM": 0.0, "XCENT": 0.0, "YCENT": 0.0, "XORIG": 0.0, "YORIG": 0.0, "XCELL": 1.0, "YCELL": 1.0,
    "VGTYP": -9999, "VGTOP": 5000.0, "VGLVLS": [1.0, 0.0], "GDNAM": "UNKNOWN", "UPNAM": "GRIDSPARK", "VAR-LIST": "",
}
#: Widths of names in lists and attributes.
NAME, DESCRIPTION = 16, 80


def seconds(hms: int) -> int:
    """Seconds of an hour-minute-second integer of any number of hours."""
    sign, n = (-1 if hms < 0 else 1), abs(int(hms))
    return sign * (n // 10000 * 3600 + n // 100 % 100 * 60 + n % 100)


def as_hms(s: int) -> int:
    sign, n = (-1 if s < 0 else 1), abs(int(s))
    return sign * (n // 3600 * 10000 + n // 60 % 60 * 100 + n % 60)


def start_of(attrs: dict) -> datetime:
    """The time of SDATE and STIME."""
    return datetime.strptime(f"{int(attrs['SDATE']):07d}", "%Y%j") + timedelta(seconds=seconds(attrs["STIME"]))


def _at(when: datetime) -> dict:
    return {"SDATE": int(when.strftime("%Y%j")), "STIME": int(when.strftime("%H%M%S"))}


@dataclass(frozen=True)
class Cells:
    """Which old cells each new cell of a dimension holds.

    New cell j holds ``width`` cells from ``start + j * step`` on, parts of cells
    where these were split; or the one in ``listed``.  ``func`` is the reduction's name.
    """

    old: int
    new: int
    start: Fraction = Fraction(0)
    step: Fraction = Fraction(1)
    width: Fraction = Fraction(1)
    listed: tuple[int, ...] | None = None
    func: str | None = None

    @staticmethod
    def of_slice(old: int, by: int | slice | Sequence[int]) -> Cells:
        if isinstance(by, int):
            return Cells(old, 1, Fraction(by % old if old else 0))
        if isinstance(by, slice):
            r = range(*by.indices(old))
            return Cells(old, len(r), Fraction(r.start), Fraction(r.step))
        at = tuple(i % old for i in by)
        steps = {b - a for a, b in zip(at, at[1:], strict=False)}
        if len(steps) <= 1:  # evenly spaced: as good as a slice
            return Cells(old, len(at), Fraction(at[0] if at else 0), Fraction(steps.pop() if steps else 1))
        return Cells(old, len(at), listed=at)


def _time(attrs: dict, cells: Cells) -> dict:
    """A cell has the time of the first step in it and the length of all; steps listed unevenly keep their times as a list."""
    step = seconds(attrs["TSTEP"])
    held = attrs.get("STEP_SECONDS")
    begins = start_of(attrs)
    if held is not None or cells.listed is not None:
        of = (lambda i: held[int(i)]) if held is not None else (lambda i: i * step)
        offsets = [of(i) for i in (cells.listed if cells.listed is not None else [min(cells.start + j * cells.step, cells.old - 1) for j in range(cells.new)])]
        gaps = {b - a for a, b in zip(offsets, offsets[1:], strict=False)}
        new = {k: v for k, v in attrs.items() if k != "STEP_SECONDS"} | _at(begins + timedelta(seconds=int(offsets[0]) if offsets else 0))
        if len(gaps) > 1:
            warnings.warn("time steps are uneven", stacklevel=3)
            return new | {"TSTEP": 0, "STEP_SECONDS": [int(o - offsets[0]) for o in offsets]}
        return new | {"TSTEP": as_hms(gaps.pop()) if gaps else attrs["TSTEP"] or as_hms(3600)}
    length = step * (cells.step if cells.new > 1 else max(cells.width, 1) if cells.width >= 1 else cells.width)
    # steps taken backwards run backwards
    return attrs | _at(begins + timedelta(seconds=float(step * cells.start))) | {"TSTEP": as_hms(int(length))}


def _axis(origin: str, cell: str, count: str) -> Callable[[dict, Cells], dict]:
    def rule(attrs: dict, cells: Cells) -> dict:
        new = attrs | {count: cells.new}
        if cells.listed is not None:
            warnings.warn(f"cells are uneven: {origin} and {cell} are dropped", stacklevel=3)
            return {k: v for k, v in new.items() if k not in (origin, cell)}
        if origin not in attrs or cell not in attrs:
            return new
        size = cells.step if cells.new > 1 else cells.width
        # middles stay where they were, also of cells that a slice left far apart
        return new | {origin: attrs[origin] + attrs[cell] * float(cells.start + (cells.width - size) / 2), cell: attrs[cell] * float(size)}

    return rule


def _levels(attrs: dict, cells: Cells) -> dict:
    """Edges of the layers: those below the picked ones and the last one's upper; split layers have edges between.

    Where layers were reduced, the lower and the upper edges were reduced the same way.
    """
    new = attrs | {"NLAYS": cells.new}
    edges = attrs.get("VGLVLS")
    if edges is None or len(edges) != cells.old + 1:
        return {k: v for k, v in new.items() if k != "VGLVLS"}
    between = lambda p: edges[int(p)] + float(p - int(p)) * (edges[min(int(p) + 1, cells.old)] - edges[int(p)])
    if cells.listed is not None:
        return new | {"VGLVLS": [edges[i] for i in cells.listed] + [edges[cells.listed[-1] + 1]]} if cells.listed else {k: v for k, v in new.items() if k != "VGLVLS"}
    if cells.func in _EDGE_FUNCTIONS and cells.new == 1:
        f = _EDGE_FUNCTIONS[cells.func]
        return new | {"VGLVLS": [f(edges[:-1]), f(edges[1:])]}
    if not cells.new:
        return {k: v for k, v in new.items() if k != "VGLVLS"}
    first = [cells.start + j * cells.step for j in range(cells.new)]
    return new | {"VGLVLS": [between(p) for p in first] + [between(min(first[-1] + cells.width, Fraction(cells.old)))]}


_EDGE_FUNCTIONS: dict[str, Callable[[list[float]], float]] = {"mean": lambda e: sum(e) / len(e), "min": min, "max": max, "sum": sum}

RULES: dict[str, Callable[[dict, Cells], dict]] = {
    "TSTEP": _time,
    "COL": _axis("XORIG", "XCELL", "NCOLS"),
    "ROW": _axis("YORIG", "YCELL", "NROWS"),
    "LAY": _levels,
}
#: Attributes that have no meaning without a dimension.
OWN = {"TSTEP": ("SDATE", "STIME", "TSTEP", "STEP_SECONDS"), "COL": ("XORIG", "XCELL", "NCOLS"), "ROW": ("YORIG", "YCELL", "NROWS"), "LAY": ("VGLVLS", "NLAYS")}


@dataclass(frozen=True)
class Ioapi:
    """A dataset whose attributes are true of it; each operator gives a new one."""

    ds: Dataset

    @staticmethod
    def of(ds: Dataset, **attrs: object) -> Ioapi:
        """Takes a dataset in: attributes that lack get their defaults, counts are those of the dimensions."""
        return Ioapi(replace(ds, attrs={**DEFAULTS, **ds.attrs, **attrs}))._counted()

    @property
    def attrs(self) -> dict:
        return self.ds.attrs

    def variables(self) -> list[str]:
        """Names that the list of variables holds: at most 16 characters, on steps and layers; those of the old list first, in its order."""
        before = str(self.attrs.get("VAR-LIST", ""))
        names = [before[i : i + NAME].strip() for i in range(0, len(before), NAME)] if len(before) % NAME == 0 else before.split()
        fits = [v for v, x in self.ds.vars.items() if v not in self.ds.coords and v != "TFLAG" and len(v) <= NAME and x.dims[:2] == ("TSTEP", "LAY")]
        return [v for v in names if v in fits] + [v for v in fits if v not in names]

    def _counted(self) -> Ioapi:
        names, dims = self.variables(), self.ds.dims
        counts = {a: dims[d] for d, a in (("LAY", "NLAYS"), ("ROW", "NROWS"), ("COL", "NCOLS")) if d in dims}
        full = lambda v, x: {"long_name": v.ljust(NAME), "units": str(x.attrs.get("units", "unknown")).ljust(NAME), "var_desc": str(x.attrs.get("var_desc", v)).ljust(DESCRIPTION)}
        vars_ = {v: replace(x, attrs={**x.attrs, **full(v, x)}) if v in names else x for v, x in self.ds.vars.items()}
        attrs = {**self.attrs, **counts, "NVARS": len(names), "VAR-LIST": "".join(v.ljust(NAME) for v in names)}
        return Ioapi(replace(self.ds, vars=vars_, attrs=attrs))

    def after(self, ds: Dataset, **changes: Cells | None) -> Ioapi:
        """``ds``, made from this by an operator that did ``changes`` to dimensions (None: the dimension is gone)."""
        attrs = dict(self.attrs)
        for d, cells in changes.items():
            if cells is None:
                attrs = {k: v for k, v in attrs.items() if k not in OWN.get(d, ())}
            elif d in RULES:
                attrs = RULES[d](attrs, cells)
        return Ioapi(replace(ds, attrs=attrs))._counted()

    # ---- operators

    def slice(self, new_dim: str = "POINTS", **by: int | slice | Sequence[int]) -> Ioapi:
        ds = select.slice_dims(self.ds, new_dim, **by)
        lists = [d for d, v in by.items() if not isinstance(v, (int, slice))]
        gone = set(lists) if len(lists) > 1 else set()
        used = {d for x in ds.vars.values() for d in x.dims}
        ds = replace(ds, dims={d: n for d, n in ds.dims.items() if d not in gone or d in used})
        return self.after(ds, **{d: None if d in gone else Cells.of_slice(self.ds.dims[d], v) for d, v in by.items()})

    def apply(self, **by: str | Callable[[Column], Column]) -> Ioapi:
        whole = lambda d, f: Cells(self.ds.dims[d], 1, step=Fraction(self.ds.dims[d]), width=Fraction(self.ds.dims[d]), func=f if isinstance(f, str) else None)
        return self.after(reduce.apply_along(self.ds, **by), **{d: whole(d, f) for d, f in by.items()})

    def coarsen(self, dim: str, factor: int, name: str) -> Ioapi:
        n = self.ds.dims[dim]
        return self.after(reduce.coarsen(self.ds, dim, factor, name), **{dim: Cells(n, -(-n // factor), step=Fraction(factor), width=Fraction(factor))})

    def refine(self, dim: str, factor: int) -> Ioapi:
        n = self.ds.dims[dim]
        return self.after(reduce.refine(self.ds, dim, factor), **{dim: Cells(n, n * factor, step=Fraction(1, factor), width=Fraction(1, factor))})

    def convolve(self, dim: str, weights: list[float]) -> Ioapi:
        """Only whole kernels; a new cell keeps the place of the first old one."""
        n = self.ds.dims[dim]
        return self.after(window.convolve(self.ds, dim, weights), **{dim: Cells(n, n - len(weights) + 1)})

    def subset(self, names: Sequence[str], exclude: bool = False) -> Ioapi:
        return self.after(select.subset(self.ds, names, exclude))

    def rename(self, names: dict[str, str]) -> Ioapi:
        old = str(self.attrs.get("VAR-LIST", ""))
        out = self.after(select.rename_vars(self.ds, names))
        order = "".join(names.get(v, v).ljust(NAME) for v in (old[i : i + NAME].strip() for i in range(0, len(old), NAME)))
        return Ioapi(out.ds.set_attrs(**{"VAR-LIST": order}))._counted()

    def mask(self, where: Column | None = None, **conditions: object) -> Ioapi:
        return self.after(select.mask(self.ds, where, **conditions))

    def eval(self, text: str, copy_all: bool = False) -> Ioapi:
        return self.after(expr.evaluate(self.ds, text, copy_all))

    def stack(self, *others: Ioapi, dim: str = "TSTEP") -> Ioapi:
        """Along a dimension; along TSTEP, steps must go on evenly or their times are kept as a list."""
        parts = [self, *others]
        ds = combine.stack([p.ds for p in parts], dim)
        n = ds.dims[dim]
        if dim == "TSTEP":
            origin = start_of(self.attrs)
            runs = [(int((start_of(p.attrs) - origin).total_seconds()), p.attrs.get("STEP_SECONDS"), seconds(p.attrs["TSTEP"]), p.ds.dims["TSTEP"]) for p in parts]
            step, at, even = runs[0][2], 0, True
            for begins, held, own, k in runs:
                even &= held is None and (own == step or k == 1) and begins == at * step
                at += k
            if even:
                return self.after(ds)
            offsets = [begins + (held[i] if held is not None else i * own) for begins, held, own, k in runs for i in range(k)]
            warnings.warn("time steps are uneven", stacklevel=2)
            return Ioapi(ds.set_attrs(TSTEP=0, STEP_SECONDS=offsets))._counted()
        if dim == "LAY" and all(p.attrs.get("VGLVLS") is not None for p in parts):
            edges = list(self.attrs["VGLVLS"])
            for p in others:
                own = list(p.attrs["VGLVLS"])
                if own[0] != edges[-1]:
                    warnings.warn("layers don't meet: VGLVLS is dropped", stacklevel=2)
                    return Ioapi(replace(ds, attrs={k: v for k, v in self.attrs.items() if k != "VGLVLS"}))._counted()
                edges += own[1:]
            return Ioapi(ds.set_attrs(VGLVLS=edges, NLAYS=n))._counted()
        return self.after(ds)

    def interpolate_sigma(self, edges: list[float], top: float | None = None, kind: str = "linear") -> Ioapi:
        ds = regrid.interpolate_sigma(self.ds, "LAY", list(self.attrs["VGLVLS"]), edges, self.attrs["VGTOP"], top, kind)
        return Ioapi(ds)._counted()

    # ---- what the attributes say

    def times(self) -> DataFrame:
        """The time of each step, from the attributes (TSTEP__i, time)."""
        spark, step = self.ds.spark, idx("TSTEP")
        begins = int((start_of(self.attrs) - datetime(1970, 1, 1)).total_seconds())
        n = F.col("id").cast("int").alias(step)
        if (held := self.attrs.get("STEP_SECONDS")) is not None:
            rows = spark.createDataFrame(list(enumerate(held)), "id int, s long")
            return rows.select(n, F.timestamp_seconds(F.col("s") + begins).alias("time"))
        return spark.range(self.ds.dims["TSTEP"]).select(n, F.timestamp_seconds(F.col("id") * seconds(self.attrs["TSTEP"]) + begins).alias("time"))

    def tflag(self) -> DataFrame:
        """TFLAG: the date (0) and time (1) of each step for each variable; one variable's at least."""
        variables = F.explode(F.sequence(F.lit(0), F.lit(max(self.attrs["NVARS"], 1) - 1))).alias(idx("VAR"))
        parts = F.posexplode(F.array(yyyyjjj(F.col("time")), hhmmss(F.col("time")))).alias(idx("DATE-TIME"), "TFLAG")
        return self.times().select("*", variables).select(idx("TSTEP"), idx("VAR"), parts)

    def with_tflag(self) -> Dataset:
        """The dataset with TFLAG among its variables, as files hold it."""
        key = ("TSTEP", "VAR", "DATE-TIME")
        out = replace(self.ds, dims={**self.ds.dims, "VAR": max(self.attrs["NVARS"], 1), "DATE-TIME": 2})
        attrs = {"units": "<YYYYDDD,HHMMSS>", "long_name": "TFLAG".ljust(NAME), "var_desc": "Timestep-valid flags:  (1) YYYYDDD or (2) HHMMSS".ljust(DESCRIPTION)}
        return out.with_var("TFLAG", key, self.tflag(), attrs).set_coords("TFLAG")

    def located(self) -> DataFrame:
        """Cells with what the attributes say of their place: date, time, x and y of the middle, lower and upper level edge."""
        df = self.ds.to_frame(next(self.ds.vars[v].dims for v in self.variables()))
        a, held = self.attrs, {c.lower() for c in df.columns}
        if idx("TSTEP").lower() in held and "SDATE" in a:
            if a.get("STEP_SECONDS") is None:
                begins = int((start_of(a) - datetime(1970, 1, 1)).total_seconds())
                df = df.withColumn("time__", F.timestamp_seconds(F.col(idx("TSTEP")).cast("long") * seconds(a["TSTEP"]) + begins))
            else:
                df = df.join(F.broadcast(self.times().withColumnRenamed("time", "time__")), idx("TSTEP"))
            df = df.withColumns({"date": yyyyjjj(F.col("time__")), "time": hhmmss(F.col("time__"))}).drop("time__")
        for d, name, origin, cell in (("COL", "x", "XORIG", "XCELL"), ("ROW", "y", "YORIG", "YCELL")):
            if idx(d).lower() in held and origin in a and cell in a:
                df = df.withColumn(name, a[origin] + (F.col(idx(d)) + 0.5) * a[cell])
        if idx("LAY").lower() in held and a.get("VGLVLS") is not None:
            edges = F.array(*[F.lit(float(e)) for e in a["VGLVLS"]])
            df = df.withColumns({"lower": F.get(edges, F.col(idx("LAY"))), "upper": F.get(edges, F.col(idx("LAY")) + 1)})
        return df

    def audit(self) -> dict[str, bool]:
        """Whether each attribute agrees with the dimensions and variables."""
        a, dims, listed = self.attrs, self.ds.dims, str(self.attrs.get("VAR-LIST", ""))
        names = [listed[i : i + NAME].strip() for i in range(0, len(listed), NAME)]
        out = {"VAR-LIST-LEN": len(listed) == NAME * a["NVARS"], "VAR-LIST": names == self.variables()}
        out |= {n: a.get(n) == dims[d] for d, n in (("LAY", "NLAYS"), ("ROW", "NROWS"), ("COL", "NCOLS")) if d in dims}
        if "LAY" in dims and a.get("VGLVLS") is not None:
            out["VGLVLS"] = len(a["VGLVLS"]) == dims["LAY"] + 1
        if a.get("STEP_SECONDS") is not None:
            out["STEP_SECONDS"] = len(a["STEP_SECONDS"]) == dims["TSTEP"]
        return out | {f"has_{v}": v in self.ds.vars for v in names}


def is_ioapi(ds: Dataset) -> bool:
    """Whether a dataset has the dimensions and grid attributes of the convention."""
    return {"TSTEP", "VAR", "DATE-TIME"} <= set(ds.dims) and {"XORIG", "YORIG", "XCELL", "YCELL", "NCOLS", "NROWS", "SDATE", "TSTEP"} <= set(ds.attrs)


def drop_tflag(ds: Dataset) -> Ioapi:
    """A file's dataset without its TFLAG, which the attributes stand for."""
    kept = select.subset(ds, ["TFLAG"], exclude=True, keep_coords=False) if "TFLAG" in ds.vars else ds
    return Ioapi.of(replace(kept, dims={d: n for d, n in kept.dims.items() if d not in ("VAR", "DATE-TIME")}))


#: Other names of the convention's dimensions, for datasets from elsewhere.
SYNONYMS = {"time": "TSTEP", "layer": "LAY", "level": "LAY", "lev": "LAY", "latitude": "ROW", "lat": "ROW", "y": "ROW", "longitude": "COL", "lon": "COL", "x": "COL"}


def to_ioapi(spark: SparkSession, ds: Dataset, **attrs: object) -> Ioapi:
    """Any dataset in this convention: dimensions get its names, long names of variables are cut to 16 characters, missing dimensions are added with length 1."""
    ds = select.rename_dims(ds, {d: SYNONYMS[d.lower()] for d in ds.dims if d.lower() in SYNONYMS and SYNONYMS[d.lower()] not in ds.dims})
    short = {v: v[:NAME] for v in ds.vars if len(v) > NAME}
    if len(set(short.values()) | (set(ds.vars) - set(short))) < len(ds.vars):
        raise ValueError(f"names that are alike in their first {NAME} characters: {sorted(short)}")
    ds = select.rename_vars(ds, short)
    order = ["TSTEP", "LAY", "ROW", "COL"]
    frames, vars_, dims = {}, {}, dict(ds.dims)
    for key, df in ds.frames.items():
        if set(key) & set(order) and not set(key) - set(order) and len(key) > 1:
            to = tuple(order)
            dims |= {d: 1 for d in order if d not in dims}
            df = df.withColumns({idx(d): F.lit(0) for d in order if d not in key})
        else:
            to = key
        frames[to] = frames[to].join(df, ds.index(to), "full") if to in frames else df
        vars_ |= {v: Var(to, ds.vars[v].attrs) for v in ds.names(key)}
    return Ioapi.of(Dataset(dims, {v: vars_[v] for v in ds.vars}, frames, ds.attrs, ds.coords, ds.groups), **attrs)


def write_ioapi(f: Ioapi, path: str, steps: int = 24, prefix: str = "ioapi.", mode: str = "append") -> None:
    """Classic netCDF files of ``steps`` time steps each, with TFLAG and the attributes that are true of each file; tasks write whole files.

    Cells must be dense; masked ones become NaN.
    """
    from gridspark.sources.records import _write

    names, a = f.variables(), {k: v for k, v in f.attrs.items() if k != "STEP_SECONDS" and v is not None}
    key = ("TSTEP", "LAY", "ROW", "COL")
    if not names or any(f.ds.vars[v].dims != key for v in names):
        raise ValueError(f"variables on {key} only; there are {names}")
    times = f.times().select(idx("TSTEP"), yyyyjjj(F.col("time")).alias("date"), (F.unix_timestamp("time") - F.unix_timestamp(F.date_trunc("day", "time"))).alias("s__"))
    cells = f.ds.to_frame(key).join(times, idx("TSTEP"))
    long = cells.select(F.col(idx("TSTEP")).alias("step"), "date", (F.col("s__") / 3600).alias("hour"), idx("LAY"), idx("ROW"), idx("COL"), F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.coalesce(F.col(v).cast("float"), F.lit(float("nan"))).alias("value")) for v in names])).alias("x"))
    about = {"format": "ioapi", "nz": f.ds.dims["LAY"], "ny": f.ds.dims["ROW"], "nx": f.ds.dims["COL"], "steps": steps, "attrs": a, "about": {v: f.ds.vars[v].attrs for v in names}}
    _write(long.select("step", "date", "hour", "x.name", idx("LAY"), idx("ROW"), idx("COL"), "x.value"), path, about, names, prefix, mode)


def read_ioapi(spark: SparkSession, path: str, names: list[str] | None = None) -> Ioapi:
    """A file, or a folder of files that follow each other in time; attributes are those of the first, counts those of all."""
    from gridspark.sources.netcdf import open_netcdf

    f = drop_tflag(open_netcdf(spark, path, names))
    nan = {v: F.nanvl(F.col(v), F.lit(None).cast("double")) for v in f.variables()}
    return Ioapi(f.ds.map_frames(lambda key, df: df.withColumns({v: c for v, c in nan.items() if v in df.columns})))
