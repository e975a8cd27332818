"""Labelled datasets: named dimensions and typed variables over lazy DataFrames.

Variables with the same dimensions share one DataFrame, a row for each cell with an
index column ``<dim>__i`` (from 0) for each dimension.  Lengths, attributes and
coordinate names stay on the driver, so no job is needed to know a shape.  A
masked cell is NULL.  A dense group has a row for every cell; ``densify`` makes one.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Dims = tuple[str, ...]


def idx(dim: str) -> str:
    return f"{dim}__i"


@dataclass(frozen=True)
class Var:
    """What the driver knows of a variable."""

    dims: Dims
    attrs: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Dataset:
    """An immutable bundle; every operator returns a new one."""

    dims: dict[str, int]
    vars: dict[str, Var]
    frames: dict[Dims, DataFrame]
    attrs: dict = field(default_factory=dict)
    coords: frozenset[str] = frozenset()
    groups: dict[str, Dataset] = field(default_factory=dict)

    # ---- construction

    @staticmethod
    def from_frame(df: DataFrame, dims: dict[str, int], variables: Iterable[str], attrs: dict | None = None, var_attrs: dict | None = None, dense: bool = True) -> Dataset:
        """A dataset of one group from rows that have the index columns; ``dense=False`` adds the missing cells as masked."""
        names, key = list(variables), tuple(dims)
        rows = df.select(*[F.col(idx(d)).cast("int").alias(idx(d)) for d in key], *names)
        out = Dataset(dict(dims), {v: Var(key, dict((var_attrs or {}).get(v, {}))) for v in names}, {key: rows}, dict(attrs or {}))
        return out if dense else out.densify(key)

    @staticmethod
    def from_arrays(spark: SparkSession, arrays: dict, dims: dict[str, Dims] | None = None, **attrs: object) -> Dataset:
        """From numpy arrays; unnamed dimensions are called phony_dim_0 and so on by length."""
        import numpy as np
        import pandas as pd

        found = Dataset({}, {}, {}, dict(attrs))
        for name, a in arrays.items():
            a = np.ma.asarray(a)
            own = tuple((dims or {}).get(name) or [f"phony_dim_{i}" for i in range(a.ndim)])
            grid = np.indices(a.shape).reshape(a.ndim, -1)
            cols = {idx(d): grid[i] for i, d in enumerate(own)}
            values = pd.array(a.filled(0).ravel(), dtype="Float64") if a.dtype.kind == "f" else pd.array(a.filled(0).ravel(), dtype="Int64" if a.dtype.kind in "iu" else "object")
            values[np.ma.getmaskarray(a).ravel()] = pd.NA
            pdf = pd.DataFrame(cols | {name: values.astype(object)})
            pdf = pdf.where(pd.notna(pdf), None)
            kind = {"f": "double", "i": "long", "u": "long", "b": "boolean"}.get(a.dtype.kind, "string")
            df = spark.createDataFrame(pdf, ", ".join([*(f"{idx(d)} int" for d in own), f"`{name}` {kind}"]))
            found = found.merge(Dataset.from_frame(df, dict(zip(own, a.shape, strict=True)), [name]))
        return found

    def densify(self, key: Dims) -> Dataset:
        """Adds masked rows for the missing cells of a group."""
        df = self.frames[key]
        spark = df.sparkSession
        grid = reduce(lambda a, b: a.crossJoin(b), [spark.range(self.dims[d]).select(F.col("id").cast("int").alias(idx(d))) for d in key])
        return self.with_frame(key, grid.join(df, [idx(d) for d in key], "left"))

    def sparse(self, name: str, drop: float = 0.0) -> DataFrame:
        """The cells of a variable that are neither masked nor ``drop``."""
        return self.frame(name).select(*self.index(self.vars[name].dims), name).filter(F.col(name).isNotNull() & (F.col(name) != drop))

    # ---- access

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.frames.values())).sparkSession

    def index(self, key: Dims) -> list[str]:
        return [idx(d) for d in key]

    def names(self, key: Dims) -> list[str]:
        """The variables of a group."""
        return [v for v, x in self.vars.items() if x.dims == key]

    def frame(self, name: str) -> DataFrame:
        return self.frames[self.vars[name].dims]

    def with_frame(self, key: Dims, df: DataFrame) -> Dataset:
        return replace(self, frames={**self.frames, key: df})

    def with_var(self, name: str, key: Dims, df: DataFrame, attrs: dict | None = None) -> Dataset:
        return replace(self, frames={**self.frames, key: df}, vars={**self.vars, name: Var(key, dict(attrs or {}))})

    def map_frames(self, f) -> Dataset:
        return replace(self, frames={k: f(k, df) for k, df in self.frames.items()})

    def set_attrs(self, **attrs: object) -> Dataset:
        return replace(self, attrs={**self.attrs, **attrs})

    def edit_attr(self, name: str, var: str | None, mode: str, value: object = None) -> Dataset:
        """Attribute edits by mode: a append, c create if absent, m modify if present, o overwrite, d delete."""
        targets = [var] if var else [None]
        out = self
        for t in targets:
            own = dict(out.vars[t].attrs if t else out.attrs)
            if mode == "d":
                own.pop(name, None)
            elif mode == "o" or mode == "c" and name not in own or mode == "m" and name in own:
                own[name] = value
            elif mode == "a":
                own[name] = own[name] + value if name in own else value
            elif mode not in "cm":
                raise ValueError(f"no such mode: {mode}")
            out = replace(out, vars={**out.vars, t: replace(out.vars[t], attrs=own)}) if t else replace(out, attrs=own)
        return out

    def set_coords(self, *names: str) -> Dataset:
        return replace(self, coords=self.coords | set(names))

    def data_vars(self) -> list[str]:
        return [v for v in self.vars if v not in self.coords]

    def to_frame(self, key: Dims | None = None, order: bool = False) -> DataFrame:
        """A group's rows: index columns, then variables."""
        key = key if key is not None else max(self.frames, key=len)
        df = self.frames[key].select(*self.index(key), *self.names(key))
        return df.orderBy(*self.index(key)) if order else df

    def to_numpy(self, name: str):
        """A variable as a masked array; for small results only."""
        import numpy as np

        key = self.vars[name].dims
        out = np.ma.masked_all([self.dims[d] for d in key])
        for r in self.frame(name).select(*self.index(key), name).collect():
            if r[-1] is not None:
                out[tuple(r[:-1])] = r[-1]
        return out

    def describe(self) -> str:
        """The header in CDL."""
        lines = ["dimensions:", *(f"        {d} = {n} ;" for d, n in self.dims.items()), "variables:"]
        kinds = {v: dict(self.frame(v).dtypes)[v] for v in self.vars}
        for v, x in self.vars.items():
            lines.append(f"        {kinds[v]} {v}({', '.join(x.dims)}) ;")
            lines += [f"                {v}:{k} = {json.dumps(a, default=str)} ;" for k, a in x.attrs.items()]
        lines += ["// global attributes:", *(f"                :{k} = {json.dumps(a, default=str)} ;" for k, a in self.attrs.items())]
        return "\n".join(lines)

    # ---- combination that construction needs

    def merge(self, other: Dataset) -> Dataset:
        """The union of variables, dimensions and attributes; what is here wins."""
        for d, n in other.dims.items():
            if self.dims.get(d, n) != n:
                raise ValueError(f"dimension {d} has lengths {self.dims[d]} and {n}")
        new = {v: x for v, x in other.vars.items() if v not in self.vars}
        if twice := set(other.vars) - set(new):
            warnings.warn(f"kept the first of {sorted(twice)}", stacklevel=2)
        frames = dict(self.frames)
        for key in {x.dims for x in new.values()}:
            some = other.frames[key].select(*self.index(key), *[v for v, x in new.items() if x.dims == key])
            frames[key] = frames[key].join(some, self.index(key), "full") if key in frames and key else frames[key].crossJoin(some) if key in frames else some
        return Dataset({**other.dims, **self.dims}, {**self.vars, **new}, frames, {**other.attrs, **self.attrs}, self.coords | other.coords, {**other.groups, **self.groups})


def when_all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)
