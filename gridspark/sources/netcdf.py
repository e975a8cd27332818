"""Classic netCDF by slabs: the header is read, then only the ranges that are asked for.

A variable's rows along its first dimension are dealt to tasks by bytes, computed from
the header; filters on index columns choose rows of the first dimension before they
are read and cut the other dimensions in the task.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from gridspark.model import Dataset, Var, idx
from gridspark.sources.binary import _TYPES, _Cursor
from gridspark.sources.records import SLAB, File, Wanted, _files


@dataclass(frozen=True)
class Field:
    """Where a variable lies: row i of its first dimension begins at ``begin + i * stride``."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    attrs: dict
    kind: str
    begin: int
    stride: int

    @property
    def row(self) -> int:
        """Bytes of a row."""
        return math.prod(self.shape[1:]) * np.dtype(self.kind).itemsize


@dataclass(frozen=True)
class Header:
    dims: dict[str, int]
    fields: dict[str, Field]
    attrs: dict


def parse(raw: bytes) -> Header:
    """The header of a classic or 64-bit-offset file; struct.error or ValueError if it goes on behind ``raw``."""
    c = _Cursor(raw)
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise NotImplementedError("not a classic netCDF file")
    c.take(4)
    records = c.i4()
    tag, n = c.i4(), c.i4()
    dims = [(c.name(), c.i4()) for _ in range(n if tag else 0)]
    attrs = c.attrs()
    tag, n = c.i4(), c.i4()
    found = []
    for _ in range(n if tag else 0):
        name, ids, own = c.name(), [c.i4() for _ in range(c.i4())], c.attrs()
        kind, size = c.i4(), c.i4()
        found.append((name, ids, own, _TYPES[kind], size, c.i8() if raw[3] == 2 else c.i4()))
    if c.at > len(raw):
        raise ValueError("the header goes on")
    moving = [f for f in found if f[1] and dims[f[1][0]][1] == 0]
    width = sum(f[4] for f in moving)
    fields = {}
    for name, ids, own, kind, _, begin in found:
        shape = tuple(dims[d][1] or records for d in ids)
        row = math.prod(shape[1:]) * np.dtype(kind).itemsize
        by_record = bool(ids) and dims[ids[0]][1] == 0
        # one variable with records has no gaps between them, several are padded to four bytes
        fields[name] = Field(name, tuple(dims[d][0] for d in ids), shape, own, kind, begin, (row if len(moving) == 1 else width) if by_record else row)
    return Header({d: m or records for d, m in dims}, fields, attrs)


def encode_header(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], str, dict]], attrs: dict, records: int) -> bytes:
    """The header of a 64-bit-offset file of ``records`` records; a dimension of length 0 is that of the records, the first of every variable.

    ``variables``: dimensions, big-endian type and attributes by name.  Their parts of a record follow each other in this order.
    """
    i4 = lambda *x: struct.pack(f">{len(x)}i", *x)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda t: i4(len(t.encode())) + pad(t.encode())

    def value(v: object) -> bytes:
        if isinstance(v, str):
            return i4(2, len(v.encode())) + pad(v.encode())
        a = np.atleast_1d(np.asarray(v))
        whole = a.dtype.kind in "iub"
        return i4(4 if whole else 6, len(a)) + a.astype(">i4" if whole else ">f8").tobytes()

    listed = lambda d: i4(12, len(d)) + b"".join(name(k) + value(v) for k, v in d.items()) if d else i4(0, 0)
    ids = {d: k for k, d in enumerate(dims)}
    code = {v: k for k, v in _TYPES.items()}
    head = b"CDF\2" + i4(records) + i4(10, len(dims)) + b"".join(name(d) + i4(n) for d, n in dims.items()) + listed(attrs) + i4(11, len(variables))
    entries, sizes = [], []
    for v, (own, kind, about) in variables.items():
        sizes.append(math.prod(dims[d] for d in own[1:]) * np.dtype(kind).itemsize)
        entries.append(name(v) + i4(len(own), *[ids[d] for d in own]) + listed(about) + i4(code[kind], sizes[-1]))
    at = len(head) + sum(len(e) + 8 for e in entries)
    for e, size in zip(entries, sizes, strict=True):
        head += e + struct.pack(">q", at)
        at += size
    return head


def header(f: File, first: int = 1 << 16) -> Header:
    n = min(first, f.size)
    while True:
        try:
            return parse(f.read(0, n))
        except (struct.error, ValueError, IndexError):
            if n >= f.size:
                raise
            n = min(4 * n, f.size)


@dataclass
class Rows(InputPartition):
    path: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, field: Field):
        self.options, self.field = options, field
        self.wanted = Wanted(indexes=tuple(idx(d) for d in field.dims))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Rows]:
        slab, out = int(self.options.get("slab", SLAB)), []
        for path, _ in _files(self.options["path"]):
            field = header(File(path)).fields[self.field.name]
            n = field.shape[0] if field.dims else 1
            step = max(1, slab // max(field.row, 1))
            keep = self.wanted.range(idx(field.dims[0]), n) if field.dims else range(1)
            out += [Rows(path, a, min(a + step, keep.stop)) for a in range(keep.start, keep.stop, step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        f = File(partition.path)
        field = header(f).fields[self.field.name]
        kind, t = np.dtype(field.kind), field.attrs
        missing = [t[k] for k in ("_FillValue", "missing_value") if k in t]
        rest = [self.wanted.range(idx(d), n) for d, n in zip(field.dims[1:], field.shape[1:], strict=True)]
        # rows of a batch: about a megabyte
        at, some = partition.begin, max(1, (1 << 20) // max(field.row, 1))
        while at < partition.end:
            n = min(some, partition.end - at)
            if field.stride == field.row:
                x = np.frombuffer(f.read(field.begin + at * field.stride, n * field.row), kind)
            else:
                x = np.concatenate([np.frombuffer(f.read(field.begin + i * field.stride, field.row), kind) for i in range(at, at + n)])
            x = x.reshape(n, *field.shape[1:])
            for axis, r in enumerate(rest, 1):
                x = np.take(x, r, axis=axis)
            grid = np.meshgrid(range(at, at + n), *rest, indexing="ij") if field.dims else []
            gone = np.isin(x, np.array(missing).astype(kind)) if missing and kind.kind != "S" else np.zeros(x.shape, dtype=bool)
            values = pa.array([v.decode("latin-1") for v in x.ravel()], pa.string()) if kind.kind == "S" else pa.array(x.ravel().astype("f8"), pa.float64(), mask=gone.ravel())
            places = [pa.array(np.asarray(g).ravel(), pa.int32()) for g in grid]
            file = pa.array([partition.path] * x.size, pa.string())
            yield pa.RecordBatch.from_arrays([file, *places, values], names=["file", *[idx(d) for d in field.dims], field.name])
            at += n


class GridNetcdf(DataSource):
    """Options: ``path`` (a file, or a folder of files alike), ``variable``, ``slab``."""

    @classmethod
    def name(cls) -> str:
        return "gridnetcdf"

    def _field(self) -> Field:
        path = next(iter(_files(self.options["path"])))[0]
        return header(File(path)).fields[self.options["variable"]]

    def schema(self) -> str:
        f = self._field()
        return ", ".join(["file string", *(f"`{idx(d)}` int" for d in f.dims), f"`{f.name}` {'string' if f.kind == 'S1' else 'double'}"])

    def reader(self, schema: object) -> _Reader:
        return _Reader(dict(self.options), self._field())


def read_variable(spark: SparkSession, path: str, name: str, **options: object) -> DataFrame:
    """A variable's cells: file, an index column for each dimension, and the value; fill values are masked."""
    from gridspark.session import ship

    ship(spark).dataSource.register(GridNetcdf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("gridnetcdf").options(variable=name, **{k: str(v) for k, v in options.items()}).load(path)


def open_netcdf(spark: SparkSession, path: str, names: list[str] | None = None, **options: object) -> Dataset:
    """A file as a dataset, or a folder of files alike whose records follow each other in the order of the files' names.

    Only headers are read until a variable is used.  Variables of the same dimensions are joined on them.
    """
    heads = [(p, header(File(p))) for p, _ in _files(path)]
    h = heads[0][1]
    growing = next((d for d in h.dims if any(x.dims[d] != h.dims[d] for _, x in heads)), None) or next((f.dims[0] for f in h.fields.values() if f.dims and f.stride != f.row), next(iter(h.dims), None))
    starts, at = [], 0
    for p, x in heads:
        starts.append((p, at))
        at += x.dims.get(growing, 0)
    frames, vars_ = {}, {}
    for f in h.fields.values():
        if names is not None and f.name not in names:
            continue
        df = read_variable(spark, path, f.name, **options)
        if len(heads) > 1 and growing in f.dims:
            first = spark.createDataFrame(starts, "file string, first__ int")
            df = df.join(F.broadcast(first) if len(starts) <= 100_000 else first, "file").withColumn(idx(growing), F.col(idx(growing)) + F.col("first__")).drop("first__")
        elif len(heads) > 1:
            df = df.filter(F.col("file") == heads[0][0])
        df = df.drop("file")
        frames[f.dims] = (frames[f.dims].join(df, [idx(d) for d in f.dims]) if f.dims else frames[f.dims].crossJoin(df)) if f.dims in frames else df
        vars_[f.name] = Var(f.dims, {k: v for k, v in f.attrs.items() if k not in ("_FillValue", "missing_value")})
    used = {d for v in vars_.values() for d in v.dims}
    coords = frozenset(v for v, x in vars_.items() if x.dims == (v,))
    return Dataset({d: at if d == growing and len(heads) > 1 else n for d, n in h.dims.items() if d in used}, vars_, frames, h.attrs, coords)
