"""A partitioned data source for files of sequential big-endian records.

``spark.read.format("gridrecords")`` plans tasks from file sizes alone: a partition is
a file and a range of bytes, and holds the time steps that begin in it, so one large
file is many tasks and planning opens no file.  A task reads the header, then
computes where each horizontal plane lies; what a format is, is a ``Layout`` of
planes within a step.  Filters on variable, step, layer, row and column choose
planes and rows of planes before a byte of them is read, and neighbouring ranges
are read at once.

Files are opened where tasks run, on any store that pyarrow knows by its address.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridspark.sources.binary import _spaced, _text, record

#: Bytes of a file for a task, and how far apart two ranges may lie that are read at once.
SLAB = 64 << 20
GAP = 64 << 10
SCHEMA = "file string, step int, date int, hour float, name string, LAY__i int, ROW__i int, COL__i int, value float"
_INDEX = ("LAY__i", "ROW__i", "COL__i")


class File:
    """A file that is read by ranges; it counts what it reads."""

    def __init__(self, path: str):
        self.fs, at = fs.FileSystem.from_uri(path)
        self.handle = self.fs.open_input_file(at)
        self.size, self.n_read = self.handle.size(), 0

    def read(self, at: int, n: int) -> bytes:
        got = self.handle.read_at(n, at)
        if len(got) != n:
            raise ValueError(f"the file ends at byte {at + len(got)}, not behind {at + n}")
        self.n_read += n
        return got

    def length(self, at: int) -> int:
        """The length of the record at a place."""
        return struct.unpack(">i", self.read(at, 4))[0]


@dataclass(frozen=True)
class Plane:
    """Numbers of one variable in a row, ``at`` bytes behind the start of a step; ``dims`` in the order in which they are stored."""

    name: str
    at: int
    dims: tuple[tuple[str, int], ...]
    lay: int | None = None

    @property
    def size(self) -> int:
        return 4 * math.prod(n for _, n in self.dims)


@dataclass(frozen=True)
class Layout:
    """``first`` byte of the first step, bytes of a ``step``, its planes, and how its time is written."""

    first: int
    step: int
    planes: list[Plane]
    stamp_at: int = 4
    stamp: str = ">if"  # date and hour, or ">fi": hour and date; empty: no time
    steps: int | None = None  # where the size doesn't tell


def _fields(names: Sequence[str], nz: int, ny: int, nx: int, at: int, skip: int, by_layer: bool) -> list[Plane]:
    """Records of one plane each, the first at ``at``, with ``skip`` bytes before the numbers; variables within layers or layers within variables."""
    size = skip + 4 * ny * nx + 4
    pairs = [(v, k) for k in range(nz) for v in names] if by_layer else [(v, k) for v in names for k in range(nz)]
    return [Plane(v, at + i * size + skip, (("ROW", ny), ("COL", nx)), k) for i, (v, k) in enumerate(pairs)]


def _heads(f: File) -> tuple[list[str], int, int, int, int]:
    """Species, nx, ny, nz and the byte behind the four header records of average and boundary files."""
    n_spec = struct.unpack(">i", f.read(4 + 284, 4))[0]
    at = f.length(0) + 8
    nx, ny, nz = struct.unpack(">iii", f.read(at + 4 + 28, 12))
    for _ in range(2):
        at += f.length(at) + 8
    raw = f.read(at + 4, 40 * n_spec)
    return [_text(raw[40 * k : 40 * k + 40]) for k in range(n_spec)], nx, ny, max(nz, 1), at + len(raw) + 8


def average(f: File, **_: object) -> Layout:
    """Average and emission files: a step is its times and a record for each species and layer."""
    species, nx, ny, nz, first = _heads(f)
    planes = _fields(species, nz, ny, nx, 24, 4 + 44, False)
    return Layout(first, 24 + len(planes) * (48 + 4 * ny * nx + 4), planes)


def lateral_boundary(f: File, **_: object) -> Layout:
    """Boundary files: for each species a record for each side, cells by layers."""
    species, nx, ny, nz, first = _heads(f)
    for _side in range(4):
        first += f.length(first) + 8
    at, planes = 24, []
    for s in species:
        for side, d, n in (("WEST", "ROW", ny), ("EAST", "ROW", ny), ("SOUTH", "COL", nx), ("NORTH", "COL", nx)):
            planes.append(Plane(f"{side}_{s}", at + 4 + 48, ((d, n), ("LAY", nz))))
            at += 4 + 48 + 4 * n * nz + 4
    return Layout(first, at, planes)


def _same_time(f: File, size: int) -> int:
    """How many records of ``size`` bytes from the start on have one time."""
    now, k = f.read(4, 8), 1
    while k * size < f.size and f.read(k * size + 4, 8) == now:
        k += 1
    return k


def _timed(f: File, ny: int, nx: int, names: Sequence[str], surface: str | None = None) -> Layout:
    """Meteorology whose every record has its time: perhaps a surface plane, then variables by layers."""
    size = 16 + 4 * ny * nx
    k = _same_time(f, size)
    n = (k - (surface is not None)) // len(names)
    planes = [Plane(surface, 12, (("ROW", ny), ("COL", nx)), 0)] if surface else []
    planes += _fields(names, n, ny, nx, size if surface else 0, 12, True)
    return Layout(0, k * size, planes, 4, ">fi")


def temperature(f: File, rows: int, cols: int, **_: object) -> Layout:
    return _timed(f, rows, cols, ["AIRTEMP"], "SURFTEMP")


def height_pressure(f: File, rows: int, cols: int, **_: object) -> Layout:
    return _timed(f, rows, cols, ["HGHT", "PRES"])


def one3d(f: File, rows: int, cols: int, name: str = "UNKNOWN", **_: object) -> Layout:
    return _timed(f, rows, cols, [name])


def layers(f: File, rows: int, cols: int, names: str = "UNKNOWN", surface: str | None = None, **_: object) -> Layout:
    """Any meteorology whose records have their time: ``names`` alternate in each layer, ``surface`` is a plane before them."""
    return _timed(f, rows, cols, names.split(","), surface)


def wind(f: File, rows: int, cols: int, **_: object) -> Layout:
    """A step is its time, two planes a layer, and a short record."""
    head = f.length(0) + 8
    size, at, n = 8 + 4 * rows * cols, head, 0
    while f.length(at) == size - 8:
        at, n = at + size, n + 1
    return Layout(0, at + f.length(at) + 8, _fields(["U", "V"], n // 2, rows, cols, head, 4, True), 4, ">fi")


def cloud_rain(f: File, **_: object) -> Layout:
    """A header, then steps of three (older) or five variables a layer; the file's size tells which."""
    n = f.length(0)
    nx, ny, nz = struct.unpack(">iii", f.read(4 + n - 12, 12))
    size = 8 + 4 * ny * nx
    for names in (("CLOUD", "RAIN", "SNOW", "GRAUPEL", "COD"), ("CLOUD", "PRECIP", "COD")):
        step = 16 + nz * len(names) * size
        if (f.size - n - 8) % step == 0:
            return Layout(n + 8, step, _fields(names, nz, ny, nx, 16, 4, True), 4, ">fi")
    raise ValueError("neither three nor five variables a layer fit the file's size")


def landuse(f: File, rows: int, cols: int, **_: object) -> Layout:
    """Shares of land use classes and up to two planes besides; newer files name each record."""
    first = f.read(0, 12)
    named = first[4:].startswith(b"LUCAT")
    at, planes, k = 0, [], 0
    while at < f.size:
        name = ("FLAND", "TOPO", "VAR2")[k]
        if named:
            key = f.read(at + 4, f.length(at)).decode("latin-1").strip()
            name, at = ("FLAND" if k == 0 else key), at + f.length(at) + 8
        n = f.length(at) // (4 * rows * cols)
        planes += [Plane(name, at + 4 + 4 * rows * cols * i, (("ROW", rows), ("COL", cols)), i) for i in range(n)]
        at += 8 + 4 * rows * cols * n
        k += 1
    return Layout(0, f.size, planes, stamp="", steps=1)


FORMATS: dict[str, Callable[..., Layout]] = {
    "average": average, "lateral_boundary": lateral_boundary, "wind": wind, "temperature": temperature, "height_pressure": height_pressure,
    "one3d": one3d, "humidity": lambda f, **o: one3d(f, **{**o, "name": "HUM"}), "vertical_diffusivity": lambda f, **o: one3d(f, **{**o, "name": "KV"}), "cloud_rain": cloud_rain, "landuse": landuse, "layers": layers,
}


@dataclass
class Wanted:
    """What filters leave: names, and the least and greatest value of each index."""

    names: set[str] | None = None
    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    indexes: tuple[str, ...] = ("step", *_INDEX)

    def take(self, f: Filter) -> bool:
        """Whether the filter is met by what will be read, so that Spark needn't test it again."""
        column = f.attribute[0] if len(f.attribute) == 1 else None
        if column == "name" and "step" in self.indexes and isinstance(f, (EqualTo, In)):
            given = set(f.value) if isinstance(f, In) else {f.value}
            self.names = given if self.names is None else self.names & given
            return True
        if column not in self.indexes or not isinstance(f.value if hasattr(f, "value") else None, int):
            return False
        lows = {EqualTo: 0, GreaterThanOrEqual: 0, GreaterThan: 1}
        highs = {EqualTo: 0, LessThanOrEqual: 0, LessThan: -1}
        if type(f) in lows:
            self.low[column] = max(self.low.get(column, f.value), f.value + lows[type(f)])
        if type(f) in highs:
            self.high[column] = min(self.high.get(column, f.value), f.value + highs[type(f)])
        return type(f) in lows or type(f) in highs

    def range(self, column: str, n: int) -> range:
        return range(max(0, self.low.get(column, 0)), min(n - 1, self.high.get(column, n - 1)) + 1)


def cut(plane: Plane, wanted: Wanted) -> tuple[int, int, list[range]] | None:
    """(bytes behind the step's start, bytes, ranges by dimension) of what is wanted of a plane; columns are cut after reading."""
    if wanted.names is not None and plane.name not in wanted.names:
        return None
    if plane.lay is not None and plane.lay not in wanted.range("LAY__i", plane.lay + 1):
        return None
    held = {d for d, _ in plane.dims} | ({"LAY"} if plane.lay is not None else set())
    if any(c in wanted.low or c in wanted.high for c in _INDEX if c[:-3] not in held):
        return None  # an index that the plane lacks is null there
    ranges = [wanted.range(f"{d}__i", n) for d, n in plane.dims]
    if not all(len(r) for r in ranges):
        return None
    inner = 4 * math.prod(n for _, n in plane.dims[1:])
    return plane.at + ranges[0].start * inner, len(ranges[0]) * inner, ranges


def together(ranges: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """Ranges of bytes, in order, with those less than ``gap`` apart made one."""
    out: list[tuple[int, int]] = []
    for at, n in ranges:
        if out and at - (out[-1][0] + out[-1][1]) <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], at + n - out[-1][0]))
        else:
            out.append((at, n))
    return out


def slabs(f: File, layout: Layout, begin: int, end: int, wanted: Wanted) -> Iterator[tuple[int, int, float, Plane, list[range], np.ndarray]]:
    """(step, date, hour, plane, ranges, numbers) of the steps that begin in a range of bytes."""
    n = layout.steps if layout.steps is not None else (f.size - layout.first) // layout.step
    # the first task also has what begins before the first step's byte
    mine = range(max(0, -(-(begin - layout.first) // layout.step)), min(n, -(-(end - layout.first) // layout.step)))
    chosen = sorted(((p, *c) for p in layout.planes if (c := cut(p, wanted)) is not None), key=lambda x: x[1])
    for t in range(max(mine.start, wanted.range("step", n).start), min(mine.stop, wanted.range("step", n).stop)):
        if not chosen:
            return
        at = layout.first + t * layout.step
        pair = struct.unpack(layout.stamp, f.read(at + layout.stamp_at, 8)) if layout.stamp else (None, None)
        date, hour = (pair[1], pair[0]) if layout.stamp == ">fi" else pair
        k = 0
        for begins, size in together([(a, m) for _, a, m, _ in chosen]):
            raw = f.read(at + begins, size)
            while k < len(chosen) and chosen[k][1] < begins + size:
                plane, a, m, ranges = chosen[k]
                x = np.frombuffer(raw, ">f4", m // 4, a - begins).reshape(len(ranges[0]), *(d for _, d in plane.dims[1:]))
                for axis, r in enumerate(ranges[1:], 1):
                    x = np.take(x, r, axis=axis)
                yield t, date, hour, plane, ranges, x
                k += 1


def _batch(path: str, t: int, date: int | None, hour: float | None, plane: Plane, ranges: list[range], x: np.ndarray) -> pa.RecordBatch:
    n = x.size
    same = lambda v, kind: pa.array([v], kind).take(pa.array(np.zeros(n, dtype=np.int32))) if v is not None else pa.nulls(n, kind)
    grid = np.meshgrid(*ranges, indexing="ij")
    index = {d: pa.array(g.ravel(), pa.int32()) for (d, _), g in zip(plane.dims, grid, strict=True)}
    place = [index.get(d, same(plane.lay if d == "LAY" else None, pa.int32())) for d in ("LAY", "ROW", "COL")]
    columns = [same(path, pa.string()), same(t, pa.int32()), same(date, pa.int32()), same(hour, pa.float32()), same(plane.name, pa.string()), *place, pa.array(x.ravel().astype("<f4"), pa.float32())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Slab(InputPartition):
    path: str
    begin: int
    end: int


def _files(path: str) -> list[tuple[str, int]]:
    """(address, size) of the file, or of the files of a folder; hidden ones and those that a writer has not finished are left out."""
    store, at = fs.FileSystem.from_uri(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else "file://"
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    return sorted((scheme + i.path, i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted = options, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Slab]:
        slab = int(self.options.get("slab", SLAB))
        return [Slab(p, a, min(a + slab, size)) for p, size in _files(self.options["path"]) for a in range(0, size, slab)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        f = File(partition.path)
        for slab in slabs(f, _layout(f, self.options), partition.begin, partition.end, self.wanted):
            yield _batch(partition.path, *slab)


def _layout(f: File, options: dict) -> Layout:
    kind = options.get("records", "average")
    if kind not in FORMATS:
        raise ValueError(f"no such records: {kind}; there are {sorted(FORMATS)}")
    numbers = {k: int(options[k]) for k in ("rows", "cols") if k in options}
    return FORMATS[kind](f, **numbers, **{k: options[k] for k in ("name", "names", "surface") if k in options})


# ---------------------------------------------------------------- writing


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Each task writes whole files under hidden names; the commit only renames them, so a task that ran twice does no harm."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.about, self.overwrite = options["path"], json.loads(options["about"]), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, at = fs.FileSystem.from_uri(self.path)
        store.create_dir(at, recursive=True)
        a = self.about
        shape = (len(a["species"]), a["nz"], a["ny"], a["nx"])
        whole, attempt = math.prod(shape), TaskContext.get().taskAttemptId()
        done, out, now, held, n = [], None, None, [], 0
        head, step = (_ioapi_header, _ioapi_step) if a.get("format") == "ioapi" else (_header, _step)
        for b in iterator:
            if not b.num_rows:
                continue
            number, date, hour, values = (b.column(b.schema.get_field_index(c)) for c in ("number", "date", "hour", "value"))
            i = 0
            while i < b.num_rows:
                take = min(whole - n, b.num_rows - i)
                if not n:
                    begins = (number[i].as_py(), date[i].as_py(), hour[i].as_py())
                held.append(values.slice(i, take).to_numpy(zero_copy_only=False))
                n, i = n + take, i + take
                if n == whole:
                    if begins[0] != now:
                        if out is not None:
                            out.close()
                        now = begins[0]
                        hidden, final = f"{at}/.{now:06d}-{attempt}", f"{at}/{a['prefix']}{now:06d}"
                        done.append((hidden, final))
                        out = store.open_output_stream(hidden)
                        out.write(head(a, begins[1], begins[2], min(a["steps"], a["total"] - now * a["steps"])))
                    out.write(step(a, begins[1], begins[2], np.concatenate(held).reshape(shape)))
                    held, n = [], 0
        if n:
            raise ValueError("a step lacks cells; write dense data")
        if out is not None:
            out.close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if i.type == fs.FileType.File and not i.base_name.startswith("."):
                    store.delete_file(i.path)
        for m in messages:
            for hidden, final in m.files if m else []:
                store.move(hidden, final)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for hidden, _final in m.files if m else []:
                store.delete_file(hidden)


def _end(date: int, hour: float, hours: float) -> tuple[int, float]:
    from datetime import datetime, timedelta

    at = datetime.strptime(f"{date:07d}", "%Y%j") + timedelta(hours=hour + hours)
    return int(at.strftime("%Y%j")), at.hour + at.minute / 60


def _header(a: dict, date: int, hour: float, steps: int) -> bytes:
    ends = _end(date, hour + a["hours"] * (steps - 1), a["hours"])
    first = _spaced(a["kind"], 10) + _spaced(a["note"], 60) + struct.pack(">iiifif", 0, len(a["species"]), date, hour, *ends)
    grid = struct.pack(">ffiffffiiiiifff", 0, 0, 0, *a["origin"], a["nx"], a["ny"], a["nz"], 0, 0, 0, 0, 0)
    return b"".join(record(r) for r in (first, grid, struct.pack(">iiii", 1, 1, a["nx"], a["ny"]), b"".join(_spaced(s, 10) for s in a["species"])))


def _step(a: dict, date: int, hour: float, x: np.ndarray) -> bytes:
    out = [record(struct.pack(">ifif", date, hour, *_end(date, hour, a["hours"])))]
    for s, name in enumerate(a["species"]):
        out += [record(struct.pack(">i", 1) + _spaced(name, 10) + x[s, k].astype(">f4").tobytes()) for k in range(a["nz"])]
    return b"".join(out)


def _hms(hour: float) -> int:
    s = round(hour * 3600)
    return s // 3600 * 10000 + s // 60 % 60 * 100 + s % 60


def _ioapi_header(a: dict, date: int, hour: float, steps: int) -> bytes:
    from gridspark.sources.netcdf import encode_header

    n = len(a["species"])
    dims = {"TSTEP": 0, "DATE-TIME": 2, "LAY": a["nz"], "VAR": n, "ROW": a["ny"], "COL": a["nx"]}
    flag = {"units": "<YYYYDDD,HHMMSS>", "long_name": "TFLAG".ljust(16), "var_desc": "Timestep-valid flags:  (1) YYYYDDD or (2) HHMMSS".ljust(80)}
    variables = {"TFLAG": (("TSTEP", "VAR", "DATE-TIME"), ">i4", flag)} | {s: (("TSTEP", "LAY", "ROW", "COL"), ">f4", a["about"].get(s, {})) for s in a["species"]}
    return encode_header(dims, variables, a["attrs"] | {"SDATE": date, "STIME": _hms(hour)}, steps)


def _ioapi_step(a: dict, date: int, hour: float, x: np.ndarray) -> bytes:
    return struct.pack(">ii", date, _hms(hour)) * len(a["species"]) + x.astype(">f4").tobytes()


class GridRecords(DataSource):
    """Options: ``path``, ``records`` (a name in FORMATS), ``rows`` and ``cols`` where a format doesn't tell them, ``name``, ``slab``."""

    @classmethod
    def name(cls) -> str:
        return "gridrecords"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    from gridspark.session import ship

    ship(spark).dataSource.register(GridRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_records(spark: SparkSession, path: str, records: str = "average", **options: object) -> DataFrame:
    """Rows of all files of a folder, or of one file (SCHEMA); filters on it reach the files."""
    register(spark)
    return spark.read.format("gridrecords").options(records=records, **{k: str(v) for k, v in options.items()}).load(path)


def write_average(df: DataFrame, path: str, species: list[str], nz: int, ny: int, nx: int, steps: int = 24, hours: float = 1.0, origin: Sequence[float] = (0.0, 0.0, 1.0, 1.0), kind: str = "AVERAGE", note: str = "", prefix: str = "average.", mode: str = "append") -> None:
    """Average files of ``steps`` time steps each, from dense rows (step, date, hour, name, LAY__i, ROW__i, COL__i, value).

    Rows are dealt and sorted by file, so a task holds one step at a time.  Steps count from 0.
    """
    about = {"nz": nz, "ny": ny, "nx": nx, "steps": steps, "hours": hours, "origin": list(origin), "kind": kind, "note": note}
    _write(df, path, about, species, prefix, mode)


def _write(df: DataFrame, path: str, about: dict, species: list[str], prefix: str, mode: str) -> None:
    register(df.sparkSession)
    about = {**about, "species": species, "prefix": prefix, "total": (df.agg(F.max("step")).first()[0] or 0) + 1}
    place = F.array_position(F.array(*[F.lit(s) for s in species]), F.col("name"))
    rows = df.withColumn("number", F.floor(F.col("step") / about["steps"]).cast("int")).withColumn("place", place).filter("place > 0")
    order = ["number", "step", "place", "LAY__i", "ROW__i", "COL__i"]
    sent = rows.repartition("number").sortWithinPartitions(*order).select("number", F.col("date").cast("int"), F.col("hour").cast("float"), F.col("value").cast("float"))
    sent.write.format("gridrecords").options(path=path, about=json.dumps(about)).mode(mode).save()


# ---------------------------------------------------------------- which format a file has

#: What the first record of a gridded file calls itself.
KINDS = {"AVERAGE": "average", "EMISSIONS": "average", "AIRQUALITY": "average", "INSTANT": "average", "BOUNDARY": "lateral_boundary"}


def _plausible(date: int) -> bool:
    return 1 <= date % 1000 <= 366 and (date // 1000 < 100 or 1900 <= date // 1000 < 2200)


def detect(f: File) -> str | None:
    """The format that a file's first bytes and record lengths speak for; None if none.

    Meteorology whose records all look alike can't tell its variables: ``timed``.
    """
    head = f.read(0, min(f.size, 512))
    if head[:3] == b"CDF" and head[3:4] in (b"\1", b"\2"):
        return "netcdf"
    if head[1:4] == b"HDF":
        return "hdf5"
    if head[:4] == b"PAR1":
        return "parquet"
    text = head.split(b"\n")[0]
    if text and all(32 <= c < 127 or c in (9, 13) for c in text):
        words = [w.strip() for w in text.decode().split(",")]
        if len(words) == 2 and words[0].isdigit() and words[1] == "1001":
            return "ffi1001"
        return "csv" if len(words) > 1 else "text"
    if f.size < 12:
        return None
    n = f.length(0)
    if not 0 < n <= f.size - 8 or f.length(4 + n) != n:
        return None
    if n == 304 and (kind := KINDS.get(_text(head[4:44]).upper())):
        return kind
    if n == 8 and head[4:9] == b"LUCAT":
        return "landuse"
    if n in (8, 12) and _plausible(struct.unpack(">i", head[8:12])[0]):
        return "wind"
    behind = 8 + n
    if n >= 12 and behind + 16 <= f.size and f.length(behind) == 8 and min(struct.unpack(">iii", f.read(4 + n - 12, 12))) > 0:
        return "cloud_rain"
    if n > 12 and n % 4 == 0 and f.size % (n + 8) == 0 and _plausible(struct.unpack(">i", head[8:12])[0]):
        return "timed"
    return None


def detect_all(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, format) of the files of a folder; tasks look into them."""
    from gridspark.session import ship

    files = ship(spark).createDataFrame(_files(path), "path string, size long")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([detect(File(p)) for p in b.column(0).to_pylist()], pa.string())], names=["path", "size", "format"])

    return files.repartition("path").mapInArrow(look, "path string, size long, format string")


def open_records(spark: SparkSession, path: str, records: str = "average", **options: object):
    """Files of records as a dataset: a column a variable, the files' steps one after another in the order of their names.

    Headers alone are read for it; a variable's dimensions are TSTEP, LAY, ROW, COL, or those of them that it has.
    """
    from gridspark.model import Dataset, Var

    starts, at, names, dims = [], 0, {}, {}
    for p, _ in _files(path):
        f = File(p)
        layout = _layout(f, {"records": records, **options})
        starts.append((p, at))
        at += layout.steps if layout.steps is not None else (f.size - layout.first) // layout.step
        for plane in layout.planes:
            own = dict(plane.dims) | ({"LAY": plane.lay + 1} if plane.lay is not None else {})
            for d, n in own.items():
                dims[d] = max(dims.get(d, 0), n)
            names[plane.name] = tuple(d for d in ("LAY", "ROW", "COL") if d in own)
    df = read_records(spark, path, records, **options).join(F.broadcast(spark.createDataFrame(starts, "file string, first__ int")), "file")
    df = df.withColumn("TSTEP__i", F.col("step") + F.col("first__"))
    frames, vars_ = {}, {}
    for key in dict.fromkeys(names.values()):
        own = [v for v, k in names.items() if k == key]
        cols = [f"{d}__i" for d in ("TSTEP", *key)]
        frames[("TSTEP", *key)] = df.filter(F.col("name").isin(own)).groupBy(*cols).agg(*[F.max(F.when(F.col("name") == v, F.col("value"))).alias(v) for v in own])
        vars_ |= {v: Var(("TSTEP", *key)) for v in own}
    return Dataset({"TSTEP": at, **{d: dims[d] for d in ("LAY", "ROW", "COL") if d in dims}}, vars_, frames)
