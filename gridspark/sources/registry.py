"""Formats by name; ``open_dataset`` finds one from a path, or from what a file holds, where none is named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from gridspark import conventions
from gridspark.model import Dataset
from gridspark.operators.combine import stack
from gridspark.sources import native, netcdf, records, text

READERS: dict[str, Callable[..., Dataset]] = {}
WRITERS: dict[str, Callable[..., object]] = {}
_EXTENSIONS = {".csv": "csv", ".ict": "ffi1001", ".ffi1001": "ffi1001"}


def register_reader(name: str, read: Callable[..., Dataset]) -> None:
    READERS[name] = read


def register_writer(name: str, write: Callable[..., object]) -> None:
    WRITERS[name] = write


def open_dataset(spark: SparkSession, path: str, format: str | None = None, **options: object) -> Dataset:
    if format is None:
        format = next((f for e, f in _EXTENSIONS.items() if path.lower().endswith(e)), None) or look(path)
    if format not in READERS:
        raise ValueError(f"no such format: {format}; there are {sorted(READERS)}")
    return READERS[format](spark, path, **options)


def look(path: str) -> str:
    """The format that a file's bytes speak for; a folder is of the engine's own."""
    address = path if "://" in path else f"file://{path}"
    try:
        found = records.detect(records.File(address))
    except (OSError, ValueError):
        return "native"
    if found is None or found in ("parquet", "text"):
        return "native"
    if found not in READERS:
        raise ValueError(f"{path} looks like {found}, which has no reader of its own; name one of {sorted(READERS)}")
    return found


def open_mixed(spark: SparkSession, folder: str, **options: object) -> dict[str, list[Dataset]]:
    """The datasets of a folder of files of any formats, by format; tasks find the formats.  Files of no known one are left out."""
    out: dict[str, list[Dataset]] = {}
    for r in records.detect_all(spark, folder).orderBy("path").collect():
        if r["format"] in READERS:
            out.setdefault(r["format"], []).append(open_dataset(spark, r["path"], r["format"], **options.get(r["format"], {})))
    return out


def open_many(spark: SparkSession, paths: list[str], dim: str, format: str | None = None, **options: object) -> Dataset:
    """Files of one format, stacked along a dimension."""
    return stack([open_dataset(spark, p, format, **options) for p in paths], dim)


def save(ds: Dataset, path: str, format: str = "native", **options: object) -> None:
    if format not in WRITERS:
        raise ValueError(f"no such format: {format}; there are {sorted(WRITERS)}")
    WRITERS[format](ds, path, **options)


register_reader("native", native.load)
register_reader("csv", text.read_grid_csv)
register_reader("ffi1001", text.read_icartt)
register_reader("icon_profile", text.read_icon_profile)
register_reader("bcon_profile", lambda spark, path: text.read_icon_profile(spark, path, 4))
register_reader("netcdf", netcdf.open_netcdf)
register_reader("ioapi", lambda spark, path, **options: conventions.read_ioapi(spark, path, **options).ds)
for _kind in records.FORMATS:
    register_reader(_kind, lambda spark, path, kind=_kind, **options: records.open_records(spark, path, kind, **options))
register_writer("native", native.save)
register_writer("csv", text.write_grid_csv)
register_writer("ioapi", lambda ds, path, **options: conventions.write_ioapi(conventions.Ioapi.of(ds), path, **options))
register_writer("ffi1001", text.write_icartt)
