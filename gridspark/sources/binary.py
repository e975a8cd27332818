"""Binary formats: records of gridded models and classic netCDF.

What is here encodes, and decodes what fits a task; ``records`` and ``netcdf`` read
files by slabs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(raw: bytes) -> Iterator[bytes]:
    """The payloads of big-endian sequential records (a length before and behind each)."""
    at = 0
    while at < len(raw):
        (n,) = struct.unpack_from(">i", raw, at)
        if struct.unpack_from(">i", raw, at + 4 + n)[0] != n:
            raise ValueError(f"damaged record at byte {at}")
        yield raw[at + 4 : at + 4 + n]
        at += n + 8


def record(payload: bytes) -> bytes:
    n = struct.pack(">i", len(payload))
    return n + payload + n


def _text(raw: bytes) -> str:
    """Characters that stand four bytes apart."""
    return raw[::4].decode("latin-1").strip()


def _spaced(text: str, n: int) -> bytes:
    return b"".join(c.encode("latin-1") + b"   " for c in text.ljust(n)[:n])


@dataclass
class Average:
    """A gridded average or emission file: header, species and values (time, species, layer, row, column)."""

    name: str
    note: str
    origin: tuple[float, float, float, float]  # x, y, dx, dy
    species: list[str]
    times: list[tuple[int, float, int, float]]  # begin date and hour, end date and hour
    values: np.ndarray


def decode_average(raw: bytes) -> Average:
    it = records(raw)
    h = next(it)
    name, note = _text(h[:40]), _text(h[40:280])
    n_spec = struct.unpack(">i", h[284:288])[0]
    g = struct.unpack(">ffiffffiiiiifff", next(it))
    nx, ny, nz = g[7], g[8], g[9]
    next(it)
    spc = next(it)
    species = [_text(spc[40 * k : 40 * k + 40]) for k in range(n_spec)]
    times, blocks = [], []
    for t in it:
        times.append(struct.unpack(">ifif", t))
        blocks.append(np.stack([np.stack([np.frombuffer(next(it)[44:], dtype=">f4").reshape(ny, nx) for _ in range(max(nz, 1))]) for _ in range(n_spec)]))
    values = np.array(blocks, dtype=np.float32).reshape(len(times), n_spec, max(nz, 1), ny, nx)
    return Average(name, note, (g[3], g[4], g[5], g[6]), species, times, values)


def encode_average(a: Average) -> bytes:
    nt, ns, nz, ny, nx = a.values.shape
    first, last = (a.times[0], a.times[-1]) if a.times else ((0, 0.0, 0, 0.0),) * 2
    out = [record(_spaced(a.name, 10) + _spaced(a.note, 60) + struct.pack(">iiifif", 0, ns, first[0], first[1], last[2], last[3]))]
    out.append(record(struct.pack(">ffiffffiiiiifff", 0, 0, 0, *a.origin, nx, ny, nz, 0, 0, 0, 0, 0)))
    out.append(record(struct.pack(">iiii", 1, 1, nx, ny)))
    out.append(record(b"".join(_spaced(s, 10) for s in a.species)))
    for t in range(nt):
        out.append(record(struct.pack(">ifif", *a.times[t])))
        for s in range(ns):
            out += [record(struct.pack(">i", 1) + _spaced(a.species[s], 10) + a.values[t, s, k].astype(">f4").tobytes()) for k in range(nz)]
    return b"".join(out)


def read_average(spark: SparkSession, path: str) -> DataFrame:
    """date, hour, species, LAY__i, ROW__i, COL__i and value of all files under a path."""
    from gridspark.sources.records import read_records

    return read_records(spark, path).select("date", "hour", F.col("name").alias("species"), "LAY__i", "ROW__i", "COL__i", "value")


def decode_layers(raw: bytes, ny: int, nx: int) -> list[tuple[float, int, np.ndarray]]:
    """(hour, date, plane) of each record of a file of three-dimensional meteorology."""
    return [(*struct.unpack(">fi", r[:8]), np.frombuffer(r[8:], dtype=">f4").reshape(ny, nx)) for r in records(raw)]


def encode_layers(planes: list[tuple[float, int, np.ndarray]]) -> bytes:
    return b"".join(record(struct.pack(">fi", hour, date) + p.astype(">f4").tobytes()) for hour, date, p in planes)


def read_layers(spark: SparkSession, path: str, ny: int, nx: int, names: list[str], first: str | None = None) -> DataFrame:
    """Planes by date, hour, variable and layer.

    ``names`` alternate in each layer (height and pressure; one name for a single
    variable); ``first`` is a plane of its own before the layers (surface temperature).
    """
    from gridspark.sources.records import read_records

    more = {"surface": first} if first else {}
    return read_records(spark, path, "layers", rows=ny, cols=nx, names=",".join(names), **more).select("date", "hour", "name", "LAY__i", "ROW__i", "COL__i", "value")


def unpack_bytes(raw: bytes, ny: int, nx: int, exponent: int, first: float) -> np.ndarray:
    """A delta-packed plane: differences run down the first column, then along the rows."""
    d = (np.frombuffer(raw, dtype=np.uint8).reshape(ny, nx).astype(float) - 127) / 2.0 ** (7 - exponent)
    d[0, 0] += first
    d[:, 0] = np.cumsum(d[:, 0])
    return np.cumsum(d, axis=1)


def pack_bytes(plane: np.ndarray) -> tuple[bytes, int, float]:
    """(bytes, exponent, first value); each difference is taken from the value that a reader will have."""
    steps = np.concatenate([np.abs(np.diff(plane[:, 0])), np.abs(np.diff(plane, axis=1)).ravel(), [0.0]])
    exponent = int(np.floor(np.log2(steps.max()))) + 1 if steps.max() > 0 else 0
    scale = 2.0 ** (7 - exponent)
    ny, nx = plane.shape
    out = np.empty((ny, nx), dtype=np.uint8)
    above = float(plane[0, 0])
    for j in range(ny):
        left = above
        for i in range(nx):
            q = int(np.clip(np.floor((plane[j, i] - left) * scale + 127.5), 0, 255))
            out[j, i] = q
            left += (q - 127) / scale
            if i == 0:
                above = left
    return out.tobytes(), exponent, float(plane[0, 0])


# ---------------------------------------------------------------- classic netCDF

_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


class _Cursor:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def i4(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.raw, self.at - 4)[0]

    def i8(self) -> int:
        self.at += 8
        return struct.unpack_from(">q", self.raw, self.at - 8)[0]

    def name(self) -> str:
        return self.take(self.i4()).decode()

    def take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return out

    def attrs(self) -> dict:
        tag, n = self.i4(), self.i4()
        out = {}
        for _ in range(n if tag else 0):
            name, kind, m = self.name(), self.i4(), self.i4()
            v = np.frombuffer(self.take(m * np.dtype(_TYPES[kind]).itemsize), dtype=_TYPES[kind])
            out[name] = v.tobytes().decode("utf-8", "replace") if kind == 2 else v.tolist()[0] if m == 1 else v.tolist()
        return out


def decode_netcdf(raw: bytes) -> tuple[dict[str, int], dict[str, tuple[tuple[str, ...], dict, np.ndarray]], dict]:
    """(dimensions, variables as (dims, attributes, array), attributes) of a classic or 64-bit-offset file."""
    c = _Cursor(raw)
    if c.take(4)[:3] != b"CDF" or raw[3] not in (1, 2):
        raise ValueError("not a classic netCDF file")
    n_rec = c.i4()
    tag, n = c.i4(), c.i4()
    dims = [(c.name(), c.i4()) for _ in range(n if tag else 0)]
    attrs = c.attrs()
    tag, n = c.i4(), c.i4()
    heads = []
    for _ in range(n if tag else 0):
        name = c.name()
        ids = [c.i4() for _ in range(c.i4())]
        own = c.attrs()
        kind, size = c.i4(), c.i4()
        heads.append((name, ids, own, kind, size, c.i8() if raw[3] == 2 else c.i4()))
    rec = [h for h in heads if h[1] and dims[h[1][0]][1] == 0]
    width = sum(h[4] for h in rec)
    if len(rec) == 1:
        h = rec[0]
        width = int(np.prod([dims[d][1] for d in h[1][1:]], dtype=int)) * np.dtype(_TYPES[h[3]]).itemsize
    out = {}
    for name, ids, own, kind, _, begin in heads:
        t = np.dtype(_TYPES[kind])
        shape = [dims[d][1] for d in ids]
        if ids and shape[0] == 0:
            n = int(np.prod(shape[1:], dtype=int))
            a = np.stack([np.frombuffer(raw, t, n, begin + r * width).reshape(shape[1:]) for r in range(n_rec)]) if n_rec else np.zeros([0, *shape[1:]], t)
        else:
            a = np.frombuffer(raw, t, int(np.prod(shape, dtype=int)), begin).reshape(shape)
        out[name] = (tuple(dims[d][0] for d in ids), own, a)
    return {d: m or n_rec for d, m in dims}, out, attrs


def encode_netcdf(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], dict, np.ndarray]], attrs: dict | None = None) -> bytes:
    """A 64-bit-offset classic file without a record dimension."""
    i4 = lambda x: struct.pack(">i", x)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: i4(len(s.encode())) + pad(s.encode())

    def attributes(d: dict) -> bytes:
        if not d:
            return i4(0) + i4(0)
        out = i4(12) + i4(len(d))
        for k, v in d.items():
            if isinstance(v, str):
                out += name(k) + i4(2) + i4(len(v.encode())) + pad(v.encode())
            else:
                a = np.atleast_1d(np.asarray(v))
                a = a.astype(">i4") if a.dtype.kind in "iub" else a.astype(">f8")
                out += name(k) + i4(_CODES[a.dtype.str[1:]]) + i4(len(a)) + pad(a.tobytes())
        return out

    ids = {d: k for k, d in enumerate(dims)}
    head = b"CDF\x02" + i4(0) + (i4(10) + i4(len(dims)) + b"".join(name(d) + i4(n) for d, n in dims.items()) if dims else i4(0) + i4(0)) + attributes(attrs or {})
    body, entries = [], []
    for v, (own, at, a) in variables.items():
        t = {"f": ">f8" if a.dtype.itemsize == 8 else ">f4", "i": ">i4", "u": ">i4", "b": ">i1", "S": "S1"}[a.dtype.kind]
        data = pad(np.ascontiguousarray(a, dtype=t).tobytes())
        body.append(data)
        entries.append(name(v) + i4(len(own)) + b"".join(i4(ids[d]) for d in own) + attributes(at) + i4(_CODES[np.dtype(t).str[1:]]) + i4(len(data)))
    start = len(head) + 8 + sum(len(e) + 8 for e in entries)
    out = head + (i4(11) + i4(len(entries)) if entries else i4(0) + i4(0))
    for e, data in zip(entries, body, strict=True):
        out += e + struct.pack(">q", start)
        start += len(data)
    return out + b"".join(body)


def read_netcdf(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A variable of every file under a path: file, an index column for each dimension, and the value; fill values are masked."""
    from gridspark.sources.netcdf import read_variable

    return read_variable(spark, path, name)
