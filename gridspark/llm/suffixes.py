"""Removal of repeated byte strings by external induced suffix sorting.

A string of 50 bytes that also starts in a document with a smaller doc_id goes.
The steps, each a Spark stage:

1. Equal texts are one text, held by its least doc_id.
2. Every start of a 50-byte string is filed under the least of the hashes of the
   16-byte strings inside it, rare ones first, so that a phrase of many documents
   files only the strings that lie within it.  Equal strings have equal least
   hashes: what one hash has together is all that can match.
3. Runs of starts under one hash meet by that hash and a hash of their bytes.
   Equal runs are one run, held by its least document.  A hash with one distinct
   run has nothing to sort; this loses nothing.
4. The other distinct runs travel with their bytes, sorted by their hash.  They
   are taken in blocks of bounded size that end between hashes, so a shard may be
   far larger than memory.  The suffixes of a block are sorted by induction: the
   S*-suffixes first, then queues on disk carry tuples of (suffix, common prefix
   with the one before) to the L- and then to the S-suffixes.  Neighbours with a
   common prefix of 50 or more hold one string.  Where a hash has too many distinct
   runs for a block, its strings travel one by one under hashes of their own.
5. The covered ranges return to their documents.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from gridspark.llm.common import array_sum, ids_and_text, mix, n_parts, order_classes, split, table, trim, written

LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1
RUN = 64  # most starts of one run
BATCH_CHARS = 1_000_000
#: Bytes of text whose runs share a bucket (some 30 MB of hashes), and bytes of text for a task of the shuffles.
BUCKET_BYTES = 64 << 20
PART_BYTES = 64 << 20
#: Bytes of distinct runs that are sorted together, and distinct runs of one hash beyond which it is split.
BLOCK_BYTES = 2_000_000
SPLIT_RUNS = 10_000
#: Buckets of the counts that give the hashes' order; any order gives the same result.
BUCKETS_LOG2 = 20
#: Rows and bytes of a table up to which it is broadcast to the documents; beyond, both are shuffled.
BROADCAST_BYTES = 48_000_000
#: Tuples of a queue held in memory before they go to its file.
HELD = 1 << 20
#: Rows without doc_id count as one document behind all others.
LAST = (1 << 63) - 1

# ------------------------------------------------------------ induced sorting


class Queue:
    """Tuples (suffix, common prefix) for each first symbol, in the order in which they come; the excess waits on disk.

    Insertion runs in the order of the suffixes that induce, so within a
    symbol first in is least: the queue of a symbol is a priority queue.
    """

    def __init__(self, symbols: int, held: int = HELD):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.n, self.held = 0, held
        self.file = None

    def push(self, symbol: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.parts[symbol].append(np.stack([suffixes, common]).astype(np.int32))
        self.n += len(suffixes)
        if self.n > self.held:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for s, parts in enumerate(self.parts):
            if parts:
                rows = np.concatenate(parts, axis=1)
                self.spilled[s].append((self.file.tell(), rows.shape[1]))
                self.file.write(rows.tobytes())
                self.parts[s] = []
        self.n = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for at, n in self.spilled[symbol]:
            self.file.seek(at)
            out.append(np.frombuffer(self.file.read(8 * n), dtype=np.int32).reshape(2, n))
            self.file.seek(0, 2)
        out += self.parts[symbol]
        self.n -= sum(p.shape[1] for p in self.parts[symbol])
        self.parts[symbol], self.spilled[symbol] = [], []
        rows = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int32)
        return rows[0].astype(np.int64), rows[1].astype(np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, at most ``limit``; t is padded by ``limit`` bytes."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    for k in range(limit):
        same = t[a[live] + k] == t[b[live] + k]
        live = live[same]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _sort_starred(t: np.ndarray, starred: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """S*-suffixes in order by their first ``depth`` symbols, and the common prefix with the one before.

    Eight symbols a round; a round only takes the suffixes that are still equal.
    """
    words = np.ndarray((len(t) - 8,), dtype=">u8", buffer=t, strides=(1,))
    order = np.arange(len(starred))
    new = np.zeros(len(starred), dtype=bool)
    new[:1] = True
    tied = np.arange(len(starred))
    for at in range(0, depth, 8):
        group = (np.cumsum(new) - 1)[tied]
        w = words[starred[order[tied]] + at].astype(np.uint64)
        by = np.lexsort((w, group))
        order[tied], w = order[tied[by]], w[by]
        new[tied[1:]] |= (w[1:] != w[:-1]) & (group[1:] == group[:-1])
        last = np.append(new[1:], True)
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            break
    out = starred[order]
    common = np.zeros(len(out), dtype=np.int64)
    common[1:] = _common(t, out[:-1], out[1:], depth)
    return out, common


def _spread(sources: np.ndarray, common: np.ndarray, since: np.ndarray, t: np.ndarray, keep: np.ndarray, queue: Queue, limit: int) -> None:
    """Carries the kept predecessors of sources (in order) to the queues of their symbols.

    common[i]: of source i with the source before it.  since[s]: the least common
    prefix of sources since symbol s was last pushed.  A pushed tuple's common
    prefix is one more than the least between its source and the last one of its symbol.
    """
    if not len(sources):
        return
    before = sources - 1
    symbols = np.where(keep, t[np.maximum(before, 0)], -1).astype(np.int64)
    rows = np.flatnonzero(keep)
    order = rows[np.argsort(symbols[rows], kind="stable")]
    names, first = np.unique(symbols[order], return_index=True)
    bounds = np.append(first, len(order))
    whole = int(common.min())
    seen = np.zeros(len(since), dtype=bool)
    for i, s in enumerate(names.tolist()):
        own = order[bounds[i] : bounds[i + 1]]
        # least of common over (previous own row, own row]
        cuts = np.empty(2 * len(own), dtype=np.int64)
        starts = np.concatenate([[0], own[:-1] + 1])
        cuts[0::2], cuts[1::2] = starts, own + 1
        low = np.minimum.reduceat(np.append(common, limit), cuts)[0::2]
        low[0] = min(low[0], since[s])
        queue.push(s, before[own], np.minimum(low + 1, limit))
        last = int(own[-1])
        since[s] = int(common[last + 1 :].min()) if last + 1 < len(common) else limit
        seen[s] = True
    since[~seen] = np.minimum(since[~seen], whole)


def sorted_suffixes(text: np.ndarray, limit: int = LENGTH, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks (suffixes, common prefixes) of all suffixes of ``text``, from the greatest to the least.

    Symbols are 1 to 250, of which 1 ends a string; only the first ``limit``
    symbols decide.  A suffix's common prefix is that with the next one given
    (the next lesser), at most ``limit``.
    """
    n = len(text)
    t = np.concatenate([text.astype(np.uint8), np.zeros(2 * limit + 8, dtype=np.uint8)])
    if not n:
        return
    # S: less than the suffix behind it.  Equal neighbours take the type behind them.
    a, b = t[:n].astype(np.int16), t[1 : n + 1].astype(np.int16)
    differs = a != b
    nearest = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    is_s = np.where(nearest < n, a[np.minimum(nearest, n - 1)] < b[np.minimum(nearest, n - 1)], False)
    star = np.flatnonzero(is_s & np.concatenate([[False], ~is_s[:-1]]))
    order, common = _sort_starred(t, star, limit)
    first_of = np.searchsorted(t[order], np.arange(257)) if len(order) else np.zeros(257, dtype=np.int64)
    # L-suffixes, symbols upwards
    queue = Queue(256, held)
    result: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * 256
    store = tempfile.TemporaryFile()
    places: list[tuple[int, int]] = [(0, 0)] * 256
    since = np.zeros(256, dtype=np.int64)
    if not is_s[n - 1]:
        queue.push(int(t[n - 1]), np.array([n - 1]), np.array([0]))  # the end of the text is less than all
    last_source = -1
    for c in range(1, 256):
        got_s, got_c = [], []
        while True:
            s, k = queue.pop(c)
            if not len(s):
                break
            got_s.append(s)
            got_c.append(k)
            link = k.copy()
            if last_source >= 0 and len(got_s) == 1:
                link[0] = 0 if t[last_source] != c else int(_common(t, np.array([last_source]), s[:1], limit)[0])
            keep = (s > 0) & ~is_s[np.maximum(s - 1, 0)]
            _spread(s, link, since, t, keep, queue, limit)
            last_source = int(s[-1])
        if got_s:
            s, k = np.concatenate(got_s), np.concatenate(got_c)
            k[0] = 0
            places[c] = (store.tell(), len(s))
            store.write(np.stack([s, k]).astype(np.int32).tobytes())
        lo, hi = first_of[c], first_of[c + 1]
        if hi > lo:
            s, k = order[lo:hi], common[lo:hi].copy()
            k[0] = int(_common(t, np.array([last_source]), s[:1], limit)[0]) if last_source >= 0 else 0
            _spread(s, k, since, t, s > 0, queue, limit)
            last_source = int(s[-1])
    queue.close()
    # S-suffixes, symbols downwards; what is pushed first is greatest
    queue = Queue(256, held)
    since = np.zeros(256, dtype=np.int64)
    last_source = -1
    for c in range(255, 0, -1):
        while True:
            s, k = queue.pop(c)
            if not len(s):
                break
            k = k.copy()
            if last_source >= 0:
                k[0] = int(_common(t, np.array([last_source]), s[:1], limit)[0])
            keep = (s > 0) & is_s[np.maximum(s - 1, 0)]
            _spread(s, k, since, t, keep, queue, limit)
            yield s, k
            last_source = int(s[-1])
        at, m = places[c]
        if m:
            store.seek(at)
            rows = np.frombuffer(store.read(8 * m), dtype=np.int32).reshape(2, m).astype(np.int64)
            s, k = rows[0][::-1], rows[1]
            link = np.empty(m, dtype=np.int64)
            link[1:] = k[1:][::-1]
            link[0] = int(_common(t, np.array([last_source]), s[:1], limit)[0]) if last_source >= 0 else 0
            keep = (s > 0) & is_s[np.maximum(s - 1, 0)] & (t[np.maximum(s - 1, 0)] < c)
            _spread(s, link, since, t, keep, queue, limit)
            yield s, link
            last_source = int(s[-1])
    queue.close()
    store.close()


def repeated_starts(runs: list[bytes], least: list[int], length: int = LENGTH, held: int = HELD) -> list[np.ndarray]:
    """For each distinct run, held first by document ``least``: which starts of ``length`` bytes also stand in a run with a lesser one."""
    sizes = np.array([len(r) for r in runs])
    data = np.frombuffer(b"\xff".join([*runs, b""]), dtype=np.uint8).astype(np.int16)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = (data + 2).astype(np.int16)
    text[begin[1:] - 1] = 1
    out = np.zeros(len(text), dtype=bool)
    owner = np.repeat(np.arange(len(runs)), sizes + 1)
    fits = np.arange(len(text)) + length <= (begin[1:] - 1)[owner]
    firsts = np.array(least, dtype=np.int64)
    open_s: list[np.ndarray] = []

    def close() -> None:
        if open_s:
            s = np.concatenate(open_s)
            s = s[fits[s]]
            if len(s):
                d = firsts[owner[s]]
                out[s[d > d.min()]] = True
            open_s.clear()

    for s, k in sorted_suffixes(text.astype(np.uint8), length, held):
        cuts = np.flatnonzero(k < length)
        # whole groups within the chunk, vectorised; the open one waits
        if not len(cuts):
            open_s.append(s)
            continue
        open_s.append(s[: cuts[0]])
        close()
        last = cuts[-1]
        if last > cuts[0]:
            inner, group = s[cuts[0] : last], np.cumsum(k[cuts[0] : last] < length) - 1
            d = np.where(fits[inner], firsts[owner[inner]], np.iinfo(np.int64).max)
            low = np.minimum.reduceat(d, np.flatnonzero(k[cuts[0] : last] < length))
            out[inner[fits[inner] & (d > low[group])]] = True
        open_s.append(s[last:])
    close()
    return [out[b : b + max(0, z - length + 1)] for b, z in zip(begin[:-1].tolist(), sizes.tolist(), strict=True)]


# ------------------------------------------------------------ runs of starts


_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, BATCH_CHARS * 2), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def digests(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings of the data, by a running sum."""
    up, down = _powers(len(data) + 1)
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(0x51ED2701)) * up[:-1], dtype=np.uint64)])
    return mix((run[first + size] - run[first]) * down[first] + size.astype(np.uint64))


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the 16-byte strings at each byte; the data goes on for 64 bytes behind n."""
    words = np.ndarray((n + 48,), dtype="<u8", buffer=data, strides=(1,))
    return mix(words[: n + 40] * np.uint64(0x9E3779B97F4A7C15) + words[8 : n + 48] * np.uint64(0xC2B2AE3D27D4EB4F))


def _joined(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([*raw, b"\0" * 64]), dtype=np.uint8)


def gram_classes(docs: DataFrame) -> np.ndarray:
    """How common the 16-byte strings of each bucket are in all texts, as a class from 0 to 15."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64)
        for b in batches:
            texts = b["text"].to_pylist()
            for a, z in split(texts, BATCH_CHARS):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts[a:z]]
                n = sum(map(len, raw))
                h = _grams(_joined(raw), n)[:n]
                total += np.bincount((h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), minlength=len(total))
        return total

    return order_classes(array_sum(docs.select("text"), count, 1 << BUCKETS_LOG2))


def runs_of(raw: list[bytes], classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, document, first start, number of starts, hash) of the runs of starts with one least hash."""
    data = _joined(raw)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    n = int(begin[-1])
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return data, none, none, none, none.astype(np.uint64)
    h = _grams(data, n)
    if classes is not None:
        h = (classes[(h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)] << np.uint64(60)) | (h & np.uint64((1 << 60) - 1))
    low, width = h, 1
    while width * 2 <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - width)], low[WINDOW - width :])
    low = low[:n]
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    valid = np.arange(n) + LENGTH <= begin[1:][doc]
    change = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    keep = valid[first]
    first, count = first[keep], count[keep]
    # long runs (periodic text) in parts
    parts = -(-count // RUN)
    if (parts > 1).any():
        which = np.repeat(np.arange(len(first)), parts)
        step = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts)
        count = np.minimum(RUN, count[which] - step * RUN)
        first = first[which] + step * RUN
    doc = doc[first].astype(np.int64)
    return data, doc, first - begin[doc], count, low[first]


def _u4(x: np.ndarray) -> bytes:
    return np.asarray(x).astype("<u4").tobytes()


def _u8(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).astype("<u8", copy=False).tobytes()


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _news(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from those before them."""
    out = np.ones(len(keys[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """k1 and k2 (128 bits that stand for a text), doc (no doc_id: LAST) and text of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"))


_FILED = [("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("digests", pa.binary()), ("docs", pa.binary()), ("runs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]
_TOLD = [("batch", pa.int64()), ("equal", pa.binary()), ("sort", pa.binary()), ("split", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]
_FLAGS = [("k1", pa.int64()), ("k2", pa.int64()), ("low", pa.binary()), ("high", pa.binary())]
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in fields)


def _file(classes: object, buckets: int):
    """A batch's runs, packed by buckets of their hash: equal runs of the batch once, with its least document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            texts = b["text"].to_pylist()
            ids, keys = b["doc"].to_numpy(), np.column_stack([b["k1"].to_numpy(), b["k2"].to_numpy()])
            for a, z in split(texts, BATCH_CHARS):
                data, doc, first, count, h = runs_of([t.encode("utf-8", "surrogatepass") for t in texts[a:z]], classes.value)
                per = np.bincount(doc, minlength=z - a)
                at = np.concatenate([[0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in texts[a:z]])])[doc] + first
                g = digests(data, at, count + LENGTH - 1)
                d = ids[a:z][doc]
                bucket = (mix(h) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((d, g, h, bucket))
                bucket, h, g, d = bucket[order], h[order], g[order], d[order]
                new = _news(bucket, h, g)
                group = np.cumsum(new) - 1
                least = d[np.flatnonzero(new)][group] if len(d) else d
                held = d == least
                equal = order[~held]
                bucket, h, g, d, order = bucket[held], h[held], g[held], d[held], order[held]
                names, starts = np.unique(bucket, return_index=True)
                ends = np.append(starts, len(bucket))
                rows = [(int(n), number, _u8(h[s:e]), _u8(g[s:e]), _u8(d[s:e]), _u4(order[s:e]), None, None) for n, s, e in zip(names, ends[:-1], ends[1:], strict=True)]
                rows.append((number % buckets, number, None, None, None, _u4(equal), keys[a:z].astype("<i8").tobytes(), _u4(per)))
                yield _batch(rows, _FILED)
                number += 1
        trim()

    return run


def _compare_bucket(held: list[tuple], split_runs: int) -> list[tuple]:
    """For each batch: its runs that a lesser document has too, those to be sorted, and those to be split and sorted."""
    h, g, d = (np.concatenate([np.frombuffer(x[k], dtype=t) for x in held]) for k, t in ((1, "<u8"), (2, "<u8"), (3, "<i8")))
    r = np.concatenate([np.frombuffer(x[4], dtype="<u4") for x in held])
    batch = np.repeat(np.arange(len(held)), [len(x[1]) // 8 for x in held])
    order = np.lexsort((d, g, h))
    h, g, d = h[order], g[order], d[order]
    new_h = _news(h)
    new = new_h | _news(g)
    least = d[np.flatnonzero(new)]
    equal = d > least[np.cumsum(new) - 1]
    # a hash whose distinct runs are all held by one document tells nothing new
    of = np.flatnonzero(new_h[new])
    several = np.minimum.reduceat(least, of) != np.maximum.reduceat(least, of)
    many = np.diff(np.append(of, len(least))) > split_runs
    group = np.cumsum(new_h) - 1
    sort = ~equal & several[group]
    cut = sort & many[group]
    kind = np.where(equal, 1, np.where(cut, 3, np.where(sort, 2, 0)))
    some = np.flatnonzero(kind)
    some = some[np.lexsort((kind[some], batch[order[some]]))]
    b, k, r = batch[order[some]], kind[some], r[order[some]]
    ends = np.searchsorted(b * 4 + k, (np.arange(len(held))[:, None] * 4 + np.array([1, 2, 3, 4])).ravel()).reshape(-1, 4)
    return [(x[0], _u4(r[e[0] : e[1]]), _u4(r[e[1] : e[2]]), _u4(r[e[2] : e[3]]), None, None) for x, e in zip(held, ends.tolist(), strict=True) if e[3] > e[0]]


def _compare(split_runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            rows = []
            for bucket, batch, h, g, d, runs, keys, counts in zip(*(b[c].to_pylist() for c, _ in _FILED), strict=True):
                if keys is not None:
                    rows.append((batch, runs, None, None, keys, counts))
                    continue
                if bucket != now:
                    rows += _compare_bucket(held, split_runs) if held else []
                    now, held = bucket, []
                held.append((batch, h, g, d, runs))
            yield _batch(rows, _TOLD)
        if held:
            yield _batch(_compare_bucket(held, split_runs), _TOLD)
        trim()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, head, told = None, None, []

    def close() -> list[tuple]:
        if head is None:
            return []
        counts = np.frombuffer(head[1], dtype="<u4").astype(np.int64)
        kind = np.zeros(int(counts.sum()), dtype=np.uint8)
        for some in told:
            for k, r in enumerate(some):
                if r is not None:
                    kind[np.frombuffer(r, dtype="<u4")] = k + 1
        keys = np.frombuffer(head[0], dtype="<i8").reshape(-1, 2).tolist()
        ends = np.cumsum(counts).tolist()
        own = [(key, kind[e - n : e]) for key, e, n in zip(keys, ends, counts.tolist(), strict=True)]
        return [(*key, np.packbits(x & 1).tobytes(), np.packbits(x >> 1).tobytes()) for key, x in own if x.any()]

    for b in batches:
        rows = []
        for batch, equal, sort, cut, keys, counts in zip(*(b[c].to_pylist() for c, _ in _TOLD), strict=True):
            if batch != now:
                rows += close()
                now, head, told = batch, None, []
            if keys is not None:
                head = keys, counts
            told.append((equal, sort, cut))
        yield _batch(rows, _FLAGS)
    yield _batch(close(), _FLAGS)
    trim()


def parts_of(spark: SparkSession, size: int) -> int:
    """Tasks of a shuffle for so many bytes of text, at least those of the session."""
    return max(n_parts(spark), size // PART_BYTES)


def run_flags(firsts: DataFrame, classes: object, size: int) -> DataFrame:
    """k1, k2, low and high: two bits for each run of a text that has any: 1 held by a lesser document, 2 to be sorted, 3 to be split and sorted.

    Hashes travel packed, a row for each batch of documents and bucket; a batch's texts travel with one of them.
    ``size``: bytes of all texts, which the number of buckets follows, as a bucket is compared in memory.
    """
    parts = parts_of(firsts.sparkSession, size)
    filed = firsts.mapInArrow(_file(classes, max(256, 4 * n_parts(firsts.sparkSession), size // BUCKET_BYTES)), _ddl(_FILED))
    compared = filed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(SPLIT_RUNS), _ddl(_TOLD))
    return compared.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(_gather, _ddl(_FLAGS))


_SENT = [("shard", pa.int64()), ("run", pa.binary()), ("doc", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("ranges", pa.binary())]
_RANGES = [("k1", pa.int64()), ("k2", pa.int64()), ("ranges", pa.binary())]


def _bits(packed: list[bytes], per: list[int]) -> np.ndarray:
    rows = [np.unpackbits(np.frombuffer(x, dtype=np.uint8))[:n] for x, n in zip(packed, per, strict=True)]
    return np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint8)


def _send(classes: object):
    """The runs to be sorted with their bytes; for each text, the ranges that equal runs cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, low, high = (b[c].to_pylist() for c in ("text", "low", "high"))
            ids, k1, k2 = (b[c].to_pylist() for c in ("doc", "k1", "k2"))
            for a, z in split(texts, BATCH_CHARS):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts[a:z]]
                data, doc, first, count, h = runs_of(raw, classes.value)
                per = np.bincount(doc, minlength=len(raw)).tolist()
                kind = _bits(low[a:z], per) + 2 * _bits(high[a:z], per)
                rows: list[tuple] = []
                use = np.flatnonzero(kind == 2)
                for i, f, c, x in zip(doc[use].tolist(), first[use].tolist(), count[use].tolist(), h[use].view(np.int64).tolist(), strict=True):
                    rows.append((x, raw[i][f : f + c + LENGTH - 1], ids[a + i], k1[a + i], k2[a + i], f, None))
                use = np.flatnonzero(kind == 3)
                if len(use):
                    begin = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
                    i, f = np.repeat(doc[use], count[use]), np.concatenate([np.arange(s, s + c) for s, c in zip(first[use].tolist(), count[use].tolist(), strict=True)])
                    x = digests(data, begin[i] + f, np.full(len(i), LENGTH)).view(np.int64)
                    rows += [(s, raw[j][g : g + LENGTH], ids[a + j], k1[a + j], k2[a + j], g, None) for s, j, g in zip(x.tolist(), i.tolist(), f.tolist(), strict=True)]
                use = np.flatnonzero(kind == 1)
                names, at = np.unique(doc[use], return_index=True)
                pairs = np.column_stack([first[use], count[use]])
                for i, s, e in zip(names.tolist(), at.tolist(), np.append(at, len(use))[1:].tolist(), strict=True):
                    rows.append((k1[a + i], None, None, k1[a + i], k2[a + i], None, _u4(pairs[s:e].ravel())))
                yield _batch(rows, _SENT)
        trim()

    return run


def _solved(runs: list[bytes], least: list[int], places: list[list[tuple]], held: int) -> list[tuple]:
    """The covered ranges of a block of distinct runs: (k1, k2, ranges)."""
    out: dict[tuple, list[int]] = {}
    for at, hit in zip(places, repeated_starts(runs, least, LENGTH, held), strict=True):
        if hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            pairs = [(s, e - s) for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]
            for k1, k2, f in at:
                out.setdefault((k1, k2), []).extend(y for s, c in pairs for y in (f + s, c))
    return [(*k, _u4(np.array(r))) for k, r in out.items()]


def _solve(block_bytes: int, held: int):
    """Rows come by shard (a hash), run and document; the first of a run is its least document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[bytes] = []
        least: list[int] = []
        places: list[list[tuple]] = []
        now = last = None
        size = 0
        for b in batches:
            out: list[tuple] = []
            for shard, text, doc, k1, k2, at, ranges in zip(*(b[c].to_pylist() for c, _ in _SENT), strict=True):
                if ranges is not None:
                    out.append((k1, k2, ranges))
                    continue
                if shard != now:
                    if size >= block_bytes:
                        out += _solved(runs, least, places, held)
                        runs, least, places, size = [], [], [], 0
                    now, last = shard, None
                if text != last:
                    runs.append(text)
                    least.append(doc)
                    places.append([(k1, k2, at)])
                    last = text
                    size += len(text)
                elif doc > least[-1]:
                    out.append((k1, k2, _u4(np.array([at, len(text) - LENGTH + 1]))))
                else:
                    places[-1].append((k1, k2, at))
            yield _batch(out, _RANGES)
        if runs:
            yield _batch(_solved(runs, least, places, held), _RANGES)
        trim()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def packed() -> bytes:
        r = np.frombuffer(b"".join(held), dtype="<u4").astype(np.int64).reshape(-1, 2)
        r = r[np.argsort(r[:, 0], kind="stable")]
        end = np.maximum.accumulate(r[:, 0] + r[:, 1])
        new = np.concatenate([[True], r[1:, 0] > end[:-1]])
        first = np.flatnonzero(new)
        return _u4(np.column_stack([r[first, 0], np.append(end[first[1:] - 1], end[-1]) - r[first, 0]]).ravel())

    for b in batches:
        rows = []
        for k1, k2, r in zip(*(b[c].to_pylist() for c, _ in _RANGES), strict=True):
            if (k1, k2) != now:
                if held:
                    rows.append((*now, packed()))
                now, held = (k1, k2), []
            held.append(r)
        yield _batch(rows, _RANGES)
    if held:
        yield _batch([(*now, packed())], _RANGES)
    trim()


def _near(small: DataFrame, *columns: str) -> DataFrame:
    """The table as a broadcast side if its measured size is bounded."""
    size = sum((F.length(c) for c in columns), F.lit(64))
    n = small.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(small) if n <= BROADCAST_BYTES else small


def repeats(docs: DataFrame) -> DataFrame:
    """k1, k2 and least (doc) of the texts of 50 bytes or more that stand in several rows."""
    rows = keyed(docs).filter(F.octet_length("text") >= LENGTH)
    return rows.groupBy("k1", "k2").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")


def covered_ranges(docs: DataFrame, several: DataFrame) -> DataFrame:
    """k1, k2 and ranges of the texts that lose bytes: starts, each of which covers the 50 bytes from it, as little-endian uint32 pairs (first, number).

    ``several``: repeats() of the same rows.  What a text loses only because a lesser document has all of it isn't listed.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_of(spark, size)
    firsts = keyed(docs).filter(F.octet_length("text") >= LENGTH).join(_near(several), ["k1", "k2"], "left")
    firsts = firsts.filter(F.col("least").isNull() | (F.col("doc") == F.col("least"))).drop("least")
    classes = spark.sparkContext.broadcast(gram_classes(firsts))
    flags = written(run_flags(firsts, classes, size).dropDuplicates(["k1", "k2"]))
    near = firsts.join(_near(flags, "low", "high"), ["k1", "k2"])
    sent = near.mapInArrow(_send(classes), _ddl(_SENT))
    solved = sent.repartition(2 * parts, "shard").sortWithinPartitions("shard", "run", "doc").mapInArrow(_solve(BLOCK_BYTES, HELD), _ddl(_RANGES))
    return solved.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_merge, _ddl(_RANGES))


def _cut(raw: bytes, ranges: bytes | None, all_of_it: bool) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what stays)"""
    if all_of_it:
        return len(raw), 1, b""
    if not ranges:
        return 0, 0, raw
    gone = n = at = 0
    out = []
    for first, count in np.frombuffer(ranges, dtype="<u4").astype(np.int64).reshape(-1, 2).tolist():
        end = first + count + LENGTH - 1
        if n and first <= at:
            gone += end - at
        else:
            out.append(raw[at:first])
            gone += end - first
            n += 1
        at = end
    out.append(raw[at:])
    return gone, n, b"".join(out)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every row's columns (but for text), renamed column_0, column_1 ..., and text, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) and left (their whole characters).

    Texts that are null or shorter than 50 bytes lose nothing.  Rows of one
    doc_id, whether repeated or with different texts, are one document and don't
    cover each other; rows without doc_id are one document behind all others.
    """
    several = written(repeats(docs))
    ranges = written(covered_ranges(docs, several))
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[_named(c).alias(n) for c, n in names.items()], "text", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"))
    both = rows.join(_near(several), ["k1", "k2"], "left").join(_near(ranges, "ranges"), ["k1", "k2"], "left")
    both = both.select(*names.values(), "text", "ranges", F.coalesce(F.col("doc") > F.col("least"), F.lit(False)).alias("all"))
    kept = [f for f in both.schema.fields if f.name not in ("ranges", "all")]
    out = StructType([*kept, *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType()), StructField("left", StringType())])
    arrow = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
            found = [_cut(*x) for x in zip(raw, b["ranges"].to_pylist(), b["all"].to_pylist(), strict=True)]
            new = [[len(r) for r in raw], [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [f[2].decode("utf-8", "ignore") for f in found]]
            columns = [b[f.name].cast(arrow.field(f.name).type) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, f.type) for x, f in zip(new, list(arrow)[len(kept) :], strict=True))], schema=arrow)
        trim()

    return both.mapInArrow(cut, out)


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select(F.col("column_0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated bytes; n_chars follows, where there is one.  What is left blank by the removal goes.

    A character whose bytes were removed in part goes as a whole.  All other
    columns stay as they are, whatever their names.
    """
    out = deduplicated(docs)
    cut = F.col("n_removed") > 0
    out = out.filter(~cut | (F.length(F.trim("left")) > 0))
    columns = []
    for i, c in enumerate(docs.columns):
        if c == "text":
            columns.append(F.when(cut, F.col("left")).otherwise(F.col("text")).alias(c))
        elif c == "n_chars":
            columns.append(F.when(cut, F.char_length("left")).otherwise(F.col(f"column_{i}")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"column_{i}").alias(c))
    return out.select(*columns)
