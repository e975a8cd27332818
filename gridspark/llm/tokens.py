"""Token ids by a public tokenizer, and a range asymmetric numeral system (rANS) format for them.

``TokenEncoder`` gives exactly what the tokenizers library gives for a whole
text, but asks it only once for each distinct piece.

The format holds one frequency table a file part and independent blocks.  In a
block the ids are dealt to interleaved lanes, each with its own rANS state, so
that numpy advances all lanes at once.  Checkpoints (step, word offset, states)
let a reader start inside a block, and a crc32 guards each block.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import ids_and_text, n_parts, shared_dir, table, trim

#: Bytes of text encoded at a time, and what the store of pieces may hold.
STEP_BYTES = 4_000_000
KEPT_PIECES = 500_000
KEPT_BYTES = 64  # a longer piece is encoded anew each time
_ENCODERS: dict[str, TokenEncoder] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> TokenEncoder:
    """The encoder of this worker process; tasks that follow reuse its pieces."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenEncoder(path)
    return _ENCODERS[path]


def _byte_classes() -> np.ndarray:
    """0 white space, 1 letters (with all bytes of letters from U+00C0 to U+017F), 2 digits, 3 the rest of ASCII."""
    out = np.full(256, 3, dtype=np.uint8)
    for b in range(256):
        if b >= 0x80 or chr(b).isalpha():
            out[b] = 1
        elif chr(b).isdigit():
            out[b] = 2
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


_CLASS = _byte_classes()
_BLANK = b" \t\n\x0b\x0c\r"
#: Bytes after which a word is left whole: an apostrophe, and the first bytes of all but plain Latin letters.
_ODD = np.zeros(256, dtype=bool)
_ODD[[0x27, 0xC2, *range(0xC6, 0x100)]] = True


class TokenEncoder:
    """encode(): the ids of whole texts, exactly those of the library.

    A byte-level tokenizer of this kind first cuts a text by kinds of characters
    and never merges across a cut.  The same cuts are found here for all texts at
    once, on bytes; each distinct piece goes to the library once, and its ids are
    kept.  A word with an apostrophe or with characters beyond the plain Latin
    letters stays one piece; a text with rarer white space, or with the text of a
    special token, is one piece as a whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        vocab = self.t.get_vocab()
        self.size = max(vocab.values()) + 1
        self.n_bytes = np.zeros(self.size, dtype=np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)
        self.special = [x.content.encode() for x in self.t.get_added_tokens_decoder().values()]
        # pieces that may hold rarer white space or a special token's text go to the library one by one
        self.alone = re.compile(b"|".join([b"[\x1c-\x1f\xc2\xe1-\xe3]", *map(re.escape, self.special)]))
        self._forget()

    def _forget(self) -> None:
        self.kept: dict[bytes, int] = {}
        self.first, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.hits = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _keep_frequent(self) -> None:
        """Drops the half of the pieces that occurred least."""
        pieces = list(self.kept)
        hits = self.hits[: len(pieces)]
        stay = np.flatnonzero(hits > np.median(hits))[: KEPT_PIECES // 2]
        n = self.length[stay]
        ends = np.cumsum(n)
        self.ids = self.ids[np.repeat(self.first[stay] - (ends - n), n) + np.arange(int(n.sum()))]
        self.first, self.length, self.hits = ends - n, n, hits[stay] // 2
        self.kept = {pieces[i]: k for k, i in enumerate(stay.tolist())}

    def _library(self, led: list[bytes], plain: list[bytes], alone: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has.

        Pieces that begin with white space (``led``) go to the library in a row,
        those that don't each behind a line end, which stays a token of its own.
        """
        counts, out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
        for pieces, gap in ((led, b""), (plain, b"\n")):
            for at in range(0, len(pieces), 5000):
                some = pieces[at : at + 5000]
                ids = np.array(self.t.encode_batch_fast([(gap + gap.join(some)).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
                ends = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + len(gap))
                cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
                starts = np.concatenate([[0], cuts[:-1]])
                counts.append(cuts - starts - len(gap))
                out.append(np.delete(ids, starts) if gap else ids)
        for p in alone:
            ids = np.array(self.t.encode_batch_fast([p.decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, dtype=np.uint32)
            counts.append(np.array([len(ids)]))
            out.append(ids)
        return np.concatenate(out), np.concatenate(counts)

    def _learn(self, led: list[bytes], plain: list[bytes], alone: list[bytes]) -> None:
        """Puts pieces behind the store."""
        ids, counts = self._library(led, plain, alone)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.length = np.concatenate([self.length, counts])
        self.hits = np.concatenate([self.hits, np.zeros(len(counts), dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids])

    def whole(self, data: np.ndarray) -> bool:
        """Whether a text must be seen as a whole: white space beyond ASCII's six, a special token's text."""
        if ((data >= 0x1C) & (data <= 0x1F)).any():
            return True
        for lead, seconds in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0))):
            at = np.flatnonzero(data[:-1] == lead)
            if len(at) and np.isin(data[at + 1], seconds).any():
                return True
        for lead, second, thirds in ((0xE2, 0x80, (*range(0x80, 0x90), *range(0xA8, 0xB0))), (0xE2, 0x81, (0x9F, 0xA0)), (0xE3, 0x80, (0x80,))):
            at = np.flatnonzero(data[:-2] == lead)
            if len(at) and ((data[at + 1] == second) & np.isin(data[at + 2], thirds)).any():
                return True
        raw = data.tobytes()
        return any(s in raw for s in self.special)

    def _cuts(self, data: np.ndarray, begin: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Starts of the pieces of the texts that begin at ``begin`` (their end last); ``whole``: texts that aren't cut."""
        kind = _CLASS[data]
        seen = kind > 0
        n = len(data)
        starts = begin[:-1][np.diff(begin) > 0]
        head = np.zeros(n, dtype=bool)
        head[starts] = True
        # words begin at a visible byte behind white space or at a text's start
        word = seen.copy()
        word[1:] &= ~seen[:-1]
        word |= seen & head
        words = np.flatnonzero(word)
        inner = np.zeros(n, dtype=bool)
        inner[1:] = (kind[1:] != kind[:-1]) & seen[1:] & seen[:-1]
        inner &= ~head
        odd = _ODD[data]
        # the multiplication and division signs stand among the letters
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        at = np.flatnonzero(inner)
        if len(at) and odd.any():
            left = np.zeros(len(words), dtype=bool)
            left[np.searchsorted(words, np.flatnonzero(odd), side="right") - 1] = True
            at = at[~left[np.searchsorted(words, at, side="right") - 1]]
        cut = head
        cut[at] = True
        # a word takes the white space just before it along
        cut[np.where(head[words], words, words - 1)] = True
        for i in np.flatnonzero(whole).tolist():
            cut[begin[i] + 1 : begin[i + 1]] = False
        return np.flatnonzero(cut)

    def _encode(self, data: np.ndarray, begin: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(begin), dtype=np.int64)
        cuts = self._cuts(data, begin, whole)
        bounds = np.append(cuts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        names, index = words.dictionary.to_pylist(), words.indices.to_numpy()
        number = np.fromiter(map(self.kept.get, names, itertools.repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(number < 0).tolist()
        led, plain, alone, long = [], [], [], []
        for i in new:
            p = names[i]
            if len(p) > KEPT_BYTES:
                long.append(i)
            elif p[-1] in _BLANK or self.alone.search(p):
                alone.append(i)
            elif p[0] in _BLANK:
                led.append(i)
            else:
                plain.append(i)
        n = len(self.kept)
        if new:
            number[led + plain + alone + long] = n + np.arange(len(new))
            self._learn([names[i] for i in led], [names[i] for i in plain], [names[i] for i in alone + long])
        lengths = self.length[number]
        self.hits[number] += np.bincount(index, minlength=len(names))
        each = lengths[index]
        ends = np.cumsum(each)
        ids = self.ids[np.repeat(self.first[number][index] - (ends - each), each) + np.arange(int(ends[-1]))]
        per = np.concatenate([[0], ends])[np.searchsorted(cuts, begin)]
        short = [names[i] for i in led + plain + alone]  # long pieces are forgotten
        self.kept.update(zip(short, range(n, n + len(short)), strict=True))
        n += len(short)
        self.first, self.length, self.hits = self.first[:n], self.length[:n], self.hits[:n]
        self.ids = self.ids[: int(self.first[-1] + self.length[-1]) if n else 0]
        if n > KEPT_PIECES:
            self._keep_frequent()
        return ids, per

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, text after the last, their ids in a row, where each text's begin and the last's end), a few MB at a time.

        Texts without nulls.  A text that is longer by itself is cut before white space and its ids are put together.
        """
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP_BYTES, side="right")) - 1)
            own, begin = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
            if self.whole(own):
                whole = np.array([self.whole(own[s:e]) for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])
            else:
                whole = np.zeros(z - a, dtype=bool)
            if z == a + 1 and len(own) > 2 * STEP_BYTES and not whole[0]:
                parts, at = [], 0
                while at < len(own):
                    end = min(len(own), at + STEP_BYTES)
                    while end < len(own) and not (_CLASS[own[end]] == 0 and _CLASS[own[end - 1]]):
                        end += 1
                    parts.append(self._encode(own[at:end], np.array([0, end - at]), whole)[0])
                    at = end
                ids = np.concatenate(parts)
                per = np.array([0, len(ids)])
            else:
                ids, per = self._encode(own, begin, whole)
            yield a, z, ids, per
            a = z


# ---------------------------------------------------------------- rANS

BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
CHECKPOINT_STEPS = 256


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Whole frequencies that sum to 2**BITS; every id that occurs keeps at least 1."""
    total = int(counts.sum())
    freq = np.zeros(len(counts), dtype=np.int64)
    if total == 0:
        return freq
    used = counts > 0
    freq[used] = np.maximum(1, counts[used] * (1 << BITS) // total)
    off = (1 << BITS) - int(freq.sum())
    if off > 0:
        freq[int(freq.argmax())] += off
    while off < 0:  # ones were rounded up: take the excess from the largest
        order = np.argsort(-freq)[: max(1, min(-off, 1000))]
        take = np.minimum(freq[order] - 1, max(1, -off // len(order)))
        take = np.where(np.cumsum(take) <= -off, take, 0)
        freq[order] -= take
        off += int(take.sum())
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray, lanes: int = LANES) -> dict:
    """One independent block of at least one id: id i goes to lane i % lanes, step i // lanes."""
    lanes = max(1, min(lanes, len(ids)))
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words, marks = [], []
    shift = np.uint64(63 - BITS)
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        n = len(s)
        f, c = freq[s], cum[s]
        y = x[:n]
        # f << 43 may be 2**63, which still fits
        full = y >= (f << shift)
        words.append(y[full].astype("<u4"))
        y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[:n] = (q << np.uint64(BITS)) + (y - q * f) + c
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((step, sum(map(len, words)), x.copy()))
    total = sum(map(len, words))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    points = [{"step": s, "word": total - w, "states": st.astype("<u8").tobytes()} for s, w, st in marks[::-1]]
    return {"n": len(ids), "lanes": lanes, "states": x.astype("<u8").tobytes(), "words": stream, "checkpoints": points, "crc": zlib.crc32(ids.astype("<u4").tobytes())}


def decode_block(block: dict, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray, from_step: int = 0) -> np.ndarray:
    """All ids of a block, or those from a checkpoint's step on (then without the checksum).

    The stretches between checkpoints are decoded side by side, each from its own states.
    """
    lanes, n = block["lanes"], block["n"]
    words = np.frombuffer(block["words"], dtype="<u4")
    points = [{"step": 0, "word": 0, "states": block["states"]}, *block["checkpoints"]]
    points = [c for c in points if c["step"] >= from_step]
    if points[0]["step"] != from_step:
        raise ValueError("no checkpoint at that step")
    steps = -(-n // lanes)
    first = np.array([c["step"] for c in points])
    length = np.diff(np.append(first, steps))
    x = np.stack([np.frombuffer(c["states"], dtype="<u8").astype(np.uint64) for c in points])
    at = np.array([c["word"] for c in points])
    out = np.zeros((steps - from_step, lanes), dtype=np.uint32)
    mask = np.uint64((1 << BITS) - 1)
    for k in range(int(length.max())):
        live = np.flatnonzero(length > k)
        y = x[live]
        low = y & mask
        s = slots[low.astype(np.int64)]
        out[first[live] + k - from_step] = s
        y = freq[s] * (y >> np.uint64(BITS)) + low - cum[s]
        less = y < LOW
        if first[live[-1]] + k == steps - 1:  # the block's last step has ids for some lanes only
            less[-1, n - (steps - 1) * lanes :] = False
        row, lane = np.nonzero(less)
        per = np.bincount(row, minlength=len(live))
        word = np.repeat(at[live] - (np.cumsum(per) - per), per) + np.arange(len(row))
        y[row, lane] = (y[row, lane] << np.uint64(32)) | words[word].astype(np.uint64)
        at[live] += per
        x[live] = y
    ids = out.ravel()[: n - from_step * lanes]
    if not from_step and zlib.crc32(ids.astype("<u4").tobytes()) != block["crc"]:
        raise ValueError("a block's ids don't match its checksum")
    return ids


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, their running sums, and the id of each slot."""
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    return freq.astype(np.uint64), cum.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


FILE_SCHEMA = (
    "part int, block int, doc_ids binary, doc_lens binary, n_tokens long, ids array<int>, freqs array<int>, "
    "lanes int, states binary, words binary, checkpoints array<struct<step:int,word:long,states:binary>>, crc long"
)
BLOCK_IDS = 1 << 20


#: Text of a part; the mark in a file of a row without doc_id.
PART_BYTES = 64_000_000
NO_ID = -(1 << 63)


def _rows(part: int, numbers: np.ndarray, sizes: np.ndarray, stream: np.memmap, counts: np.ndarray) -> Iterator[dict]:
    freq = frequencies(counts)
    f, c, _ = tables(freq)
    used = np.flatnonzero(freq)
    ends = np.cumsum(sizes)
    a, block = 0, 0
    while a < len(sizes):
        before = int(ends[a] - sizes[a])
        z = max(a + 1, int(np.searchsorted(ends, before + BLOCK_IDS, side="right")))
        e = encode_block(np.asarray(stream[before : ends[z - 1]]), f, c)
        yield {
            "part": part, "block": block, "doc_ids": numbers[a:z].astype("<i8").tobytes(), "doc_lens": sizes[a:z].astype("<u4").tobytes(), "n_tokens": e["n"],
            # the part's table stands in its first block
            "ids": used.tolist() if block == 0 else None, "freqs": freq[used].tolist() if block == 0 else None,
            "lanes": e["lanes"], "states": e["states"], "words": e["words"], "checkpoints": e["checkpoints"], "crc": e["crc"],
        }
        a, block = z, block + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Writes the ids of every whole text (null: empty) and end_id after each, in ascending doc_id order.

    A range partition over doc_id becomes one part of about PART_BYTES of text:
    its ids wait in a file of the task, never in memory, until the part's table
    is known.  Equal doc_ids (repeated rows) stay, ordered by text; rows without
    a doc_id come first.  Other columns are ignored, whatever their names.  An
    empty table gives an empty file.
    """
    if partitions is None:
        size = ids_and_text(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        partitions = max(n_parts(docs.sparkSession), -(-size // PART_BYTES))
    d = ids_and_text(docs).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    schema = docs.sparkSession.createDataFrame([], FILE_SCHEMA).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        enc = encoder(tokenizer)
        counts = np.zeros(max(enc.size, end_id + 1), dtype=np.int64)
        metas, part = [], None
        with tempfile.TemporaryFile() as held:
            for b in batches:
                if not b.num_rows:
                    continue
                part = b["part"][0].as_py()
                numbers = pc.fill_null(b["doc_id"], NO_ID).to_numpy(zero_copy_only=False)
                for first, last, ids, per in enc.encode(b["text"]):
                    ids = np.insert(ids, per[1:], np.uint32(end_id))
                    metas.append((numbers[first:last], np.diff(per) + 1))
                    counts += np.bincount(ids, minlength=len(counts))
                    held.write(ids.astype("<u4").tobytes())
            if part is None:
                return
            held.flush()
            numbers, sizes = (np.concatenate([m[k] for m in metas]) for k in (0, 1))
            for row in _rows(part, numbers, sizes, np.memmap(held, dtype="<u4", mode="r"), counts):
                yield pa.RecordBatch.from_pylist([row], schema=arrow)
        trim()

    d.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def _ids_of(raw: bytes) -> pa.Array:
    ids = np.frombuffer(raw, dtype="<i8")
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32), part and place in the part, decoded block by block."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    # the tables are as many as the parts; each task of a part needs its own
    heads = rows.filter("block = 0").select("part", F.col("ids").alias("t_ids"), F.col("freqs").alias("t_freqs"))
    both = rows.drop("ids", "freqs").join(heads, "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, tuple] | None = None
        for b in batches:
            for row in b.to_pylist():
                if known is None or known[0] != row["part"]:
                    freq = np.zeros(max(row["t_ids"]) + 1, dtype=np.int64)
                    freq[row["t_ids"]] = row["t_freqs"]
                    known = row["part"], tables(freq)
                f, c, slots = known[1]
                ids = decode_block(row | {"n": row["n_tokens"]}, f, c, slots)
                lens = np.frombuffer(row["doc_lens"], dtype="<u4").astype(np.int64)
                ends = np.cumsum(lens)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        _ids_of(row["doc_ids"]), pa.array(lens, pa.int64()), pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)], pa.binary()),
                        pa.array([row["part"]] * len(lens), pa.int32()), pa.array([row["block"]] * len(lens), pa.int32()), pa.array(ends - lens, pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "part", "block", "at"],
                )

        trim()

    return both.mapInArrow(decode, "doc_id long, n_tokens long, ids binary, part int, block int, at long")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, block, base: the ids before each block.

    Running sums go within a part; only one number a part passes through the driver.
    """
    from pyspark.sql import Window

    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "block", "n_tokens")
    sums = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, before = 0, []
    for p, n in sums:
        before.append((p, base))
        base += n
    parts = spark.createDataFrame(before, "part int, part_base long")
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(parts, "part").select("part", "block", (F.col("part_base") + F.col("own")).alias("base"))


def crc32_of(ids: DataFrame) -> DataFrame:
    return ids.withColumn("ids_crc32", F.crc32("ids"))


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), 2)
    read = crc32_of(read_tokens(spark, path)).drop("ids")
    return read.join(starts(spark, path), ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
