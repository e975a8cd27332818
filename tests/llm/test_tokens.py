import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import tokens as T
from gridspark.llm.common import shared_dir


@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.integers(1, 64))
@settings(max_examples=40, deadline=None)
def test_block_round_trip(ids, lanes):
    ids = np.array(ids, dtype=np.uint32)
    f, c, slots = T.tables(T.frequencies(np.bincount(ids)))
    block = T.encode_block(ids, f, c, lanes)
    assert (T.decode_block(block, f, c, slots) == ids).all()
    for mark in block["checkpoints"]:
        assert (T.decode_block(block, f, c, slots, mark["step"]) == ids[mark["step"] * block["lanes"] :]).all()


def test_frequencies_keep_rare_ids():
    counts = np.ones(60_000, dtype=np.int64)
    counts[7] = 10**12
    f = T.frequencies(counts)
    assert f.sum() == 1 << T.BITS and f.min() == 1


def test_damaged_block():
    ids = np.arange(500, dtype=np.uint32) % 50
    f, c, slots = T.tables(T.frequencies(np.bincount(ids)))
    block = T.encode_block(ids, f, c, 8)
    block["crc"] ^= 1
    with pytest.raises(ValueError):
        T.decode_block(block, f, c, slots)


SIGNS = list("aB9_, '!.sdtm-\n\t\r\x0b\x00\x1c\x7f") + ["é", "×", "÷", "\u0301", "\u00a0", "\u2003", "\u3000", "\u0085", "\u200b", "\u2019", "中", "😀", "²", "Ж", "'s", "'ll", "  ", "\n\n", "<|endoftext|>", "\u0663"]


def _encoded(enc, texts):
    out = []
    for a, z, ids, per in enc.encode(pa.array(texts, pa.string())):
        assert len(per) == z - a + 1
        out += [ids[s:e].tolist() for s, e in zip(per[:-1], per[1:], strict=True)]
    return out


@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=40).map("".join), max_size=6))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library(texts):
    enc = T.encoder(T.tokenizer_path())
    texts = texts + ["x <|endoftext|>\n y"]
    assert _encoded(enc, texts) == [enc.t.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_small_store_and_long_text(monkeypatch):
    """Pieces are dropped and learned again; a long text is cut before white space."""
    monkeypatch.setattr(T, "KEPT_PIECES", 40)
    monkeypatch.setattr(T, "STEP_BYTES", 60)
    enc = T.TokenEncoder(T.tokenizer_path())
    rng = np.random.default_rng(3)
    words = [str(x) + "é"[: x % 2] for x in range(300)]
    texts = ["".join(str(rng.choice(words)) + str(rng.choice([" ", "\n", "  ", ", ", "\n \n"])) for _ in range(n)) for n in (0, 1, 5, 400, 30, 900)]
    for _ in range(2):
        assert _encoded(enc, texts) == [enc.t.encode(t, add_special_tokens=False).ids for t in texts]


def test_checkpoints_decode_side_by_side(monkeypatch):
    monkeypatch.setattr(T, "CHECKPOINT_STEPS", 3)
    ids = np.random.default_rng(5).integers(0, 90, 1000).astype(np.uint32) ** 2
    f, c, slots = T.tables(T.frequencies(np.bincount(ids)))
    for n in (1, 15, 16, 47, 48, 49, 1000):
        block = T.encode_block(ids[:n], f, c, 16)
        assert len(block["checkpoints"]) == (-(-n // 16) - 1) // 3
        assert (T.decode_block(block, f, c, slots) == ids[:n]).all()
        for mark in block["checkpoints"]:
            assert (T.decode_block(block, f, c, slots, mark["step"]) == ids[mark["step"] * block["lanes"] : n]).all()


def _brute(rows):
    t, at, out = T.encoder(T.tokenizer_path()).t, 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_file_round_trip(spark):
    path = shared_dir(spark)
    T.write_tokens(odd_docs(spark, TEXTS), path, T.tokenizer_path(), 2, 3)
    read = T.crc32_of(T.read_tokens(spark, path)).join(T.starts(spark, path), ["part", "block"])
    got = sorted(((r.doc_id, r.base + r["at"], r.n_tokens, r.ids_crc32) for r in read.collect()), key=lambda r: r[1])
    assert got == _brute(TEXTS)


def test_empty_table(spark):
    path = shared_dir(spark)
    T.write_tokens(odd_docs(spark, []), path, T.tokenizer_path(), 2)
    assert T.read_tokens(spark, path).count() == 0 and T.starts(spark, path).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.QUERY(spark, "/root/testdata/sf0.001").collect())
    assert got == _brute(rows)
