import hashlib
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import shards as S
from gridspark.llm.common import shared_dir


def _brute(names, slots):
    """Every shard's whole permutation, claimed by turns."""
    order = sorted(names)
    perms = {}
    for s in order:
        o, k = (int.from_bytes(hashlib.md5(f"{salt}:{s}".encode()).digest()[:8], "big") for salt in ("offset", "skip"))
        perms[s] = [(o % slots + j * (k % (slots - 1) + 1)) % slots for j in range(slots)]
    out, at = {}, dict.fromkeys(order, 0)
    while len(out) < slots:
        for s in order:
            if len(out) == slots:
                break
            while perms[s][at[s]] in out:
                at[s] += 1
            out[perms[s][at[s]]] = names.index(s)
    return [out[i] for i in range(slots)]


def test_table_equals_turns():
    names = ["c", "a", "d", "b", "e"]
    assert S.lookup_table(names, 101).tolist() == _brute(names, 101)


def test_even_weighted_and_stable():
    names = [f"n{i}" for i in range(20)]
    full = S.lookup_table(names)
    sizes = np.bincount(full)
    assert sizes.max() - sizes.min() <= 1
    less = S.lookup_table(names[:-1])
    stays = full != 19
    assert (full[stays] != less[stays]).mean() < 0.1
    heavy = np.bincount(S.lookup_table({"a": 3, "b": 1}))
    assert abs(heavy[0] / heavy[1] - 3) < 0.01
    with pytest.raises(ValueError):
        S.lookup_table(names, 100)


def test_rows(spark):
    df = odd_docs(spark, TEXTS).withColumnRenamed("score", "slot").withColumnRenamed("predicted", "shard")
    got = S.place(df, ["x", "y", "z"]).collect()
    filled = S.lookup_table(["x", "y", "z"])
    assert len(got) == len(TEXTS)
    for r in got:
        # a row without a number goes to slot 0
        slot = 0 if r.doc_id is None else int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % S.SLOTS
        assert (r.slot, r.shard) == (slot, filled[slot])
    assert S.place(odd_docs(spark, []), ["x"]).count() == 0
    none = spark.createDataFrame([(None, "t")], "doc_id long, text string")
    assert S.place(none, ["x", "y"]).collect()[0].slot == 0


def test_write(spark):
    path = shared_dir(spark)
    S.write_shards(odd_docs(spark, TEXTS), path, ["x", "y"])
    back = spark.read.parquet(path)
    assert back.count() == len(TEXTS)
    assert set(Counter(r.shard for r in back.collect())) <= {0, 1}


def test_write_nested_maps(spark):
    """Columns that can't be hashed, at any depth, don't decide where a row goes."""
    df = spark.sql("SELECT id AS doc_id, map('a', id) AS `m.1`, struct(map('b', 1) AS m) AS s, array(map(1, 2)) AS a, array(id) AS `x y` FROM range(50)")
    path = shared_dir(spark)
    S.write_shards(df, path, ["x", "y"])
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == list(range(50))
