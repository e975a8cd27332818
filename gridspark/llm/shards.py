"""Placement of documents in shards by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (an
offset and a step from two hashes of its name).  Shards take turns; at its turn a
shard claims its first free slot in that order, a weight of w giving w claims a
round.  Placement is then a hash, a remainder and one lookup, and a shard that
comes or goes moves few documents besides its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from gridspark.llm.common import table

SLOTS = 65_537
N_SHARDS = 64


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: dict[str, int] | list[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard at each slot; the order of ``shards`` doesn't matter beyond naming the indexes.

    ``shards`` maps names to whole weights of 1 or more.  Turns go by name.
    """
    weights = dict(shards) if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or not is_prime(slots) or len(weights) > slots or min(weights.values()) < 1:
        raise ValueError("needs a prime number of slots, at least as many as shards, and weights of 1 or more")
    index = {name: i for i, name in enumerate(weights)}
    order = sorted(weights)
    place = {s: _hash(s, "offset") % slots for s in order}
    step = {s: _hash(s, "skip") % (slots - 1) + 1 for s in order}
    out = np.full(slots, -1, dtype=np.int32)
    left = slots
    while True:
        for s in order:
            for _ in range(weights[s]):
                while out[place[s]] >= 0:
                    place[s] = (place[s] + step[s]) % slots
                out[place[s]] = index[s]
                left -= 1
                if not left:
                    return out


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, from its text's md5; a null key goes to slot 0."""
    head = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(head, F.lit(slots)), F.lit(0)).cast("int")


def place(docs: DataFrame, shards: dict[str, int] | list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Adds slot and shard to every row (columns of these names are replaced); nothing is shuffled.

    The table's size is fixed by ``slots``, so the broadcast doesn't grow with the data.
    """
    spark = docs.sparkSession
    filled = spark.createDataFrame(list(enumerate(lookup_table(shards, slots).tolist())), "slot int, shard int")
    return docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(filled), "slot")


def write_shards(docs: DataFrame, path: str, shards: dict[str, int] | list[str], salt: int = 8, **kw: object) -> None:
    """Writes one folder a shard; ``salt`` tasks share each, dealt by slot, so a shard never waits for one task."""
    placed = place(docs, shards, **kw)
    # places are told by number: names may hold dots or quotes
    known = placed.toDF(*[f"column_{i}" for i in range(len(placed.columns))])
    dealt = F.pmod(F.xxhash64(*[f.name for f in known.schema if _hashable(f.dataType)]), F.lit(salt))
    known.repartition(F.col(f"column_{placed.columns.index('shard')}"), dealt).toDF(*placed.columns).write.partitionBy("shard").parquet(path)


def _hashable(kind: DataType) -> bool:
    """Spark hashes all types but those that hold a map or a variant."""
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def _names() -> list[str]:
    return [f"shard-{i:04d}" for i in range(N_SHARDS)]


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), _names()).select("doc_id", "slot", "shard")


def sql() -> str:
    filled = lookup_table(_names()).tolist()
    return f"""
WITH t AS (SELECT {filled}::INT[] AS filled),
s AS (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {SLOTS})::INT AS slot FROM documents)
SELECT doc_id, slot, t.filled[slot + 1]::INT AS shard FROM s, t
"""
