"""Exact Jaccard join of word shingles that skips what set relations already answer.

Equal sets are one set.  Each set's shingles are put in one order, rare buckets
first, and the first of them are indexed (a seventh at 90 percent, a quarter at 80):
two sets that link share a known number of these.

Sets that share their most common indexed shingle and are about as large are
compared with one of them, the leader; those that are alike are its followers, kept
as what they add to it and what they lack.  The index lists hold one block for each
leader with its followers, with their sizes and first position: two blocks from
whose sizes and positions the threshold can't be reached are skipped as a whole.  For
two leaders that meet, the common shingles are counted once.  The followers' counts,
with one another and with other leaders' followers, are derived from the leaders'
count and the few shingles by which the followers differ; no follower is compared in
full again.  What is known to be in one component is never derived.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import array_sum, fresh, mix, order_classes, split, table, trim, word_hashes, written

#: Words of a shingle and percent of two linked sets' union that they share: in the query, and in the pipeline's stage.
SHINGLE = 3
PERCENT = 90
STAGE_SHINGLE = 5
STAGE_PERCENT = 80
#: Indexed beyond the shortest prefix: one key in so many; linked sets then share as many more.
EXTRA = 32
#: Followers of a leader that are held in one row, and how much less than ``PERCENT`` makes a follower.
UNIT = 128
LOOSER = 20
#: Times that sets which aren't alike their leader are given another one.
ROUNDS = 2
#: Buckets of the shingle counts that give the order; any order gives the same links.
BUCKETS_LOG2 = 20
#: Ids up to which a table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_IDS = 100_000
#: Rows without doc_id come after all others.
LAST = (1 << 63) - 1
_WAYS = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the texts in a row, and where each text's begin (one more than texts).

    Words are runs of anything but the six ASCII separators, with A-Z lowered; fewer
    words than ``size`` make one shingle, none make none.  Works on the bytes of all texts at once.
    """
    h, starts = word_hashes(texts)
    per, n_words = np.diff(starts), len(h)
    if not n_words:
        return h, starts
    doc = np.repeat(np.arange(len(texts)), per)
    whole = np.zeros(n_words, dtype=np.uint64)
    for k in range(size):
        whole[: n_words - k] += h[k:] * _WAYS[k]
    real = np.repeat(starts[1:], per) - np.arange(n_words) >= size
    # few words: one shingle of them all, told apart by their number
    short = np.flatnonzero((per > 0) & (per < size))
    for i in short.tolist():
        s = starts[i]
        whole[s] = (h[s : s + per[i]] * _WAYS[8 : 8 + per[i]]).sum(dtype=np.uint64) + np.uint64(per[i])
        real[s] = True
    counts = np.bincount(doc[real], minlength=len(texts))
    return mix(whole[real]), np.concatenate([[0], np.cumsum(counts)])


def rows_of(docs: DataFrame) -> DataFrame:
    """doc (no doc_id: LAST), tk (a hash of the text) and text (null: empty) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tk"), text.alias("text"))


def bucket_counts(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How many shingles of all documents fall in each bucket; the table's size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64)
        for b in batches:
            texts = b["text"].to_pylist()
            for a, z in split(texts):
                h, _ = shingle_hashes(texts[a:z], shingle)
                total += np.bincount((h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), minlength=len(total))
        return total

    return array_sum(rows_of(docs).select("text"), count, 1 << BUCKETS_LOG2)


def _keys(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """48-bit keys in the index's order: the class, then 44 bits of the hash."""
    return (classes[(h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)] << np.uint64(44)) | (h >> np.uint64(20))


def _packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def sets(rows: DataFrame, classes: object, whole: bool, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc, tk, n (distinct shingles), node (a hash of the set) and keys: the indexed ones, or if ``whole`` all of them, six bytes each.

    ``classes``: a broadcast of order_classes().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = classes.value
        for b in batches:
            texts = b["text"].to_pylist()
            for a, z in split(texts):
                h, at = shingle_hashes(texts[a:z], shingle)
                n, node, keys = [], [], []
                for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.unique(h[s:e])
                    n.append(len(own))
                    node.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                    k = np.sort(_keys(own, by))
                    keys.append(_packed(k) if whole else k[: prefix_length(len(k), percent)].astype(np.int64))
                some = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([some["doc"], some["tk"], pa.array(n, pa.int64()), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.binary() if whole else pa.list_(pa.int64()))], names=["doc", "tk", "n", "node", "keys"])
        trim()

    return rows.mapInArrow(run, f"doc long, tk long, n long, node long, keys {'binary' if whole else 'array<long>'}")


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of a set of n, the indexed keys: two sets that link share at least ``needed`` of these."""
    return min(n, n + (-percent * n // 100) + 1 + n // EXTRA) if n else 0


def needed(n: Column, percent: int = PERCENT) -> Column:
    """Indexed keys that a set of n shares with any set that it links with; that set has at least ``percent`` of n."""
    return 1 + F.floor(F.ceil(n * percent / 100) / EXTRA)


def linked(x: int, y: int, both: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (x + y - both)


_COMPARED = "a long, b long, both long, na long, nb long, link boolean, added binary, removed binary"


def compared(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """For pairs of nodes (a, b): their sizes, how many shingles they have in common, and whether they link; if they are alike, what a adds to b and what it lacks.

    A b that many share is no hot task: Spark splits such a join's other side.
    """
    rows = pairs.join(whole.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a").join(whole.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b").select("a", "b", "ka", "kb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, na, nb, link, added, removed = [], [], [], [], [], []
            for ra, rb in zip(batch["ka"], batch["kb"], strict=True):
                x, y = _unpacked(ra.as_py()), _unpacked(rb.as_py())
                common = _in(x, y)
                n = int(common.sum())
                alike = linked(len(x), len(y), n, percent - LOOSER)
                link.append(linked(len(x), len(y), n, percent))
                both.append(n)
                na.append(len(x))
                nb.append(len(y))
                added.append(_packed(x[~common]) if alike else None)
                removed.append(_packed(y[~_in(y, x)]) if alike else None)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *(pa.array(c, pa.int64()) for c in (both, na, nb)), pa.array(link, pa.bool_()), pa.array(added, pa.binary()), pa.array(removed, pa.binary())], names=["a", "b", "both", "na", "nb", "link", "added", "removed"])
        trim()

    return rows.mapInArrow(run, _COMPARED)


def _in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which keys of x stand in y; both in order."""
    if not len(y):
        return np.zeros(len(x), dtype=bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _signs(added: list[bytes], removed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(follower, key, +1 or -1) of all keys by which followers differ from their leader."""
    parts = [(i, _unpacked(r), sign) for sign, side in ((1, added), (-1, removed)) for i, r in enumerate(side)]
    who = np.concatenate([np.full(len(k), i) for i, k, _ in parts])
    return who, np.concatenate([k for _, k, _ in parts]), np.concatenate([np.full(len(k), s) for _, k, s in parts])


def derived(both: int, x: np.ndarray, w: np.ndarray, one: tuple, two: tuple, n_one: int, n_two: int) -> np.ndarray:
    """The common shingles of each follower of leader x with each of leader w, from the leaders' ``both`` and the followers' differences.

    ``one`` and ``two``: _signs() of the followers.
    """
    counts = np.full((n_one, n_two), both, dtype=np.int64)
    (who1, key1, sign1), (who2, key2, sign2) = one, two
    counts += np.bincount(who1, weights=sign1 * _in(key1, w), minlength=n_one).astype(np.int64)[:, None]
    counts += np.bincount(who2, weights=sign2 * _in(key2, x), minlength=n_two).astype(np.int64)[None, :]
    # keys in which followers of either side differ
    shared = np.intersect1d(key1, key2)
    if len(shared):
        d1, d2 = np.zeros((n_one, len(shared)), dtype=np.float32), np.zeros((n_two, len(shared)), dtype=np.float32)
        for d, who, key, sign in ((d1, who1, key1, sign1), (d2, who2, key2, sign2)):
            use = _in(key, shared)
            d[who[use], np.searchsorted(shared, key[use])] = sign[use]
        counts += np.rint(d1 @ d2.T).astype(np.int64)
    return counts


def _groups(mask: np.ndarray) -> list[np.ndarray]:
    """The connected groups (two or more) of a symmetric matrix of links."""
    out, free = [], mask.any(axis=1)
    while free.any():
        seen = np.zeros(len(mask), dtype=bool)
        front = np.zeros(len(mask), dtype=bool)
        front[int(free.argmax())] = True
        while front.any():
            seen |= front
            front = mask[front].any(axis=0) & ~seen
        out.append(np.flatnonzero(seen))
        free &= ~seen
    return out


def _derive(pairs: DataFrame, rows: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the linked members of each pair of rows (row1, row2, both): a star for each group, not all its pairs."""
    for k in (1, 2):
        side = rows.select(F.col("row").alias(f"row{k}"), F.col("unit").alias(f"unit{k}"), F.col("members").alias(f"members{k}"))
        keys = whole.select(F.col("node").alias(f"unit{k}"), F.col("keys").alias(f"keys{k}"))
        pairs = pairs.join(side, f"row{k}").join(keys, f"unit{k}")
    pairs = pairs.select("both", "keys1", "keys2", "members1", "members2")

    def links(r: dict) -> list[tuple[int, int]]:
        sides = [r["members1"], r["members2"]]
        signs = [_signs([m["added"] for m in side], [m["removed"] for m in side]) for side in sides]
        n1, n2 = (np.array([m["n"] for m in side]) for side in sides)
        counts = derived(r["both"], _unpacked(r["keys1"]), _unpacked(r["keys2"]), *signs, len(n1), len(n2))
        hit = 100 * counts >= percent * (n1[:, None] + n2[None, :] - counts)
        # rows and columns with a link, as one graph
        i, j = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        mask = np.zeros((len(i) + len(j),) * 2, dtype=bool)
        mask[: len(i), len(i) :] = hit[np.ix_(i, j)]
        mask |= mask.T
        nodes = [sides[0][x]["node"] for x in i.tolist()] + [sides[1][x]["node"] for x in j.tolist()]
        return [(nodes[x], nodes[g[0]]) for g in _groups(mask) for x in g[1:].tolist() if nodes[x] != nodes[g[0]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = links({c: batch[c][i].as_py() for c in batch.schema.names})
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        trim()

    return pairs.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for all nodes of the links (a, b); labels spread and jump until nothing changes."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("node"), "l"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("l").alias("was"), F.least("l", "near").alias("l"))
        jump = labels.select(F.col("node").alias("l"), F.col("l").alias("up"))
        now = written(spread.join(jump, "l", "left").select("node", "was", F.least("l", F.coalesce("up", "l")).alias("l")))
        if now.filter("l < was").isEmpty():
            return now.select("node", F.col("l").alias("component"))
        labels = now.select("node", "l")


def _small(df: DataFrame) -> DataFrame:
    """A written table as a broadcast side if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _posts(nodes: DataFrame, percent: int) -> DataFrame:
    """node, n, pos, key and c (nodes that have the key) of the index, without keys and nodes that lead nowhere."""
    posts = nodes.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    keys = written(nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    posts = written(posts.join(_small(keys), "key"))
    for last in (False, True):
        enough = posts.groupBy("node").agg(F.count("*").alias("m"), F.first("n").alias("size")).filter(F.col("m") >= needed(F.col("size"), percent)).select("node")
        posts = posts.join(enough, "node", "left_semi")
        posts = written(posts) if last else posts.join(posts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key")
    return posts


def _units(posts: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """unit (a leader), node, n, link (with the leader), and what the node adds to its leader and lacks, for all nodes of the index."""
    # a set's home: the key that most sets share
    home = posts.groupBy("node", "n").agg(F.max_by("key", F.struct(F.col("c"), -F.col("key"))).alias("home"))
    left = written(home.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")))
    none = F.lit(b"")
    out = None

    def add(df: DataFrame) -> DataFrame:
        return df if out is None else out.unionByName(df)

    def alone(df: DataFrame) -> DataFrame:
        return df.select(F.col("node").alias("unit"), "node", "n", F.lit(True).alias("link"), none.alias("added"), none.alias("removed"))

    for _ in range(ROUNDS):
        leaders = left.groupBy("home", "size").agg(F.min("node").alias("unit"))
        dealt = written(left.join(leaders, ["home", "size"]))
        got = written(compared(dealt.filter("node != unit").select(F.col("node").alias("a"), F.col("unit").alias("b")), whole, percent).filter("added IS NOT NULL"))
        out = add(got.select(F.col("b").alias("unit"), F.col("a").alias("node"), F.col("na").alias("n"), "link", "added", "removed"))
        out = add(alone(dealt.filter("node = unit")))
        left = written(dealt.filter("node != unit").drop("unit").join(got.select(F.col("a").alias("node")), "node", "left_anti"))
        if left.isEmpty():
            return written(out)
    return written(add(alone(left)))


def _meetings(posts: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """Pairs of units (a < b) whose blocks meet in the index lists, from sizes and positions that leave the threshold in reach."""
    at = posts.join(units.select("node", "unit"), "node").groupBy("key", "unit").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("pos"))
    x, y = (at.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("unit", "lo", "hi", "pos")]) for k in (1, 2))
    reach = F.least(F.col("hi1") - F.col("pos1"), F.col("hi2") - F.col("pos2")) * (100 + percent) >= percent * (F.col("lo1") + F.col("lo2"))
    sizes = (F.col("hi1") * 100 >= F.col("lo2") * percent) & (F.col("hi2") * 100 >= F.col("lo1") * percent)
    both = x.join(y, "key").filter((F.col("unit1") < F.col("unit2")) & sizes).groupBy(F.col("unit1").alias("a"), F.col("unit2").alias("b"))
    # at the first key that two linked sets share the threshold is in reach; further keys only count
    both = both.agg(F.bool_or(reach).alias("reach"), F.count("*").alias("m"), F.min(F.least("lo1", "lo2")).alias("lo"))
    return both.filter(F.col("reach") & (F.col("m") >= needed(F.col("lo"), percent))).select("a", "b")


def _rows(units: DataFrame) -> DataFrame:
    """Members of a unit in rows of bounded size: row (its id), unit, link, first (of its unit), members, and the least size and the most that a member adds.

    Members that link with their leader stand in rows of their own: they are in one component.
    """
    counted = units.groupBy("unit", "link").agg(F.count("*").alias("c"))
    dealt = units.join(counted, ["unit", "link"]).withColumn("part", F.when(F.col("node") == F.col("unit"), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / UNIT))))
    members = F.collect_list(F.struct("node", "n", "added", "removed"))
    rows = dealt.groupBy("unit", "link", "part").agg(members.alias("members"), F.min("n").alias("lo"), F.max(F.length("added") / 6).alias("most"), F.max(F.when(F.col("node") == F.col("unit"), F.col("n"))).alias("n_leader"))
    return written(rows.withColumn("row", F.xxhash64("unit", "link", "part")).withColumn("first", F.col("n_leader").isNotNull()))


def _known(rows: DataFrame, of: DataFrame) -> DataFrame:
    """row and its least and greatest component."""
    nodes = rows.select("row", F.explode("members.node").alias("node"))
    return nodes.join(of, "node", "left").withColumn("c", F.coalesce("component", "node")).groupBy("row").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))


def _links(posts: DataFrame, units: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the links of all pairs of sets connect."""
    rows = _rows(units)
    met = written(compared(written(_meetings(posts, units, percent)), whole, percent).drop("added", "removed"))
    links = units.filter("link AND node != unit").select(F.col("node").alias("a"), F.col("unit").alias("b")).unionByName(met.filter("link").select("a", "b"))
    # rows of followers that don't link with their leader: with themselves and with the leader's row
    loose = rows.filter("NOT link").select("row", "unit")
    heads = rows.filter("first").select("unit", F.col("row").alias("head"), F.col("n_leader").alias("both"))
    near = loose.join(heads, "unit")
    near = near.select(F.col("row").alias("row1"), F.explode(F.array("row", "head")).alias("row2"), "both")
    links = written(links.unionByName(_derive(near, rows, whole, percent)))
    if links.isEmpty():
        known = units.select("node", F.col("node").alias("component")).limit(0)
    else:
        known = components(links)
    # all other pairs of rows that the threshold leaves in reach and that aren't in one component yet
    told = written(rows.join(_known(rows, known), "row").select("row", "unit", "link", "first", "lo", "most", "c_lo", "c_hi", F.size("members").alias("size")))
    sides = [told.select(*[F.col(c).alias(f"{c}{k}") for c in told.columns]) for k in (1, 2)]
    open_ = "(c_lo1 != c_hi1 OR c_lo2 != c_hi2 OR c_lo1 != c_lo2)"
    same = sides[0].filter("NOT link1").join(sides[1].withColumnRenamed("unit2", "unit1"), "unit1").filter(f"{open_} AND row1 != row2 AND NOT first2 AND (link2 OR row1 < row2)")
    same = same.join(heads.select(F.col("unit").alias("unit1"), "both"), "unit1").select("row1", "row2", "both")
    reach = (F.col("both") + F.col("most1") + F.col("most2")) * (100 + percent) >= percent * (F.col("lo1") + F.col("lo2"))
    other = met.select(F.col("a").alias("unit1"), F.col("b").alias("unit2"), "both").join(sides[0], "unit1").join(sides[1], "unit2")
    # two leaders without followers have been compared
    other = other.filter(reach & F.expr(f"{open_} AND (size1 > 1 OR size2 > 1 OR NOT first1 OR NOT first2)")).select("row1", "row2", "both")
    more = _derive(written(same.unionByName(other)), rows, whole, percent)
    return written(known.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a != b").unionByName(more))


def grouped(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc, tk, n, node, and the component's least document as first (doc and tk; null for rows without shingles) of every row."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(order_classes(bucket_counts(docs, shingle)))
    base = written(sets(rows_of(docs), classes, False, shingle, percent))
    nodes = base.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc", "tk")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = written(nodes.select("node", "rep.doc", "rep.tk", "n", "keys"))
    posts = _posts(nodes, percent)
    met = written(posts.select("node").distinct().join(nodes.select("node", "doc", "tk"), "node").select("doc", "tk"))
    whole = sets(rows_of(docs).join(_small(met), ["doc", "tk"]), classes, True, shingle, percent)
    whole = written(whole.groupBy("node").agg(F.first("keys").alias("keys")))
    units = _units(posts, whole, percent)
    links = _links(posts, units, whole, percent)
    named = nodes.select("node", "doc", "tk")
    if links.isEmpty():
        firsts = named.select("node", F.struct("doc", "tk").alias("first"))
    else:
        named = named.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min(F.struct("doc", "tk")).alias("first"))
        firsts = written(named.join(least, "component").select("node", "first"))
    return base.select("doc", "tk", "n", "node").join(firsts, "node", "left")


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; other columns are ignored, whatever their names.

    Texts that are null, empty or without words have no shingles and stay alone.
    Repeated rows get equal answers; rows of one doc_id with different texts are
    different sets.  A row without doc_id has no component_id unless it is linked
    with a numbered one.
    """
    doc = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return grouped(docs, shingle, percent).select(doc("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(doc("first.doc"), doc("doc")).alias("component_id"))


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest doc_id, with all its columns; its exact repetitions are the same document."""
    rest = grouped(docs, STAGE_SHINGLE, STAGE_PERCENT).filter("first.doc != doc OR first.tk != tk").select("doc", "tk").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = _small(written(rest).select(F.col("doc").alias(fresh("doc", docs.columns)), F.col("tk").alias(fresh("tk", docs.columns))))
    own = gone.columns
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == gone[own[0]]) & (F.xxhash64(text) == gone[own[1]])
    return docs.join(gone, same, "left_anti")
