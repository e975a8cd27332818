"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document.  The ledger keeps what was
measured and one bit for each failed rule, so a policy (any set of rules) or an
ablation is a bitwise expression over one integer column; the texts are not
read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import GAP, ids_and_text, table

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Bit of each rule in the ledger; bits are never reused, so old ledgers stay readable.
BITS = {"few_words": 0, "repeated_words": 1, "many_symbols": 2, "repeated_lines": 3, "long_words": 4, "short_words": 5, "shouting": 6}


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document under a name and version."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
DEFAULT = Policy("default", 1, tuple(BITS))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row: a lambda's variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column, n: Column) -> Column:
    """Words covered by windows of eight that occur twice or more."""

    def positions(pairs: Column) -> Column:
        # pairs is sorted by (hash, start): a window is repeated if a neighbour has its hash
        last = F.size(pairs) - 1
        same = lambda a, i, j: F.get(pairs, j).getField("h") == a.getField("h")
        return F.array_sort(F.transform(F.filter(pairs, lambda a, i: F.coalesce((i > 0) & same(a, i, i - 1), F.lit(False)) | F.coalesce((i < last) & same(a, i, i + 1), F.lit(False))), lambda a: a.getField("i")))

    def covered(starts: Column) -> Column:
        return F.coalesce(F.aggregate(F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x), F.lit(0))

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, positions), covered))

    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(n < WINDOW, F.lit(0)).otherwise(let(let(words, hashes), of)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of its whole text (no text: all zero).

    Equal doc_ids stay separate rows; columns besides doc_id and text are ignored.
    """
    d = ids_and_text(docs).withColumn("words", F.array_remove(F.split("text", GAP), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.col("words")
    return d.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"))).alias("line"),
        _repeated(words, F.size(words)).alias("n_repeat_words"),
        F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", F.col("line.dup").alias("n_dup_lines"), "n_repeat_words", F.col("line.n").alias("n_lines"), "n_upper")


def _rules() -> dict[str, Column]:
    """Whether each rule fails, from the measurements alone; in whole numbers, so no rounding decides."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": n < 20,
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * n,
        "many_symbols": 10 * F.col("n_symbols") > 2 * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "long_words": chars > 14 * n,
        "short_words": chars < 2 * n,
        "shouting": 100 * F.col("n_upper") > 60 * chars,
    }


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with ``failed``: one bit for each rule that the document fails."""
    bits = [F.when(fails, F.lit(1 << BITS[name])).otherwise(0) for name, fails in _rules().items()]
    return measures(docs).withColumn("failed", sum(bits[1:], bits[0]).cast("int"))


def apply_policy(rows: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    """Adds whether the policy keeps each document of a ledger; repeated rows get equal answers, an empty ledger stays empty."""
    return rows.withColumn(column, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail it alone, and are kept without it.

    One aggregation over the ledger, combined within tasks; an empty ledger gives zeros.
    """
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    aggs = []
    for r in policy.rules:
        bit = 1 << BITS[r]
        aggs += [F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{r}"), F.count_if(hit == bit).alias(f"o_{r}"), F.count_if(hit.bitwiseAND(F.lit(policy.mask & ~bit)) == 0).alias(f"k_{r}")]
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failed"), F.col(f"o_{r}").alias("failed_alone"), F.col(f"k_{r}").alias("kept_without")) for r in policy.rules])).alias("x")).select("x.*")


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), BASE, "base_kept"), DEFAULT)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


_RULES_SQL = """
  (n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 2 * n_words)::INT
  + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars > 14 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT + 64 * (100 * n_upper > 60 * word_chars)::INT
"""

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
st AS (SELECT doc_id, unnest(range(0, len(words) - 7)) AS i, words FROM w WHERE len(words) >= 8),
g AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 8], ' ') AS g FROM st),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(lines) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, ({_RULES_SQL})::INT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) != 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
