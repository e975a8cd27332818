import re
import sys
import unicodedata
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import rules as R

MORE = [
    (20, "A " * 19),
    (21, "A " * 20),
    (22, "x y z " * 100_000),
    (23, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 " + " ".join(f"w{i}" for i in range(60))),
    (24, "same\nsame\n \nsame\nother " + "SHOUT " * 30),
    (25, "extraordinarilylongword " * 25),
    (26, "\x1c \x85     ÄÖÜ ß " * 10),
    (27, "\U0001f600 # * $ % & | < > [x] " * 12),
]
ROWS = TEXTS + MORE


def _brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    dup, upper = len(lines) - len(set(lines)), sum(unicodedata.category(c) == "Lu" for c in text)
    failed = [n < 20, 100 * len(repeated) > 30 * n, 10 * symbols > 2 * n, 100 * dup > 50 * len(lines), chars > 14 * n, chars < 2 * n, 100 * upper > 60 * chars]
    return n, chars, symbols, dup, len(repeated), sum(f << i for i, f in enumerate(failed))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed")
order = lambda rows: sorted(rows, key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    return R.ledger(odd_docs(spark, ROWS)).cache()


def test_ledger_equals_brute_force(rows):
    got = [tuple(r) for r in rows.select("doc_id", *NAMES).collect()]
    assert order(got) == order((i, *_brute(t)) for i, t in ROWS)


def test_policies_and_ablation(rows):
    masks = [_brute(t)[-1] for _, t in ROWS]
    for policy in (R.BASE, R.DEFAULT, R.Policy("lines", 2, ("repeated_lines", "shouting")), R.Policy("none", 1, ())):
        kept = R.apply_policy(rows, policy, "p").filter("p").count()
        assert kept == sum(m & policy.mask == 0 for m in masks)
        if policy.rules:
            got = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in R.ablation(rows, policy).collect()}
            for rule in policy.rules:
                bit, hits = 1 << R.BITS[rule], [m & policy.mask for m in masks]
                assert got[rule] == (sum(h & bit > 0 for h in hits), sum(h == bit for h in hits), sum(h & ~bit == 0 for h in hits)), rule


def test_empty_table(spark):
    none = R.ledger(odd_docs(spark, []))
    assert none.count() == 0
    assert {(r.failed, r.failed_alone, r.kept_without) for r in R.ablation(none, R.BASE).collect()} == {(0, 0, 0)}


def test_sql_of_the_query(spark, tmp_path):
    # DuckDB's plan copies a text's words for each window: its memory ends at the very long text, which the brute force covers
    odd_docs(spark, [r for r in ROWS if len(r[1] or "") < 200_000]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in R.QUERY(spark, str(tmp_path)).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept", "failed").collect()]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    # equal numbers with different texts share the windows of the SQL, so these are left to the brute force
    alone = {i for i, n in Counter(i for i, _ in ROWS).items() if n == 1}
    want = c.sql(f"SELECT doc_id, n_words, n_repeat_words, base_failed, kept, failed FROM ({R.SQL})").fetchall()
    assert order(r for r in got if r[0] in alone) == order(r for r in want if r[0] in alone)
