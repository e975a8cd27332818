"""License scans against plain searches and the SQL."""

import re

import duckdb
import pandas as pd

from fixtures import TEXTS, odd_docs
from gridspark.llm import licenses
from gridspark.llm.licenses import NOTICES, PHRASES, Template

MIT = next(t.text for t in NOTICES if t.label == "mit" and len(t.text) > 60)
BSD = next(t.text for t in NOTICES if t.label == "bsd")


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _base(text):
    w = _words(text)
    places = [(i, t.label) for t in PHRASES for i in range(len(w)) if w[i : i + len(t.text.split())] == t.text.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


EXTRA = [
    (20, "Licensed under CC BY-NC 4.0. CC-BY cc by! All rights\nreserved. all   rights reserved"),
    (21, "GNU GENERAL PUBLIC LICENSE general public; license General_Public-License"),
    (22, "İ all rights reserved é cc by ſ"),  # only A-Z are lowered
    (23, "x " * 50 + MIT.upper() + " y" * 50),
    (24, "before " + MIT.replace("free of charge", "free of any charge whatsoever").replace("copy of this", "copy of") + " after"),
    (25, "before " + " ".join(w if i % 3 else "other" for i, w in enumerate(MIT.split())) + " after"),
    (26, "z\n".join([BSD.replace(" ", "\n")] * 3) + " " + MIT),
    (27, "cc by " * 5000),
    (28, "released under the mit license. released under the apache license"),
    (29, "cc by sa"),
    (30, "all rights reserve d general public licenses cc bye acc by"),
    (31, "word " * 200_000 + "all rights reserved"),
    (20, "another row of number twenty, cc by"),
    (20, "another row of number twenty, cc by"),
    (None, "cc by"),
    (None, "cc by"),
]


def _scan(spark):
    return licenses.scan(odd_docs(spark, TEXTS + EXTRA)).collect()


def test_base(spark):
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in _scan(spark)), key=repr)
    assert got == sorted(((i, *_base(t)) for i, t in TEXTS + EXTRA), key=repr)


def test_notices(spark):
    by = {}
    for r in _scan(spark):
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "")
        by.setdefault(r["doc_id"], []).append((r["labels"], round(r["score"], 3)))
    assert ("cc-by,cc-by-nc,reserved", 1.0) in by[20]
    assert by[23] == [("mit", 1.0)]
    # three words more and one less leave diagonals side by side: they are one span
    assert by[24][0][0] == "mit" and 0.7 <= by[24][0][1] < 1
    assert by[25] == [("", 0.0)]  # no k-gram of it is left
    assert by[26] == [("bsd,mit", 1.0)]
    assert by[28] == [("mit", 1.0)] or by[28] == [("apache,mit", 1.0)]
    assert by[29] == [("cc-by,cc-by-sa", 1.0)]
    assert by[30] == [("", 0.0)]
    assert by[0] == by[1] == by[2] == [("", 0.0)]


def test_spans(spark):
    """Three copies of one notice are three spans."""
    docs = spark.createDataFrame([(1, f"a b c {BSD} d e {BSD} f {BSD}")], "doc_id long, text string")
    rows = licenses.spans(licenses.votes(docs)).filter("t >= 0").orderBy("first").collect()
    n = len(BSD.split())
    assert [(r["first"], r["last"], r["score"]) for r in rows] == [(3, 3 + n, 1.0), (5 + n, 5 + 2 * n, 1.0), (6 + 2 * n, 6 + 3 * n, 1.0)]


def test_empty_and_other_templates(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three x four five six")], "doc_id long, text string")
    assert licenses.scan(docs.limit(0)).count() == 0
    mine = [Template("own", "one two three four five six"), Template("pair", "x four", True, True)]
    got = {r["doc_id"]: r for r in licenses.scan(docs, mine, 60).collect()}
    assert (got[1]["labels"], got[1]["score"], got[2]["labels"], got[2]["n_base"], got[2]["first_word"]) == ("own", 1.0, "own,pair", 1, 3)


def test_long_list_of_templates(spark, monkeypatch):
    want = sorted(map(repr, _scan(spark)))
    monkeypatch.setattr(licenses, "BROADCAST_WORDS", 0)
    assert sorted(map(repr, _scan(spark))) == want


def test_native(spark):
    plan = licenses.QUERY(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


def test_sql(spark):
    rows = [r for r in TEXTS + EXTRA if r[0] != 31]  # its SQL copies the words for each of them
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    c = duckdb.connect()
    c.register("documents", docs)
    want = c.sql(licenses.sql())
    got = licenses.scan(odd_docs(spark, rows)).selectExpr(*[f"round({x}, 6) AS {x}" if x == "score" else x for x in want.columns]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
