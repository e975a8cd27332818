"""License scans by diagonal voting, in DataFrame functions only.

Templates are short texts: exact ones that must stand word for word, and notices
that may be changed a little.  All rolling word k-grams of all documents are
hashed and joined with the templates' positions.  A pair of positions votes for
its diagonal (place in the document less place in the template); votes are
gathered by document, template and diagonal; neighbouring diagonals, which
inserted or lost words leave, are merged to spans; and a span counts if enough
of the template's words are proved by equal k-grams on it.

Each document also sends one row that marks its end, so one pass and one shuffle
(of votes, not of texts) give a result for documents without votes too.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import ids_and_text, table

#: What stands between words, once A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a notice's k-grams.
WIDTH = 3
#: Share of a template's words that a span must prove, in hundredths.
NEED = 70


@dataclass(frozen=True)
class Template:
    """A text to find: an ``exact`` one stands word for word and may be of any length from two words, others have WIDTH words at least.

    Places of ``base`` texts are counted.
    """

    label: str
    text: str
    exact: bool = False
    base: bool = False

    @property
    def width(self) -> int:
        return len(self.text.split()) if self.exact else WIDTH


#: The phrases of the contract.
PHRASES = [
    Template("cc-by", "cc by", True, True),
    Template("gpl", "general public license", True, True),
    Template("reserved", "all rights reserved", True, True),
]
#: Sentences of widely used public notices, and two names that differ by a word.
NOTICES = [
    Template("cc-by-nc", "cc by nc", True),
    Template("cc-by-sa", "cc by sa", True),
    Template("apache", "licensed under the apache license version"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "this work is licensed under the gnu general public license version"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]
TEMPLATES = PHRASES + NOTICES
#: A longer list of templates is joined without a broadcast.
BROADCAST_WORDS = 100_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), GAP), "")


def _gram(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, at + i) for i in range(width)])


def _positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """A row for each k-gram of each template, and one (t = -1) that only the end of a document meets."""
    for t in templates:
        if len(t.text.split()) < max(2, t.width):
            raise ValueError(f"too short a template: {t.text}")
    rows = [F.struct(F.lit(i).alias("t"), F.lit(t.text).alias("text"), F.lit(t.width).alias("width")) for i, t in enumerate(templates)]
    w = F.col("w")
    h = F.lit(None).cast("long")
    for width in sorted({t.width for t in templates}):
        h = F.when(F.col("width") == width, _gram(w, F.col("tpos"), width)).otherwise(h)
    grams = (
        spark.range(1)
        .select(F.inline(F.array(*rows)))
        .withColumn("w", words_of(F.col("text")))
        .withColumn("tpos", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("width"))))
        .select("t", "tpos", "width", h.alias("h"), F.array_join(F.slice("w", F.col("tpos") + 1, F.col("width")), " ").alias("gram"))
    )
    end = spark.range(1).select(F.lit(-1).alias("t"), F.lit(0).alias("tpos"), F.lit(0).alias("width"), F.xxhash64(F.lit(0)).alias("h"), F.lit("").alias("gram"))
    return grams.unionByName(end)


def votes(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, key, n, t, tpos, pos: equal k-grams of documents (null text: empty) and templates.

    ``key`` tells rows of one doc_id apart by their text; ``n`` are the words.
    t is -1 in the one row of each document that marks its end.
    """
    spark = docs.sparkSession
    widths = sorted({t.width for t in templates})
    d = ids_and_text(docs).select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    d = d.withColumn("n", F.size("words")).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n"))))
    end = F.when(F.col("pos") == F.col("n"), F.xxhash64(F.lit(0)))
    hashes = [F.coalesce(end, _gram(F.col("words"), F.col("pos"), widths[0])), *[_gram(F.col("words"), F.col("pos"), w) for w in widths[1:]]]
    d = d.withColumn("h", F.explode(F.array(*hashes)))
    p = _positions(spark, templates)
    if sum(len(t.text.split()) for t in templates) <= BROADCAST_WORDS:
        p = F.broadcast(p)
    # hashes find, words prove; told so that it doesn't become a key to compute for every k-gram
    proved = F.coalesce(F.array_join(F.slice("words", F.col("pos") + 1, F.col("width")), " ") == F.col("gram"), F.lit(False))
    return d.join(p, "h").filter(proved).select("doc_id", "key", "n", "t", "tpos", "pos")


def _proved(places: Column, width: Column) -> Column:
    """How many of a template's words the k-grams at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda t: F.sequence(t, t + width - 1)))))


def _about(templates: list[Template], of, kind: str) -> Column:
    """A value of a row's template."""
    return F.get(F.array(*[F.lit(of(t)).cast(kind) for t in templates]), F.col("t"))


def slack(t: Template) -> int:
    """How far apart diagonals are merged: an eighth of a notice's words, one at least."""
    return 0 if t.exact else max(1, len(t.text.split()) // 8)


_DOC = ["doc_id", "key", "n"]


def spans(found: DataFrame, templates: list[Template] = TEMPLATES, need: int = NEED) -> DataFrame:
    """Spans of ``votes``: doc_id, key, n, t, first (word), last (word behind), score; and documents' ends (t is -1) with how many rows are alike."""
    diagonals = found.repartition(*_DOC).groupBy(*_DOC, "t", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("places"), F.count("*").alias("rows"))
    width, length = _about(templates, lambda t: t.width, "int"), _about(templates, lambda t: len(t.text.split()), "int")
    by = Window.partitionBy(*_DOC, "t").orderBy("diagonal")
    starts = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > _about(templates, slack, "int"), F.lit(True))
    marked = diagonals.withColumn("starts", starts.cast("int")).withColumn("span", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    each = marked.select(*_DOC, "t", "span", "places", "rows", width.alias("width"), length.alias("length"), (F.col("diagonal") + F.array_min("places")).alias("first"), (F.col("diagonal") + F.array_max("places") + width).alias("last"))
    merged = each.groupBy(*_DOC, "t", "span", "width", "length").agg(
        F.flatten(F.collect_list("places")).alias("places"),
        F.max(_proved(F.col("places"), F.col("width"))).alias("alone"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max("rows").alias("rows"),
    )
    # words between the first and the last proved one that the template lacks count against a span; one diagonal alone has none
    together = _proved(F.col("places"), F.col("width")) / F.greatest("length", F.col("last") - F.col("first"))
    scored = merged.withColumn("score", F.greatest(together, F.col("alone") / F.col("length")))
    return scored.filter((F.col("t") < 0) | (F.col("score") * 100 >= need)).select(*_DOC, "t", "first", "last", "score", "rows")


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, need: int = NEED) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts places of base phrases, first_word and last_word are their smallest
    and largest starts (null without one).  score is the best of all spans: the
    share of a template's words that the span proves (an exact one has 1).
    Null and empty texts have no words and labels; equal rows are repeated in the
    result; rows of one doc_id and other texts stay apart; other columns are ignored.
    """
    found = spans(votes(docs, templates), templates, need)
    base = F.coalesce(_about(templates, lambda t: t.base, "boolean"), F.lit(False)) & (F.col("t") >= 0)
    label = F.when(F.col("t") >= 0, _about(templates, lambda t: t.label, "string"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = found.groupBy(*_DOC).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("first").cast("long"))).alias("last_word"),
        joined(F.when(base, label)).alias("base_labels"),
        joined(label).alias("labels"),
        F.coalesce(F.max(F.when(F.col("t") >= 0, F.col("score"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("t") < 0, F.col("rows"))).cast("int").alias("rows"),
    )
    out = out.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("rows"))))
    return out.select("doc_id", F.col("n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def sql(templates: list[Template] = TEMPLATES, need: int = NEED) -> str:
    """The same for DuckDB: k-grams are joined as words, not as hashes."""
    rows = ", ".join(f"({i}, '{t.label}', string_split('{t.text}', ' '), {t.width}, {str(t.base).lower()}, {slack(t)})" for i, t in enumerate(templates))
    grams = " UNION ALL ".join(f"SELECT rid, array_to_string(words[i + 1:i + {w}], ' ') AS gram, i FROM (SELECT rid, words, unnest(range(len(words) - {w - 1})) AS i FROM d)" for w in sorted({t.width for t in templates}))
    cover = "len(list_distinct(flatten(list_transform({}, lambda p: range(p, p + width)))))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t(t, label, w, width, base, slack) AS (VALUES {rows}),
tg AS (SELECT t, tpos, array_to_string(w[tpos + 1:tpos + width], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - width + 1)) AS tpos FROM t)),
dg AS ({grams}),
diag AS (SELECT rid, t, i - tpos AS diagonal, list_distinct(list(tpos)) AS places FROM dg JOIN tg USING (gram) GROUP BY ALL),
st AS (SELECT diag.*, width, len(w) AS length, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, t ORDER BY diagonal) > slack, true)::INT AS s FROM diag JOIN t USING (t)),
sp AS (SELECT *, sum(s) OVER (PARTITION BY rid, t ORDER BY diagonal) AS span, {cover.format("places")} AS alone, diagonal + list_min(places) AS f, diagonal + list_max(places) + width AS l FROM st),
m AS (SELECT rid, t, span, width, length, flatten(list(places)) AS places, max(alone) AS alone, min(f) AS f, max(l) AS l FROM sp GROUP BY ALL),
sc AS (SELECT rid, t, f, greatest({cover.format("places")} / greatest(length, l - f), alone / length) AS score FROM m),
ok AS (SELECT rid, f, score, label, base FROM sc JOIN t USING (t) WHERE score * 100 >= {need}),
x AS (SELECT rid, count(*) FILTER (base) AS n_base, min(f) FILTER (base) AS first_word, max(f) FILTER (base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score FROM ok GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score FROM d LEFT JOIN x USING (rid)
"""
