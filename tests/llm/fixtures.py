"""Small document tables with every awkward case."""

#: Names that operators use inside, as they are and with the endings that once kept them apart.
CLASHES = "part released items share score left bits ranges key keys n sig rep node component run shard at block text_id held_out".split()
CLASHES += [f"{c}__" for c in ("part", "released", "items", "share", "score", "left")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, predicted int, failed int, `a.b c` string, " + ", ".join(f"{c} int" for c in CLASHES)


def odd_docs(spark, texts):
    """Rows of documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "s", 0, 7, 1, None, *[1] * len(CLASHES)) for i, t in texts], DOCS)


WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 4).split()
TEXTS = [
    (0, None),
    (1, ""),
    (2, "   \n\t "),
    (3, "one"),
    (4, " ".join(WORDS[:40])),
    (5, " ".join(WORDS[:40])),
    (6, " ".join(WORDS[:39]) + " changed"),
    (7, "UPPER!! CASE!! " * 30),
    (8, "é ß    x\x1cy \r\n <|endoftext|> don't"),
    (9, "a b c d e f g h " * 2500),
    (10, "line one here\nline one here\n\nline two | with # symbols & more\n" * 3),
    (10, "line one here\nline one here\n\nline two | with # symbols & more\n" * 3),
    (10, "another text under a number that is taken " + " ".join(WORDS[40:70])),
    (None, "a row without a number " + " ".join(WORDS[:30])),
    (None, None),
]
