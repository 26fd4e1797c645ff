"""Documents that are awkward: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "_row int, kept boolean, `_id.x` string, ids string, _size int"
)
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "s1"),
    (2, "alpha BETA gamma delta epsilon zeta", "en", "s2"),
    (3, None, "en", "s1"),
    (4, "", None, None),
    (5, " \t\n", "de", None),
    (6, LONG, "en", "s1"),
    (7, "one", "fr", "s3"),
    (7, "one", "fr", "s3"),
    (7, "another text with the same id as a different one", "fr", "s3"),
    (None, "no id at all here in this text", "es", "s1"),
    (None, "alpha beta gamma delta epsilon zeta", "es", "s2"),
    (9, "É ñandú 日本語 🎉 <|endoftext|> it's x" * 3, None, "sé"),
    (10, "a" * 5000, "en", ""),
]


def edge_docs(spark):
    rows = [
        (i, t, lang, s, len(t) if t is not None else None, 1, True, "z", "q", n)
        for n, (i, t, lang, s) in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()
