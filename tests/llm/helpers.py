"""Small tables that hold the awkward rows, shared by the tests of the corpus operators."""

import duckdb

#: (doc_id, text): null, empty, blank, one word, repeats, ties, control and non-ASCII characters, a long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "same text here"), (6, "same text here"), (7, "a\x0bb\x0cc\r\nd"),
    (8, "élan “ÉTÉ” ñandú 日本語 😀 x"), (9, "x" * 50_000), (10, ("line of words number one two three four five.\n" * 400)),
    (11, "\n\n\nlast line"), (12, "A B C D E F G H " * 30), (13, "tab\tand nbsp"),
]


def odd_documents(spark, extra=()):
    """ODD as documents with clashing extra columns."""
    rows = [(i, t, "en", "s", None, "clash", 0.5) for i, t in [*ODD, *extra]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double")


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def texts(sf_dir):
    return dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
