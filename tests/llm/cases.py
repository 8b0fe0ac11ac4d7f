"""Small inputs that every operator must handle."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, hits string, cid long, n int"

LONG = " ".join(f"word{i % 701}x{i % 89}" for i in range(30_000))
#: Nulls in every column, empty and very long texts, ties and repeated rows, columns named like inner ones.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 77, "r", "h", 5, 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 77, None, None, None, None),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 77, None, None, None, None),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "", "", 0, 0),
    (5, " \t\n ", "fr", "b", 4, "", "", 0, 0),
    (6, LONG, "en", "b", len(LONG), "", "", 0, 0),
    (None, "a row without an id but with a text of more than ten words in all", "en", None, 65, "", "", 0, 0),
    (7, "12345 !!! ###", "en", "b", 13, "", "", 0, 0),
    (7, "the same id with another text of some words, nothing else at all", None, "b", 64, "", "", 0, 0),
    (8, "Žluťoučký kůň 日本語 🎉 é", "cs", "b", 23, "", "", 0, 0),
    (-9, "one", "en", "b", 3, "", "", 0, 0),
]


def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
