"""Small inputs that every operator has to take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, block long"


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names operators use themselves."""
    words = " ".join(f"word{i % 700}" for i in range(30_000))
    rows = [
        (1, "plain text of a few words, no more than that here", "en", "s", 5, "r", 0.1, 1),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "r", 0.2, 2),
        (None, "a text without an id that has some words in it", "en", "s", 1, "r", 0.3, 3),
        (4, words, "en", "s", 9, "r", 0.4, 4),
        (5, "plain text of a few words, no more than that here", "en", "s", 5, "r", 0.1, 1),
        (5, "plain text of a few words, no more than that here", "en", "s", 5, "r", 0.1, 1),
        (6, " \n\t\r\n ", "de", "s", 2, "r", 0.5, 5),
        (7, "naïve façade, 東京 and 🙂 — “quoted” <|endoftext|> text", "fr", "s", 3, "r", 0.6, 6),
    ]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
