"""Rows that every operator on documents must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today.", "a"), (2, "the QUICK brown fox jumps over the lazy dog today.", "b"),
    (3, "", None), (4, None, "c"), (5, LONG, "d"), (6, LONG.upper(), "e"), (7, "É A é a", "f"), (8, "é a é a", "g"),
    (9, "one two", "h"), (9, "one two", "h"), (9, "three four five six", "i"), (None, "one two", "j"), (None, None, None),
    (10, "   \n\t ", "k"), (11, "x", "l"), (12, "Ünïcödé 漢字 😀 </s> <s> [INST] \\ \x00 end", "m"),
]
COLUMNS = "doc_id long, text string, {} string"


def documents(spark, extra: str = "norm"):
    return spark.createDataFrame(ROWS, COLUMNS.format(extra)).repartition(3)


def ascii_lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
