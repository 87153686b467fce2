"""Rows that every operator must stand: nulls, empty and long texts, repeated rows, clashing column names."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 20_000

ODD_TEXTS = [
    (1, "A plain text with some words in it, and more."),
    (1, "A plain text with some words in it, and more."),
    (2, None),
    (3, ""),
    (None, "no id but a text that is here"),
    (None, None),
    (4, LONG),
    (5, "😀 漢字 ñ \x00 \t\r\n\x0b end"),
    (6, "x"),
]


def odd(spark):
    """The rows with extra columns named like those the operators make."""
    df = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(("node", "row", "row2", "_row", "_kinds", "label", "spans_", "key", "n", "h"))])


def empty(spark):
    return odd(spark).where("false")
