"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"Word{i % 997} and {i * 7919 % 10007}." for i in range(12000))
SAME = "The same nine words stand in this short text."
EDGE = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "One two"), (5, SAME), (6, SAME), (7, SAME), (7, SAME), (8, "the SAME nine words stand in this short text."),
    (None, "A text without an id, said only once."), (9, LONG), (10, LONG + " tail"), (11, "é 漢字 😀 x" * 40), (12, "a" * 5000), (-3, "Negative id. Next.\nLine two."),
]
CLASH = ("ids", "n", "h", "g", "score", "label", "comp", "block", "sid", "part", "base", "n_lines", "offset", "train", "_bucket", "lang")


def edge_docs(spark, rows=EDGE):
    """The rows with extra columns whose names the operators use for their own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def documents(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
