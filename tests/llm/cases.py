"""Rows that every operator must bear: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, tokens string, kept string, full string, target string"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(20_000))
TEXTS = [
    (1, "the cat sat on the mat and the dog ran off", "a"), (2, "the cat sat on the mat and the dog ran off", "a"),
    (3, "the  cat sat\ton the mat and the dog ran off ", "b"), (3, "the  cat sat\ton the mat and the dog ran off ", "b"),
    (4, None, "a"), (5, "", None), (6, " \n\t", None), (None, "no id here at all", "b"), (None, "no id here at all", "b"),
    (7, "one", "c"), (8, "two words", "c"), (9, LONG, "a"), (10, LONG + " end", "a"), (11, "Ünïcödé 漢字 😀 x\x85y", None), (12, None, None),
]


def documents(spark: SparkSession) -> DataFrame:
    rows = [(i, t, "en", s, None if t is None else len(t), "x", "y", "z", "k", "f", "t") for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
