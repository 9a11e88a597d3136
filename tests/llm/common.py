"""Fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

#: Columns that documents do not have, named as operators name things inside.
CLASHING = ["id", "size", "key", "row", "row_id", "fp", "root", "score", "h", "k", "kept", "digest", "spans", "target"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHING]])


def table(spark, rows, partitions=3):
    """documents with clashing extra columns, from (doc_id, text, source)."""
    full = [(i, t, "en", s, None if t is None else len(t), *["?"] * len(CLASHING)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 9))) for _ in range(words))


PASSAGE = prose(99, 60)

#: Nulls, empty, white and long texts, exact and near copies, repeated rows and ties.
ODD = [
    (1, "Alpha  beta\tgamma", "a"), (2, "Alpha beta gamma", "a"), (3, "alpha beta gamma", "b"), (4, None, "b"), (5, "", None),
    (6, " \t\n\x0b\x0c\r", None), (7, "Alpha beta gamma", "a"), (7, "Alpha beta gamma", "a"), (8, "Alphabetagamma", "z"),
    (None, "Alpha beta gamma", "a"), (None, None, None), (10, prose(1, 40000), "a"), (11, prose(2, 300) + PASSAGE, "b"),
    (12, PASSAGE + prose(3, 200), "b"), (13, prose(2, 300) + PASSAGE, "a"), (14, "é" * 150 + "日本語 <|endoftext|> naïve", "c"),
    (15, "a" * 700, "c"), (16, PASSAGE, "é"), (17, prose(2, 299) + " x " + PASSAGE, "a"), (18, "x", "a"),
    (19, prose(5, 9).upper() + " 'll don't 12345 !!!\x85\xa0 end \x1c odd", "d"),
]
