"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.session import checkpoint_dir

# The white space of every contract here, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def text_of(column: str) -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and reread it.

    Cuts lineage in a place every executor can read, so a lost executor costs
    only its running tasks; the columnar files are also smaller than an RDD
    checkpoint.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tablelens-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tablelens-{uuid.uuid4().hex}/{name}"
