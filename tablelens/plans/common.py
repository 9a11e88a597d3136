"""Shared table loaders and derived fixtures for registered queries.

Each derived fixture exists twice — as a Spark DataFrame and as SQL text for
the DuckDB oracle — and both must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.session import table_path


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# lineitem with dirt the driver tables lack: NULL tax on line 3, blank numeric
# text on line 2 (the reference's "numeric text with blanks" fixture).
def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_linenumber") == 3, F.lit(None).cast("double")).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus", "l_shipdate",
        F.when(F.col("l_linenumber") == 2, F.lit(" "))
         .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("qty_text"),
    )


DIRTY_LINEITEM_SQL = """
SELECT l_orderkey, l_quantity, l_extendedprice, l_discount,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax,
       l_returnflag, l_linestatus, l_shipdate,
       CASE WHEN l_linenumber = 2 THEN ' ' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty_text
FROM lineitem
"""

DIRTY_LINEITEM_COLS = [
    ("l_orderkey", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
    ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "string"),
    ("l_linestatus", "string"), ("l_shipdate", "date"), ("qty_text", "string"),
]


def r6(c):
    """Round a computed double for engine-independent comparison."""
    return F.round(c, 6)
