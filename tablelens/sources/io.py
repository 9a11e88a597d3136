"""Scans and sinks.

The reference reads one file into memory and samples it down to a row cap; on
Spark the scan is split across executors and no cap is applied.  Sampling is
still offered (I5/I6), always deterministic.  Every reader gives NaN and
infinities as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.scalars import finite_table, hash_unit


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; projection and filters are pushed into the reader."""
    return finite_table(spark.read.parquet(path))


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True) -> DataFrame:
    """CSV with a header.  Pass ``schema`` at scale; inference costs a full pass."""
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        return finite_table(r.schema(schema).csv(path))
    return finite_table(r.option("inferSchema", True).csv(path))


def read_json(spark: SparkSession, path: str, schema=None, array_document: bool = False) -> DataFrame:
    """JSON.  JSON-lines is the splittable default; ``array_document`` reads one
    top-level array of records (not splittable — small files only)."""
    r = spark.read.option("multiLine", array_document)
    if schema is not None:
        r = r.schema(schema)
    return finite_table(r.json(path))


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    """Dispatch on extension like the reference's upload reader."""
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower()
    if fmt in ("parquet", "pq"):
        return read_parquet(spark, path)
    if fmt in ("csv", "txt", "tsv"):
        return read_csv(spark, path, **kw)
    if fmt in ("json", "jsonl", "ndjson"):
        return read_json(spark, path, **kw)
    raise ValueError(f"unsupported format: {fmt}")


def source_row_count(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """I4: size of a source without building the table.  Parquet answers from
    footers; text formats count lines (minus each file's header for CSV)."""
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower()
    if fmt in ("csv", "tsv", "txt"):
        per_file = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("lines"))
        return per_file.agg(F.coalesce(F.sum(F.col("lines") - 1), F.lit(0)).cast("long").alias("rows"))
    return read_table(spark, path, fmt).agg(F.count(F.lit(1)).cast("long").alias("rows"))


def proportional_sample(df: DataFrame, fraction: float, key_cols: list[str], seed: int = 42) -> DataFrame:
    """Deterministic Bernoulli sample by a portable md5 hash of the key.
    Same rows on every run and every engine; no shuffle."""
    return df.filter(hash_unit(key_cols, seed) < F.lit(float(fraction)))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """I8: result sink — one result table per output key."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(fmt)
