"""Deterministic sampling, splitting and fold assignment.

Randomness comes from a portable md5 hash of the row key and a seed, so a
sample is the same on every run, after executor loss and in any SQL engine.
Per-class ranks (exact stratification) use the bucketed running count — a
class holding a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.scalars import hash_bucket, hash_int, hash_unit
from tablelens.operators.ranks import attach_scalars, prefix_sum, shared, with_groups


#: Bits of a hash, and its leading bits by which a split counts rows.
HASH_BITS, BIN_BITS = 32, 12


def hash_sample(df: DataFrame, key_cols: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """D1 (fraction): keep rows whose hash falls below ``fraction``; no shuffle."""
    return df.where(hash_unit(key_cols, seed) < F.lit(float(fraction)))


def hash_sample_n(df: DataFrame, key_cols: list[str], n: int, seed: int = 42) -> DataFrame:
    """D1 (fixed size): the ``n`` rows with the smallest hash (bounded top-n heap per task)."""
    return df.withColumn("_h", hash_int(key_cols, seed)).orderBy("_h", *key_cols).limit(n).drop("_h")


def _class_ranks(df: DataFrame, label: str, key_cols: list[str], seed: int) -> DataFrame:
    """Rank (1..n_c) of each row inside its class (NULL is one) by hash."""
    d = df.withColumn("_h", hash_int(key_cols, seed)).withColumn("_one", F.lit(1).cast("long"))
    return prefix_sum(d, "_h", ["_one"], partition_cols=[label], tie_cols=key_cols).withColumnRenamed("cum__one", "_rank")


def stratified_split(df: DataFrame, label: str, key_cols: list[str], test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Add ``split`` in {train, test}: in every class the ceil(f * n_c) rows
    with the smallest hash go to test (NULL is a class like any other).  The
    greatest key of each class that goes to test is found by counts, so no row
    is shuffled but those of one bin a class; rows with equal keys go to the same side."""
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key_cols)]
    names = [f"_k{i}" for i in range(len(keys))]
    narrow = df.select(F.col(f"`{label}`").alias("_class"), *keys).withColumn("_h", hash_int(names, seed))
    narrow = narrow.withColumn("_bin", F.shiftright("_h", HASH_BITS - BIN_BITS))
    # rows are counted by leading bits of the hash, and only those of the bin that holds the last test row by key
    bins = narrow.groupBy("_class", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    each, upto = Window.partitionBy("_class"), F.sum("_c").over(Window.partitionBy("_class").orderBy("_bin"))
    bins = bins.withColumn("_upto", upto).withColumn("_nc", F.sum("_c").over(each))
    wanted = F.least(F.ceil(F.col("_nc") * F.lit(float(test_fraction))), F.col("_nc"))
    last = bins.withColumn("_left", wanted - (F.col("_upto") - F.col("_c"))).where((F.col("_left") >= 1) & (F.col("_left") <= F.col("_c")))
    inside = (with_groups(narrow, last.select("_class", "_bin", "_left"), ["_class", "_bin"])
              .groupBy("_class", "_left", "_h", *names).agg(F.count(F.lit(1)).alias("_c")))
    upto = F.sum("_c").over(Window.partitionBy("_class").orderBy("_h", *names))
    cut = (inside.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_c") < F.col("_left")))
           .select("_class", F.struct("_h", *names).alias("_cut")))  # a row per class
    own = F.struct(hash_int(key_cols, seed).alias("_h"), *keys)
    rows = df.withColumn("_class", F.col(f"`{label}`")).withColumn("_own", own)
    out = with_groups(rows, cut, ["_class"], "left")
    test = F.coalesce(F.col("_own") <= F.col("_cut"), F.lit(False))
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("_class", "_own", "_cut")


def random_split(df: DataFrame, key_cols: list[str], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """D2 fallback (unstratified): a hash threshold — no shuffle at all."""
    return df.withColumn("split", F.when(hash_unit(key_cols, seed) < F.lit(float(test_fraction)), "test")
                         .otherwise("train"))


def kfold(df: DataFrame, key_cols: list[str], k: int | None = None, label: str | None = None,
          seed: int = 42, n_rows: int | None = None) -> DataFrame:
    """D3: add ``fold`` in 0..k-1.  k defaults to 5 when n >= 250 else 3.
    Stratified when ``label`` is given: rank inside the class modulo k."""
    if k is None:
        n = n_rows if n_rows is not None else df.count()
        k = 5 if n >= 250 else 3
    if label is None:
        return df.withColumn("fold", hash_bucket(key_cols, k, seed))
    r = _class_ranks(df, label, key_cols, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_one", "_rank")


def thin(df: DataFrame, order_col: str, m: int = 40) -> DataFrame:
    """Keep every step-th row in ``order_col`` order, step = max(1, n // m)
    (curves and result tables)."""
    d = shared(df.withColumn("_one", F.lit(1).cast("long")))
    r = prefix_sum(d, order_col, ["_one"])
    n = d.agg(F.count(F.lit(1)).alias("_len"))
    step = F.greatest(F.lit(1), F.floor(F.col("_len") / m))
    return attach_scalars(r, n).where(((F.col("cum__one") - 1) % step) == 0).drop("_one", "cum__one", "_len")


def class_balance(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """``label, before, after`` class counts (full outer join of two tiny tables)."""
    b = before.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("after"))
    return b.join(a, "label", "full").select("label", F.coalesce("before", F.lit(0)).alias("before"),
                                             F.coalesce("after", F.lit(0)).alias("after"))
