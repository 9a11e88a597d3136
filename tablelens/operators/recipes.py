"""Documented table recipes as built-ins.

Thin DataFrame compositions; the exact-quantile and rank pieces use the
distributed order statistics of :mod:`tablelens.operators.ranks`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.pvalues import betainc
from tablelens.operators.ranks import attach_scalars, midranks, quantile_row


def _q(c: str):
    return F.col(f"`{c}`")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """T1 check: keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                 right_unique: bool = True) -> DataFrame:
    """Join with a duplicate-key check on the side that must be unique.
    Catalyst/AQE choose broadcast or sort-merge from the sizes."""
    if right_unique and duplicate_keys(right, on).limit(1).count() > 0:
        raise ValueError(f"join keys {on} are not unique on the right side")
    return left.join(right, on, how)


def multi_aggregate(df: DataFrame, by: list[str], spec: dict[str, list[str]]) -> DataFrame:
    """Several aggregates per column: ``{"col": ["sum", "mean", ...]}`` ->
    columns ``<col>_<agg>``."""
    fns = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count,
           "std": F.stddev_samp, "var": F.var_samp, "nunique": F.countDistinct}
    aggs = [fns[a](_q(c)).alias(f"{c}_{a}") for c, lst in spec.items() for a in lst]
    return df.groupBy(*by).agg(*aggs)


def pivot_table(df: DataFrame, index: str, columns: str, values: str, agg: str = "sum",
                fill: float = 0.0, column_values: list | None = None) -> DataFrame:
    """Long -> wide with a fill value.  Pass ``column_values`` at scale to
    skip the distinct pass that discovers them."""
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[agg]
    g = df.groupBy(index).pivot(columns, column_values).agg(fn(_q(values)))
    return g.na.fill(fill)


def dedupe(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """T4: drop duplicate rows (on ``subset`` when given)."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5) -> tuple[float, float]:
    r = quantile_row(df.select(_q(col).cast("double").alias("v")), "v", [0.25, 0.75], ["q1", "q3"]).first()
    iqr = r["q3"] - r["q1"]
    return r["q1"] - k * iqr, r["q3"] + k * iqr


def iqr_flag_cap(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """T5: ``<c>_outlier`` flag outside [Q1 - k IQR, Q3 + k IQR] and ``<c>_capped``."""
    lo, hi = iqr_bounds(df, col, k)
    x = _q(col).cast("double")
    return df.select("*", ((x < lo) | (x > hi)).alias(f"{col}_outlier"),
                     F.greatest(F.lit(lo), F.least(F.lit(hi), x)).alias(f"{col}_capped"))


def fixed_bins(df: DataFrame, col: str, edges: list[float], labels: list[str] | None = None,
               right: bool = True) -> DataFrame:
    """T6 (fixed edges): ``pd.cut`` — bin index 0.. (or label); outside -> NULL."""
    x = _q(col).cast("double")
    b = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        lo, hi = edges[i], edges[i + 1]
        inside = ((x > lo) & (x <= hi)) if right else ((x >= lo) & (x < hi))
        b = F.when(inside, F.lit(i)).otherwise(b)
    out = b
    if labels:
        out = F.element_at(F.array(*[F.lit(s) for s in labels]), b + 1)
    return df.withColumn(f"{col}_bin", out)


def mode_value(df: DataFrame, col: str):
    """Most frequent non-null value; ties -> the smallest value."""
    r = (df.where(_q(col).isNotNull()).groupBy(_q(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
           .orderBy(F.desc("c"), F.asc("v")).limit(1).collect())
    return r[0]["v"] if r else None


def mode_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill NULLs with the column mode."""
    fills = {c: mode_value(df, c) for c in cols}
    return df.select(*[(F.coalesce(_q(c), F.lit(fills[c])).alias(c) if c in fills and fills[c] is not None
                        else _q(c)) for c in df.columns])


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column_name, count, mean, std, min, q1, median, q3, max`` — exact
    quartiles from one order-statistics job over all columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                  _q(c).cast("double").alias("v")) for c in cols])).alias("s")) \
             .select("s.column_name", "s.v")
    base = long.groupBy("column_name").agg(F.count("v").alias("count"), F.avg("v").alias("mean"),
                                           F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
                                           F.max("v").alias("max"))
    qs = quantile_row(long, "v", [0.25, 0.5, 0.75], ["q1", "median", "q3"], ["column_name"])
    return base.join(qs, "column_name").select("column_name", "count", "mean", "std", "min", "q1", "median",
                                               "q3", "max")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    g = df.where(_q(label).isNotNull()).groupBy(_q(label).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    tot = g.agg(F.sum("n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return attach_scalars(g, tot).select("label", "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("weight"))


def t_critical(df_: float, conf: float = 0.95) -> float:
    """Two-sided Student-t critical value by bisection on the incomplete beta."""
    alpha = 1 - conf
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        p = betainc(df_ / 2.0, 0.5, df_ / (df_ + mid * mid))
        if p > alpha:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def mean_ci(df: DataFrame, col: str, by: list[str] | None = None, conf: float = 0.95) -> DataFrame:
    """``mean, std, n, sem`` and a t-based interval ``lo, hi`` per group."""
    by = by or []
    g = df.groupBy(*by).agg(F.avg(_q(col)).alias("mean"), F.stddev_samp(_q(col)).alias("std"),
                            F.count(_q(col)).alias("n"))
    g = g.withColumn("sem", F.col("std") / F.sqrt("n"))

    @F.pandas_udf("double")
    def tcrit(n):
        return n.map(lambda v: t_critical(float(v) - 1, conf) if v and v > 1 else float("nan"))

    return g.withColumn("_t", tcrit("n")).withColumn("lo", F.col("mean") - F.col("_t") * F.col("sem")) \
            .withColumn("hi", F.col("mean") + F.col("_t") * F.col("sem")).drop("_t")


def rank_column(df: DataFrame, col: str, out: str) -> DataFrame:
    """Attach the midrank of ``col`` to each row.  The rank table has one row per
    distinct value; the optimizer broadcasts it or not by its bytes (AQE splits
    a hot value's partition)."""
    r = midranks(df, col).select(F.col(col).alias(f"_v_{out}"), F.col("midrank").alias(out))
    return df.join(r, _q(col) == F.col(f"_v_{out}"), "left").drop(f"_v_{out}")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman rho = Pearson r of midranks (pairwise-complete rows)."""
    d = df.select(_q(a).cast("double").alias("a"), _q(b).cast("double").alias("b")) \
          .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    d = rank_column(rank_column(d, "a", "ra"), "b", "rb")
    return d.agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def seasonal_decompose(df: DataFrame, series: list[str], t_col: str, y_col: str, period: int) -> DataFrame:
    """Classical additive decomposition per series: centred moving average
    (2 x p for even p), seasonal = mean detrended value by phase (centred to
    zero mean), residual = y - trend - seasonal.  Trend is NULL at the ends."""
    w = Window.partitionBy(*series).orderBy(t_col)
    d = df.withColumn("_i", F.row_number().over(w) - 1)
    half = period // 2
    if period % 2 == 1:
        trend = F.avg(y_col).over(w.rowsBetween(-half, half))
        full = F.count(y_col).over(w.rowsBetween(-half, half)) == period
    else:
        # 2 x p moving average: weights 1/2p at both ends, 1/p inside
        s_in = F.sum(y_col).over(w.rowsBetween(-half + 1, half - 1))
        ends = F.first(y_col).over(w.rowsBetween(-half, -half)) + F.first(y_col).over(w.rowsBetween(half, half))
        trend = (s_in + ends / 2) / period
        full = F.count(y_col).over(w.rowsBetween(-half, half)) == period + 1
    d = d.withColumn("trend", F.when(full, trend)).withColumn("phase", (F.col("_i") % period).cast("int"))
    seas = d.where(F.col("trend").isNotNull()).groupBy(*series, "phase") \
            .agg(F.avg(F.col(y_col) - F.col("trend")).alias("_s"))
    ws = Window.partitionBy(*series)
    seas = seas.withColumn("seasonal", F.col("_s") - F.avg("_s").over(ws)).drop("_s")
    out = d.join(seas, series + ["phase"], "left")
    return out.withColumn("resid", F.col(y_col) - F.col("trend") - F.col("seasonal")).drop("_i")


def weekend_flag(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """1 when the date is Saturday or Sunday."""
    return df.withColumn(out or f"{col}_weekend", (F.weekday(_q(col)) >= 5).cast("int"))

