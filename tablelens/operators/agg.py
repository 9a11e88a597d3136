"""Segment aggregates, histograms and summaries.

Group-bys run as partial + final HashAggregate, so a hot key is combined on
the map side before the shuffle.  Top-k results use ``orderBy().limit()``
(TakeOrderedAndProject: a bounded heap per task) with a label tie-break.
Quantiles are exact and distributed (see :mod:`tablelens.operators.ranks`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.scalars import finite_input
from tablelens.operators.ranks import attach_scalars, exact_quantiles, prefix_sum, quantile_row

AGGREGATES = ("count", "mean", "sum", "median", "min", "max")


@finite_input
def group_aggregate(df: DataFrame, group: str, agg: str = "count", of: str | None = None,
                    top: int = 8) -> DataFrame:
    """G1: ``label, value`` — count, or mean/sum/median/min/max of ``of`` per
    group, the ``top`` largest first.  NULL groups are dropped."""
    agg = agg.lower()
    if agg not in AGGREGATES:
        raise ValueError(f"unsupported aggregate {agg}")
    d = df.where(F.col(group).isNotNull())
    label = F.col(group).cast("string").alias("label")
    if agg == "count":
        g = d.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("value"))
    elif agg == "median":
        g = (exact_quantiles(d.select(F.col(group).cast("string").alias("label"), F.col(of).cast("double").alias("v")),
                             "v", [0.5], ["label"]).select("label", F.col("q").alias("value")))
    else:
        fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg]
        v = fn(F.col(of).cast("double"))
        if agg == "sum":
            v = F.coalesce(v, F.lit(0.0))
        g = d.groupBy(label).agg(v.alias("value"))
    return g.orderBy(F.desc("value"), F.asc("label")).limit(top)


def group_cardinality_ok(df: DataFrame, group: str) -> bool:
    """G1 guard: refuse group columns with more than max(40, 0.6 n) distinct values."""
    r = df.agg(F.countDistinct(group).alias("d"), F.count(F.lit(1)).alias("n")).first()
    return r["d"] <= max(40, 0.6 * r["n"])


@finite_input
def segment_rate(df: DataFrame, segment: str, target: str, positive, top: int = 5) -> DataFrame:
    """``label, value`` = share of rows with ``target == positive`` per
    segment (NULL segments dropped), highest first."""
    hit = F.when(F.col(target) == F.lit(positive), 1.0).otherwise(0.0)
    g = (df.where(F.col(segment).isNotNull())
           .groupBy(F.col(segment).cast("string").alias("label"))
           .agg(F.avg(hit).alias("value")))
    return g.orderBy(F.desc("value"), F.asc("label")).limit(top)


@finite_input
def quartile_means(df: DataFrame, col: str, target: str, q: int = 4) -> DataFrame:
    """Mean target per quantile bin of ``col`` (``pd.qcut`` with duplicate
    edges dropped; bins right-closed, the first also holds the minimum).

    Output ``bin, lo, hi, mean_target, value`` with value = mean / max(mean)."""
    probs = [i / q for i in range(q + 1)]
    names = [f"e{i}" for i in range(q + 1)]
    d = df.select(F.col(col).cast("double").alias("x"), F.col(target).cast("double").alias("y")) \
          .where(F.col("x").isNotNull())
    edges = quantile_row(d, "x", probs, names).first()
    uniq = sorted({edges[n] for n in names})
    if len(uniq) < 2:
        raise ValueError("not enough distinct values to bin")
    # bin k covers (uniq[k-1], uniq[k]]; the first bin also covers uniq[0]
    b = F.lit(None).cast("int")
    for k in range(len(uniq) - 1, 0, -1):
        b = F.when(F.col("x") <= F.lit(uniq[k]), F.lit(k)).otherwise(b)
    lo = F.element_at(F.array(*[F.lit(u) for u in uniq]), F.col("bin"))
    hi = F.element_at(F.array(*[F.lit(u) for u in uniq]), F.col("bin") + 1)
    g = d.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.avg("y").alias("mean_target"))
    w = Window.partitionBy()  # result table: at most q rows
    return g.select("bin", lo.alias("lo"), hi.alias("hi"), "mean_target",
                    (F.col("mean_target") / F.coalesce(F.nullif(F.max("mean_target").over(w), F.lit(0.0)),
                                                       F.lit(1.0))).alias("value"))


@finite_input
def value_shares(df: DataFrame, col: str, top: int = 5, missing_as_category: bool = False) -> DataFrame:
    """``label, value`` = share of each value, largest first.

    ``missing_as_category=False`` skips NULL (``value_counts``); True counts it
    as the string ``'nan'`` (the reference's chart-spec path)."""
    c = F.col(col).cast("string")
    if missing_as_category:
        d = df.select(F.coalesce(c, F.lit("nan")).alias("label"))
    else:
        d = df.select(c.alias("label")).where(F.col("label").isNotNull())
    g = d.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    shares = attach_scalars(g, g.agg(F.sum("c").alias("_n"))).select(
        "label", (F.col("c") / F.col("_n")).alias("value"))
    return shares.orderBy(F.desc("value"), F.asc("label")).limit(top)


@finite_input
def histogram(df: DataFrame, col: str, bins: int = 8) -> DataFrame:
    """Equal-width histogram like ``np.histogram``: ``bin (1..n), lo, hi, count``;
    the last bin is right-closed; empty bins are kept."""
    d = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    mm = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        raise ValueError("no values")
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int") + 1, F.lit(bins))
    counts = d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (frame.join(F.broadcast(counts), "bin", "left")  # counts has at most `bins` rows
                 .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
                         (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"),
                         F.coalesce("count", F.lit(0)).cast("long").alias("count")))


@finite_input
def box_summary(df: DataFrame, col: str, by: str | None = None, max_classes: int = 4) -> DataFrame:
    """Five-number summary ``label, min, q1, med, q3, max``; one box per class
    of ``by`` when it has at most ``max_classes`` classes, else one box 'all'."""
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    names = ["min", "q1", "med", "q3", "max"]
    x = F.col(col).cast("double")
    if by is not None:
        k = df.agg(F.countDistinct(by).alias("k")).first()["k"]
        if k <= max_classes:
            d = df.select(F.concat(F.lit("class "), F.col(by).cast("string")).alias("label"), x.alias("v")) \
                  .where(F.col("label").isNotNull())
            return quantile_row(d, "v", probs, names, ["label"]).select("label", *names)
    d = df.select(F.lit("all").alias("label"), x.alias("v"))
    return quantile_row(d, "v", probs, names, ["label"]).select("label", *names)


@finite_input
def headline_stats(df: DataFrame, target: str, is_classification: bool) -> DataFrame:
    """``rows, columns, avg_missing_pct`` and either the majority-class share
    or the mean target, in one aggregate pass."""
    cols = df.columns
    miss = sum((F.sum(F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0)) for c in cols), F.lit(0))
    base = df.agg(F.count(F.lit(1)).alias("rows"), miss.alias("_miss"),
                  F.avg(F.col(target).cast("double")).alias("mean_target"))
    base = base.select("rows", F.lit(len(cols)).alias("columns"),
                       (F.col("_miss") / (F.col("rows") * len(cols)) * 100).alias("avg_missing_pct"),
                       "mean_target")
    if not is_classification:
        return base.withColumn("majority_share", F.lit(None).cast("double"))
    vc = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("c"))
    maj = vc.agg((F.max("c") / F.sum("c")).alias("majority_share"))
    return attach_scalars(base.drop("mean_target").withColumn("mean_target", F.lit(None).cast("double")), maj)


@finite_input
def pareto(df: DataFrame, group: str, value: str) -> DataFrame:
    """``label, total, cum_share`` — groups by descending total with the running
    share of the grand total.  The running window is over grouped rows; many
    groups go through the bucketed prefix sum instead of one window."""
    g = (df.where(F.col(group).isNotNull())
           .groupBy(F.col(group).cast("string").alias("label"))
           .agg(F.sum(F.col(value).cast("double")).alias("total"),
                F.lit(1).cast("long").alias("one")))
    # order: total desc, label asc — bucketed running sums, no single-task window
    cum = prefix_sum(g, "total", ["total", "one"], descending=True, tie_cols=["label"])
    tot = g.agg(F.sum("total").alias("_all"))
    return attach_scalars(cum, tot).select(
        "label", F.col("cum_one").alias("rank"), "total", (F.col("cum_total") / F.col("_all")).alias("cum_share"))


def scale_by_max(df: DataFrame, value: str = "value", floor: float = 0.02) -> DataFrame:
    """Value / max |value|, clamped to [floor, 1] (result tables only)."""
    w = Window.partitionBy()
    mx = F.max(F.abs(F.col(value))).over(w)
    return df.withColumn("scaled", F.greatest(F.lit(floor), F.least(F.lit(1.0),
                                  F.abs(F.col(value)) / F.coalesce(F.nullif(mx, F.lit(0.0)), F.lit(1.0)))))


@finite_input
def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``label, count, share`` per class (NULL dropped), plus ``is_majority``."""
    g = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")) \
          .agg(F.count(F.lit(1)).alias("count"))
    s = g.agg(F.sum("count").alias("_n"), F.max("count").alias("_mx"))
    return attach_scalars(g, s).select("label", "count", (F.col("count") / F.col("_n")).alias("share"),
                                       (F.col("count") == F.col("_mx")).alias("is_majority"))
