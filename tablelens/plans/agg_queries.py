"""G1-G10 over lineitem / orders / customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import agg as A
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register


@register("segment_rate", """
SELECT l_returnflag AS label, round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS value
FROM lineitem WHERE l_returnflag IS NOT NULL
GROUP BY l_returnflag ORDER BY value DESC, label LIMIT 5
""")
def segment_rate(spark, sf):
    out = A.segment_rate(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "F", top=5)
    return out.select("label", r6(F.col("value")).alias("value"))


@register("agg_chart_mean", """
SELECT o_orderpriority AS label, round(avg(o_totalprice), 4) AS value
FROM orders WHERE o_orderpriority IS NOT NULL
GROUP BY o_orderpriority ORDER BY avg(o_totalprice) DESC, label LIMIT 8
""")
def agg_chart_mean(spark, sf):
    out = A.group_aggregate(load(spark, sf, "orders"), "o_orderpriority", "mean", "o_totalprice", top=8)
    return out.select("label", F.round("value", 4).alias("value"))


@register("agg_chart_count", """
SELECT CAST(c_nationkey AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS value
FROM customer GROUP BY c_nationkey ORDER BY value DESC, label LIMIT 12
""")
def agg_chart_count(spark, sf):
    return A.group_aggregate(load(spark, sf, "customer"), "c_nationkey", "count", top=12)


@register("agg_chart_median", """
SELECT l_shipmode_like AS label, value FROM (
  SELECT l_returnflag || l_linestatus AS l_shipmode_like, round(median(l_extendedprice), 4) AS value,
         median(l_extendedprice) AS v
  FROM lineitem GROUP BY 1) ORDER BY v DESC, label LIMIT 6
""")
def agg_chart_median(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("grp", F.concat("l_returnflag", "l_linestatus"))
    out = A.group_aggregate(li, "grp", "median", "l_extendedprice", top=6)
    return out.select("label", F.round("value", 4).alias("value"))


@register("quartile_means", """
WITH e AS (SELECT quantile_cont(l_quantity, [0, 0.25, 0.5, 0.75, 1.0]) AS q FROM lineitem),
u AS (SELECT list_sort(list_distinct(q)) AS u FROM e),
b AS (SELECT l_extendedprice AS y,
             CASE WHEN l_quantity <= u[2] THEN 1 WHEN l_quantity <= u[3] THEN 2
                  WHEN l_quantity <= u[4] THEN 3 WHEN l_quantity <= u[5] THEN 4 END AS bin, u
      FROM lineitem, u),
g AS (SELECT bin, any_value(u[bin]) AS lo, any_value(u[bin + 1]) AS hi, avg(y) AS m FROM b GROUP BY bin)
SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, round(m, 4) AS mean_target, round(m / max(m) OVER (), 6) AS value FROM g
""")
def quartile_means(spark, sf):
    out = A.quartile_means(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"),
                      F.round("mean_target", 4).alias("mean_target"), r6(F.col("value")).alias("value"))


@register("value_shares", """
SELECT c_mktsegment AS label, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS value
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
ORDER BY count(*) DESC, label LIMIT 5
""")
def value_shares(spark, sf):
    out = A.value_shares(load(spark, sf, "customer"), "c_mktsegment", top=5)
    return out.select("label", r6(F.col("value")).alias("value"))


@register("histogram", """
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 8) AS INTEGER) + 1, 8) AS bin FROM orders, m),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT s.bin, round(lo + (s.bin - 1) * (hi - lo) / 8, 4) AS lo, round(lo + s.bin * (hi - lo) / 8, 4) AS hi,
       CAST(coalesce(n, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 9)) s LEFT JOIN c USING (bin), m
""")
def histogram(spark, sf):
    out = A.histogram(load(spark, sf, "orders"), "o_totalprice", bins=8)
    return out.select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "count")


@register("box_summary", """
SELECT 'class ' || l_linestatus AS label,
       quantile_cont(l_extendedprice, 0.0) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,
       quantile_cont(l_extendedprice, 1.0) AS max
FROM lineitem GROUP BY l_linestatus
""")
def box_summary(spark, sf):
    out = A.box_summary(load(spark, sf, "lineitem"), "l_extendedprice", by="l_linestatus")
    return out.select("label", "min", *[F.round(c, 4).alias(c) for c in ("q1", "med", "q3")], "max")


@register("headline_stats", """
SELECT CAST(count(*) AS BIGINT) AS rows, 6 AS columns, CAST(0.0 AS DOUBLE) AS avg_missing_pct,
       CAST(NULL AS DOUBLE) AS mean_target,
       (SELECT round(max(c) * 1.0 / sum(c), 6) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus))
         AS majority_share
FROM orders
""")
def headline_stats(spark, sf):
    out = A.headline_stats(load(spark, sf, "orders"), "o_orderstatus", is_classification=True)
    return out.select("rows", "columns", "avg_missing_pct", "mean_target",
                      r6(F.col("majority_share")).alias("majority_share"))


@register("pareto", """
WITH g AS (SELECT n_name AS label, sum(c_acctbal) AS total
           FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT label, CAST(row_number() OVER (ORDER BY total DESC, label) AS BIGINT) AS rank, round(total, 4) AS total,
       round(sum(total) OVER (ORDER BY total DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(total) OVER (), 6) AS cum_share
FROM g
""")
def pareto(spark, sf):
    c = load(spark, sf, "customer")
    n = load(spark, sf, "nation")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation: 25 rows, fixed by the schema
    out = A.pareto(j, "n_name", "c_acctbal")
    return out.select("label", "rank", F.round("total", 4).alias("total"), r6(F.col("cum_share")).alias("cum_share"))


@register("class_distribution", """
SELECT o_orderstatus AS label, count(*) AS count, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share,
       count(*) = max(count(*)) OVER () AS is_majority
FROM orders GROUP BY o_orderstatus
""")
def class_distribution(spark, sf):
    out = A.class_distribution(load(spark, sf, "orders"), "o_orderstatus")
    return out.select("label", "count", r6(F.col("share")).alias("share"), "is_majority")


@register("scaled_series", """
WITH g AS (SELECT o_orderpriority AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT label, round(greatest(0.02, least(1.0, abs(value) / max(abs(value)) OVER ())), 6) AS scaled FROM g
""")
def scaled_series(spark, sf):
    g = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label")) \
        .agg(F.sum("o_totalprice").alias("value"))
    return A.scale_by_max(g).select("label", r6(F.col("scaled")).alias("scaled"))
