"""T1-T8, T11-T14, T16, T17 over the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import recipes as R
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register


@register("join_dupcheck", """
SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def join_dupcheck(spark, sf):
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    j = R.checked_join(o, c, ["o_custkey"], "left")
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"),
                                         F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("duplicate_keys", """
SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1)
""")
def duplicate_keys(spark, sf):
    d = R.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey"])
    return d.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"))


@register("multi_aggregate", """
SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean,
       round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std, max(l_extendedprice) AS l_extendedprice_max,
       count(DISTINCT l_partkey) AS l_partkey_nunique
FROM lineitem GROUP BY 1
""")
def multi_aggregate(spark, sf):
    d = R.multi_aggregate(load(spark, sf, "lineitem"), ["l_returnflag"],
                          {"l_quantity": ["sum", "mean"], "l_extendedprice": ["std", "max"], "l_partkey": ["nunique"]})
    return d.select("l_returnflag", F.round("l_quantity_sum", 2).alias("l_quantity_sum"),
                    r6(F.col("l_quantity_mean")).alias("l_quantity_mean"),
                    F.round("l_extendedprice_std", 4).alias("l_extendedprice_std"), "l_extendedprice_max",
                    "l_partkey_nunique")


@register("pivot_counts", """
SELECT CAST(n_regionkey AS INTEGER) AS n_regionkey,
       CAST(coalesce(sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 END), 0) AS BIGINT) AS AUTOMOBILE,
       CAST(coalesce(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END), 0) AS BIGINT) AS BUILDING,
       CAST(coalesce(sum(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 END), 0) AS BIGINT) AS FURNITURE,
       CAST(coalesce(sum(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 END), 0) AS BIGINT) AS HOUSEHOLD,
       CAST(coalesce(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END), 0) AS BIGINT) AS MACHINERY
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey
""")
def pivot_counts(spark, sf):
    c = load(spark, sf, "customer")
    n = load(spark, sf, "nation")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation: 25 rows by schema
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    p = R.pivot_table(j, "n_regionkey", "c_mktsegment", "c_custkey", agg="count", fill=0, column_values=segs)
    return p.select("n_regionkey", *[F.col(s).cast("long").alias(s) for s in segs])


@register("dedupe", """
SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
""")
def dedupe(spark, sf):
    d = R.dedupe(load(spark, sf, "lineitem").select("l_partkey", "l_suppkey"))
    return d.agg(F.count(F.lit(1)).alias("n"))


@register("iqr_flags", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT count(*) FILTER (WHERE o_totalprice < lo OR o_totalprice > hi) AS outliers,
       round(sum(greatest(lo, least(hi, o_totalprice))), 2) AS capped_sum
FROM orders, b
""")
def iqr_flags(spark, sf):
    d = R.iqr_flag_cap(load(spark, sf, "orders"), "o_totalprice")
    return d.agg(F.count(F.when(F.col("o_totalprice_outlier"), 1)).alias("outliers"),
                 F.round(F.sum("o_totalprice_capped"), 2).alias("capped_sum"))


@register("fixed_bins", """
SELECT CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 'neg' WHEN c_acctbal > 0 AND c_acctbal <= 5000 THEN 'mid'
            WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 'high' END AS c_acctbal_bin, count(*) AS n
FROM customer GROUP BY 1
""")
def fixed_bins(spark, sf):
    d = R.fixed_bins(load(spark, sf, "customer"), "c_acctbal", [-1000, 0, 5000, 10000], ["neg", "mid", "high"])
    return d.groupBy("c_acctbal_bin").agg(F.count(F.lit(1)).alias("n"))


@register("mode_fill", """
WITH d AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders),
m AS (SELECT p FROM d WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
SELECT coalesce(d.p, (SELECT p FROM m)) AS p, count(*) AS n FROM d GROUP BY 1
""")
def mode_fill(spark, sf):
    o = load(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderpriority")).alias("p"))
    return R.mode_fill(o, ["p"]).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@register("describe", """
SELECT 'l_quantity' AS column_name, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean,
       round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.25), 6) AS q1,
       round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS q3, max(l_quantity) AS max
FROM lineitem
UNION ALL
SELECT 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount),
       round(quantile_cont(l_discount, 0.25), 6), round(quantile_cont(l_discount, 0.5), 6),
       round(quantile_cont(l_discount, 0.75), 6), max(l_discount)
FROM lineitem
""")
def describe(spark, sf):
    d = R.describe(load(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    return d.select("column_name", "count", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"),
                    "min", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3")], "max")


@register("class_weights", """
SELECT CAST(toxic AS INTEGER) AS label, count(*) AS n_c,
       round((SELECT count(*) FROM labels) * 1.0 / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)), 6) AS weight
FROM labels GROUP BY toxic
""")
def class_weights(spark, sf):
    d = R.class_weights(load(spark, sf, "labels"), "toxic")
    return d.select("label", "n_c", r6(F.col("weight")).alias("weight"))


@register("mean_ci", """
WITH g AS (SELECT o_orderstatus, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, count(*) AS n,
                  stddev_samp(o_totalprice) / sqrt(count(*)) AS sem, 1.959963984540054::DOUBLE AS z, (count(*) - 1)::DOUBLE AS v
           FROM orders GROUP BY 1),
-- Cornish-Fisher expansion of the t quantile, exact to 1e-9 at these sizes
t AS (SELECT *, z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2)
               + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3) AS q FROM g)
SELECT o_orderstatus, round(mean, 4) AS mean, round(std, 4) AS std, n, round(sem, 4) AS sem,
       round(mean - q * sem, 2) AS lo, round(mean + q * sem, 2) AS hi FROM t
""")
def mean_ci(spark, sf):
    d = R.mean_ci(load(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"])
    return d.select("o_orderstatus", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n",
                    F.round("sem", 4).alias("sem"), F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"))


@register("spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
                  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb
           FROM lineitem)
SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r
""")
def spearman(spark, sf):
    d = R.spearman(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return d.select(r6(F.col("rho")).alias("rho"), "n")


@register("decompose", """
WITH m AS (SELECT l_returnflag AS s, date_trunc('month', l_shipdate) AS t, sum(l_extendedprice) AS y
           FROM lineitem GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t) - 1 AS i,
             count(*) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS c,
             sum(y) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s_in,
             first(y) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 PRECEDING) AS e1,
             first(y) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 6 FOLLOWING AND 6 FOLLOWING) AS e2 FROM m),
tr AS (SELECT *, CASE WHEN c = 13 THEN (s_in + (e1 + e2) / 2) / 12 END AS trend, CAST(i % 12 AS INTEGER) AS phase FROM i),
se AS (SELECT s, phase, avg(y - trend) AS a FROM tr WHERE trend IS NOT NULL GROUP BY 1, 2),
sc AS (SELECT s, phase, a - avg(a) OVER (PARTITION BY s) AS seasonal FROM se)
SELECT s AS l_returnflag, phase, round(seasonal, 2) AS seasonal FROM sc
""")
def decompose(spark, sf):
    li = load(spark, sf, "lineitem")
    m = li.groupBy(F.col("l_returnflag").alias("s"), F.date_trunc("month", "l_shipdate").alias("t")) \
          .agg(F.sum("l_extendedprice").alias("y"))
    d = R.seasonal_decompose(m, ["s"], "t", "y", 12)
    return d.select(F.col("s").alias("l_returnflag"), "phase", F.round("seasonal", 2).alias("seasonal")).distinct()


@register("weekend_flag", """
SELECT CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS o_orderdate_weekend, count(*) AS n FROM orders GROUP BY 1
""")
def weekend_flag(spark, sf):
    d = R.weekend_flag(load(spark, sf, "orders"), "o_orderdate")
    return d.groupBy("o_orderdate_weekend").agg(F.count(F.lit(1)).alias("n"))
