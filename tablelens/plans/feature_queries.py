"""E1-E4, T9, T10, T15."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import features as X
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register
from tablelens.plans.sample_queries import hash_sql


def _skewed(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                     F.exp(F.col("l_quantity") / 6.0).alias("growth"),
                     (F.col("l_extendedprice") * F.col("l_extendedprice") / 1e6).alias("price_sq"))


_SKEWED_SQL = """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, exp(l_quantity / 6.0) AS growth,
       l_extendedprice * l_extendedprice / 1e6 AS price_sq FROM lineitem"""


@register("skew_table", f"""
WITH d AS ({_SKEWED_SQL})
SELECT 'l_quantity' AS column_name, round(skewness(l_quantity), 6) AS skew FROM d
UNION ALL SELECT 'growth', round(skewness(growth), 6) FROM d
UNION ALL SELECT 'price_sq', round(skewness(price_sq), 6) FROM d
""")
def skew_table(spark, sf):
    t = X.skew_table(_skewed(spark, sf), ["l_quantity", "growth", "price_sq"])
    return t.select("column_name", r6(F.col("skew")).alias("skew"))


@register("log_feature", f"""
WITH d AS ({_SKEWED_SQL}),
s AS (SELECT 'growth' AS c, skewness(growth) AS sk, min(growth) AS mn, count(DISTINCT growth) AS k FROM d
      UNION ALL SELECT 'price_sq', skewness(price_sq), min(price_sq), count(DISTINCT price_sq) FROM d
      UNION ALL SELECT 'l_quantity', skewness(l_quantity), min(l_quantity), count(DISTINCT l_quantity) FROM d)
SELECT 'log_' || c AS feature,
       round(CASE c WHEN 'growth' THEN (SELECT sum(ln(1 + growth)) FROM d)
                    WHEN 'price_sq' THEN (SELECT sum(ln(1 + price_sq)) FROM d)
                    ELSE (SELECT sum(ln(1 + l_quantity)) FROM d) END, 4) AS total
FROM s WHERE mn >= 0 AND k > 10 AND sk > 2
""")
def log_feature(spark, sf):
    d = X.log_features(_skewed(spark, sf).select("l_quantity", "growth", "price_sq"))
    new = [c for c in d.columns if c.startswith("log_")]
    if not new:
        return spark.createDataFrame([], "feature string, total double")
    row = d.agg(*[F.round(F.sum(c), 4).alias(c) for c in new])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("total"))
                                         for c in new])).alias("s")).select("s.*")


@register("interaction_feature", """
SELECT 'l_extendedprice_x_l_quantity' AS feature, round(sum(l_extendedprice * l_quantity), 2) AS total FROM lineitem
""")
def interaction_feature(spark, sf):
    li = load(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    d = X.interaction_feature(li)
    new = [c for c in d.columns if "_x_" in c][0]
    return d.agg(F.round(F.sum(new), 2).alias("total")).select(F.lit(new).alias("feature"), "total")


@register("standardize", """
SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal
FROM customer
""")
def standardize(spark, sf):
    d = X.standardize(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return d.select("c_custkey", r6(F.col("c_acctbal")).alias("c_acctbal"))


@register("minmax", """
SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) /
                        (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice
FROM part
""")
def minmax(spark, sf):
    d = X.minmax(load(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])
    return d.select("p_partkey", r6(F.col("p_retailprice")).alias("p_retailprice"))


@register("one_hot", """
SELECT c_custkey,
       CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS seg_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS seg_BUILDING,
       CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS seg_FURNITURE, CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS seg_HOUSEHOLD,
       CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS seg_MACHINERY
FROM customer
""")
def one_hot(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return X.one_hot(c, "c_mktsegment", prefix="seg").drop("c_mktsegment")


@register("target_encode", f"""
WITH tr AS (SELECT * FROM orders WHERE {hash_sql('o_orderkey')} / 4294967296.0 >= 0.2),
e AS (SELECT o_orderpriority, avg(o_totalprice) AS te FROM tr GROUP BY 1)
SELECT o_orderpriority, round(coalesce(te, (SELECT avg(o_totalprice) FROM tr)), 4) AS o_orderpriority_te, count(*) AS n
FROM orders LEFT JOIN e USING (o_orderpriority) GROUP BY ALL
""")
def target_encode(spark, sf):
    o = load(spark, sf, "orders")
    d = X.target_encode(o, "o_orderpriority", "o_totalprice", X.hash_train_mask(["o_orderkey"], 0.2))
    return d.groupBy("o_orderpriority", F.round("o_orderpriority_te", 4).alias("o_orderpriority_te")) \
            .agg(F.count(F.lit(1)).alias("n"))


@register("pairwise_interactions", """
SELECT round(sum(l_quantity * l_discount), 4) AS q_d, round(sum(l_quantity * l_tax), 4) AS q_t,
       round(sum(l_discount * l_tax), 6) AS d_t FROM lineitem
""")
def pairwise_interactions(spark, sf):
    li = load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    d = X.pairwise_interactions(li, ["l_quantity", "l_discount", "l_tax"])
    return d.agg(F.round(F.sum("l_quantity_x_l_discount"), 4).alias("q_d"),
                 F.round(F.sum("l_quantity_x_l_tax"), 4).alias("q_t"),
                 F.round(F.sum("l_discount_x_l_tax"), 6).alias("d_t"))
