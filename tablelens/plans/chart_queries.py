"""Q1, K1, K2 over orders / lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import agg as G
from tablelens.operators import charts as C
from tablelens.operators import stats as S
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register
from tablelens.plans.sample_queries import hash_sql


@register("chart_spec_aggregate", """
WITH g AS (SELECT o_orderpriority AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1
           ORDER BY value DESC, label LIMIT 5)
SELECT label, round(value, 2) AS value, round(greatest(0.02, least(1.0, abs(value) / max(abs(value)) OVER ())), 6) AS scaled
FROM g
""")
def chart_spec_aggregate(spark, sf):
    spec = {"type": "bar", "title": "Revenue by priority",
            "source": {"kind": "aggregate", "groupby": "o_orderpriority", "of": "o_totalprice", "agg": "sum", "top": 5}}
    out = C.run_chart_spec(load(spark, sf, "orders"), spec)
    return out.select("label", F.round("value", 2).alias("value"), r6(F.col("scaled")).alias("scaled"))


@register("chart_spec_histogram", """
WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 12) AS INTEGER) + 1, 12) AS bin FROM lineitem, m)
SELECT bin, count(*) AS count FROM b GROUP BY bin
""")
def chart_spec_histogram(spark, sf):
    spec = {"type": "histogram", "source": {"kind": "distribution", "column": "l_extendedprice", "bins": 20}}
    return C.run_chart_spec(load(spark, sf, "lineitem"), spec).select("bin", "count").where(F.col("count") > 0)


@register("chart_spec_shares", """
WITH g AS (SELECT coalesce(CAST(o_orderstatus AS VARCHAR), 'nan') AS label, count(*) * 1.0 / sum(count(*)) OVER () AS value
           FROM orders GROUP BY 1 ORDER BY value DESC, label LIMIT 8)
SELECT label, round(value, 6) AS value FROM g
""")
def chart_spec_shares(spark, sf):
    spec = {"type": "pie", "source": {"kind": "distribution", "column": "o_orderstatus"}}
    return C.run_chart_spec(load(spark, sf, "orders"), spec).select("label", r6(F.col("value")).alias("value"))


@register("chart_spec_corr", """
WITH c AS (SELECT 'o_totalprice' AS a, 'o_custkey' AS b, corr(o_totalprice, o_custkey) AS r FROM orders
           UNION ALL SELECT 'o_totalprice', 'o_orderkey', corr(o_totalprice, o_orderkey) FROM orders
           UNION ALL SELECT 'o_custkey', 'o_orderkey', corr(o_custkey, o_orderkey) FROM orders)
SELECT a, b, round_even(coalesce(r, 0), 2) AS r FROM c UNION ALL SELECT b, a, round_even(coalesce(r, 0), 2) FROM c
UNION ALL SELECT x, x, 1.0 FROM (VALUES ('o_totalprice'), ('o_custkey'), ('o_orderkey')) t(x)
""")
def chart_spec_corr(spark, sf):
    spec = {"type": "heatmap", "source": {"kind": "corr_matrix", "columns": ["o_totalprice", "o_custkey", "o_orderkey",
                                                                              "o_orderstatus"]}}
    return C.run_chart_spec(load(spark, sf, "orders"), spec)


@register("chart_spec_invalid", """
SELECT CAST(2 + CASE WHEN (SELECT count(DISTINCT o_orderkey) FROM orders) <= greatest(40, 0.6 * (SELECT count(*) FROM orders))
                   THEN 1 ELSE 0 END AS BIGINT) AS cards
""")
def chart_spec_invalid(spark, sf):
    o = load(spark, sf, "orders")
    specs = [{"type": "bar", "source": {"kind": "aggregate", "groupby": "no_such_col"}},
             {"type": "sparkles", "source": {"kind": "distribution", "column": "o_totalprice"}},
             {"type": "bar", "source": {"kind": "aggregate", "groupby": "o_orderkey", "agg": "count"}},
             {"type": "column", "title": "a", "source": {"kind": "aggregate", "groupby": "o_orderstatus", "agg": "count"}},
             {"type": "histogram", "title": "b", "source": {"kind": "distribution", "column": "o_totalprice"}}]
    cards = C.run_chart_specs(o, specs)
    return spark.createDataFrame([(len(cards),)], "cards long")


def _graph_inputs(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("is_r", (F.col("l_returnflag") == "R").cast("int"))
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    bars = C.correlation_bars(li, feats, "is_r")
    pairs = S.corr_pairs(li, feats)
    dist = G.segment_rate(li, "l_linestatus", "l_returnflag", "R")
    return bars, pairs, dist


@register("relationship_graph", """
WITH c AS (SELECT 'l_quantity' AS label, 0 AS pos, corr(l_quantity, CAST(l_returnflag = 'R' AS INTEGER)) AS c FROM lineitem
           UNION ALL SELECT 'l_extendedprice', 1, corr(l_extendedprice, CAST(l_returnflag = 'R' AS INTEGER)) FROM lineitem
           UNION ALL SELECT 'l_discount', 2, corr(l_discount, CAST(l_returnflag = 'R' AS INTEGER)) FROM lineitem
           UNION ALL SELECT 'l_tax', 3, corr(l_tax, CAST(l_returnflag = 'R' AS INTEGER)) FROM lineitem),
b AS (SELECT label, greatest(0.04, least(1.0, abs(c) / max(abs(c)) OVER ())) AS value, CASE WHEN c < 0 THEN -1 ELSE 1 END AS sign
      FROM c),
s AS (SELECT l_linestatus AS label, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS value FROM lineitem GROUP BY 1)
SELECT '__target__' AS source, label AS target, round(value, 6) AS value, 'drives' AS kind, sign FROM b
UNION ALL SELECT '__target__', 'seg::' || label, round(value, 6), 'segment', 0 FROM s
""")
def relationship_graph(spark, sf):
    bars, pairs, dist = _graph_inputs(spark, sf)
    _, links = C.relationship_graph(bars, pairs, dist, "is_r")
    return links.select("source", "target", r6(F.col("value")).alias("value"), "kind", "sign")


@register("graph_nodes", """
WITH c AS (SELECT 'l_quantity' AS label, corr(l_quantity, CAST(l_returnflag = 'R' AS INTEGER)) AS c FROM lineitem
           UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, CAST(l_returnflag = 'R' AS INTEGER)) FROM lineitem
           UNION ALL SELECT 'l_discount', corr(l_discount, CAST(l_returnflag = 'R' AS INTEGER)) FROM lineitem
           UNION ALL SELECT 'l_tax', corr(l_tax, CAST(l_returnflag = 'R' AS INTEGER)) FROM lineitem),
b AS (SELECT label, greatest(0.04, least(1.0, abs(c) / max(abs(c)) OVER ())) AS value, CASE WHEN c < 0 THEN -1 ELSE 1 END AS sign
      FROM c),
s AS (SELECT l_linestatus AS label, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS value FROM lineitem GROUP BY 1)
SELECT '__target__' AS id, 'is_r' AS name, 'target' AS grp, 22.0 AS val, CAST(NULL AS INTEGER) AS sign
UNION ALL SELECT label, label, 'driver', round(6.0 + value * 16.0, 6), sign FROM b
UNION ALL SELECT 'seg::' || label, label, 'segment', round(5.0 + value * 9.0, 6), NULL FROM s
""")
def graph_nodes(spark, sf):
    bars, pairs, dist = _graph_inputs(spark, sf)
    nodes, _ = C.relationship_graph(bars, pairs, dist, "is_r")
    return nodes.select("id", "name", "grp", r6(F.col("val")).alias("val"), "sign")


@register("scatter_sample", f"""
WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS fx, CAST(o_custkey AS DOUBLE) AS fy, o_orderstatus AS t
           FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 140),
m AS (SELECT min(fx) AS x0, max(fx) AS x1, min(fy) AS y0, max(fy) AS y1 FROM s)
SELECT o_orderkey, round((fx - x0) / (x1 - x0), 6) AS x, round((fy - y0) / (y1 - y0), 6) AS y,
       CAST(t = 'F' AS INTEGER) AS c
FROM s, m
""")
def scatter_sample(spark, sf):
    o = load(spark, sf, "orders").withColumn("is_f", (F.col("o_orderstatus") == "F").cast("int"))
    s = C.scatter_sample(o, ["o_orderkey"], "o_totalprice", "o_custkey", "is_f", True)
    return s.select("o_orderkey", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), F.col("c").cast("int"))
