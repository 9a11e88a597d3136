"""D1-D4, D6 over orders / labels / events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import sample as S
from tablelens.plans.common import load
from tablelens.plans.registry import register


def hash_sql(keys: str, seed: int = 42) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('#', {keys}, '{seed}')), 1, 8)) AS BIGINT)"


@register("hash_sample", f"""
SELECT o_orderkey, o_totalprice FROM orders WHERE {hash_sql('o_orderkey')} / 4294967296.0 < 0.1
""")
def hash_sample(spark, sf):
    return S.hash_sample(load(spark, sf, "orders"), ["o_orderkey"], 0.1).select("o_orderkey", "o_totalprice")


@register("hash_sample_n", f"""
SELECT o_orderkey FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 200
""")
def hash_sample_n(spark, sf):
    return S.hash_sample_n(load(spark, sf, "orders"), ["o_orderkey"], 200).select("o_orderkey")


@register("stratified_split", f"""
WITH r AS (SELECT toxic, row_number() OVER (PARTITION BY toxic ORDER BY {hash_sql('doc_id')}, doc_id) AS rk,
                  count(*) OVER (PARTITION BY toxic) AS nc FROM labels)
SELECT toxic, CASE WHEN rk <= ceil(nc * 0.2) THEN 'test' ELSE 'train' END AS split, count(*) AS n
FROM r GROUP BY ALL
""")
def stratified_split(spark, sf):
    d = S.stratified_split(load(spark, sf, "labels"), "toxic", ["doc_id"], 0.2)
    return d.groupBy("toxic", "split").agg(F.count(F.lit(1)).alias("n"))


@register("kfold", f"""
WITH r AS (SELECT o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey')}, o_orderkey) AS rk
           FROM orders)
SELECT o_orderstatus, CAST((rk - 1) % 5 AS INTEGER) AS fold, count(*) AS n FROM r GROUP BY ALL
""")
def kfold(spark, sf):
    d = S.kfold(load(spark, sf, "orders"), ["o_orderkey"], label="o_orderstatus")
    return d.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("kfold_plain", f"""
SELECT CAST({hash_sql('o_orderkey')} % 5 AS INTEGER) AS fold, count(*) AS n FROM orders GROUP BY 1
""")
def kfold_plain(spark, sf):
    d = S.kfold(load(spark, sf, "orders"), ["o_orderkey"])
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("thin_curve", """
WITH g AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, count(*) AS n
           FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY day) AS rk, count(*) OVER () AS tot FROM g)
SELECT day, n FROM r WHERE (rk - 1) % greatest(1, tot // 10) = 0
""")
def thin_curve(spark, sf):
    e = load(spark, sf, "events")
    g = e.groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")) \
         .agg(F.count(F.lit(1)).alias("n"))
    return S.thin(g, "day", 10)


@register("class_balance", f"""
WITH b AS (SELECT CAST(toxic AS VARCHAR) AS label, count(*) AS before FROM labels GROUP BY 1),
a AS (SELECT CAST(toxic AS VARCHAR) AS label, count(*) AS after FROM labels
      WHERE {hash_sql('doc_id')} / 4294967296.0 >= 0.2 GROUP BY 1)
SELECT label, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM b FULL JOIN a USING (label)
""")
def class_balance(spark, sf):
    lab = load(spark, sf, "labels")
    train = S.random_split(lab, ["doc_id"], 0.2).where(F.col("split") == "train")
    return S.class_balance(lab, train, "toxic")
