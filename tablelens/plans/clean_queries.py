"""C1-C15 over lineitem / customer / orders / documents and derived dirt."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import clean as C
from tablelens.plans.common import DIRTY_LINEITEM_SQL, dirty_lineitem, load, r6
from tablelens.plans.registry import register

NUM_RE = r"^\s*[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?\s*$"


def _num_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUM_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


@register("trim_columns", """
SELECT c_custkey AS "c_custkey", c_name AS "c_name", c_acctbal AS "c_acctbal" FROM customer
""")
def trim_columns(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias(" c_custkey "), F.col("c_name").alias("c_name  "),
                                           F.col("c_acctbal").alias("\tc_acctbal"))
    return C.trim_column_names(c)


@register("coerce_numeric", f"""
WITH d AS ({DIRTY_LINEITEM_SQL})
SELECT 'qty_text' AS column_name, count({_num_sql('qty_text')}) AS n_valid,
       count(qty_text) - count({_num_sql('qty_text')}) AS n_bad
FROM d HAVING count({_num_sql('qty_text')}) >= 0.8 * count(*)
UNION ALL
SELECT 'l_returnflag', count({_num_sql('l_returnflag')}), count(l_returnflag) - count({_num_sql('l_returnflag')})
FROM d HAVING count({_num_sql('l_returnflag')}) >= 0.8 * count(*) AND count({_num_sql('l_returnflag')}) > 0
""")
def coerce_numeric(spark, sf):
    d = dirty_lineitem(spark, sf).select("qty_text", "l_returnflag", "l_quantity", "l_shipdate")
    _, log = C.coerce_numeric(d)
    return log


@register("coerced_values", f"""
WITH d AS ({DIRTY_LINEITEM_SQL})
SELECT l_orderkey, {_num_sql('qty_text')} AS qty_text FROM d
""")
def coerced_values(spark, sf):
    d = dirty_lineitem(spark, sf).select("l_orderkey", "qty_text")
    out, _ = C.coerce_numeric(d)
    return out


def _id_sql() -> str:
    # customer: c_custkey is numeric and does not end in 'id'; c_name is unique short text
    return """
SELECT column_name FROM (
  SELECT 'c_name' AS column_name, count(DISTINCT c_name) + max(CASE WHEN c_name IS NULL THEN 1 ELSE 0 END) AS d,
         avg(length(coalesce(c_name, 'nan'))) AS l, count(*) AS n FROM customer
  UNION ALL
  SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) + max(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END),
         avg(length(coalesce(c_mktsegment, 'nan'))), count(*) FROM customer
) WHERE d = n AND l < 25
UNION ALL SELECT 'row_id'
"""


@register("drop_id_columns", _id_sql())
def drop_id_columns(spark, sf):
    c = load(spark, sf, "customer").withColumn("row_id", F.col("c_custkey") * 2)
    _, ids = C.drop_id_columns(c.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "row_id"))
    return spark.createDataFrame([(i,) for i in ids], "column_name string")


@register("drop_missing_target", f"""
WITH d AS ({DIRTY_LINEITEM_SQL})
SELECT count(*) AS rows_kept, (SELECT count(*) FROM d) - count(*) AS rows_dropped FROM d WHERE l_tax IS NOT NULL
""")
def drop_missing_target(spark, sf):
    d = dirty_lineitem(spark, sf)
    kept = C.drop_missing_target(d, "l_tax")
    return kept.agg(F.count(F.lit(1)).alias("rows_kept")).select(
        "rows_kept", (F.lit(d.count()) - F.col("rows_kept")).alias("rows_dropped"))


@register("finite_target", f"""
WITH d AS ({DIRTY_LINEITEM_SQL})
SELECT count(*) AS n, round(sum(y), 4) AS total FROM (SELECT {_num_sql('qty_text')} AS y FROM d) WHERE y IS NOT NULL
""")
def finite_target(spark, sf):
    d = C.finite_target(dirty_lineitem(spark, sf).select("qty_text"), "qty_text")
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("qty_text"), 4).alias("total"))


@register("auto_target", """
SELECT CASE WHEN (SELECT count(DISTINCT o_orderpriority) FROM orders) BETWEEN 2 AND 10 THEN 'o_orderpriority'
            WHEN (SELECT count(DISTINCT o_orderstatus) FROM orders) BETWEEN 2 AND 10 THEN 'o_orderstatus'
            ELSE 'o_orderpriority' END AS target
""")
def auto_target(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         "o_orderpriority")
    return spark.createDataFrame([(C.auto_target(o),)], "target string")


@register("task_kind", """
SELECT 'l_returnflag' AS target, 'classification' AS kind
UNION ALL SELECT 'l_quantity', CASE WHEN count(DISTINCT l_quantity) > 15 THEN 'regression' ELSE 'classification' END FROM lineitem
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) <= 15 THEN 'classification' ELSE 'regression' END FROM lineitem
UNION ALL SELECT 'l_discount', CASE WHEN count(DISTINCT l_discount) > 15 THEN 'regression' ELSE 'classification' END FROM lineitem
""")
def task_kind(spark, sf):
    li = load(spark, sf, "lineitem")
    cols = ["l_returnflag", "l_quantity", "l_linenumber", "l_discount"]
    dc = C.distinct_counts(li, cols)
    return spark.createDataFrame([(c, C.task_kind(li, c, dc[c])) for c in cols], "target string, kind string")


@register("high_card_text", """
SELECT column_name, CAST(d AS BIGINT) AS n_distinct, round(l, 4) AS mean_len FROM (
  SELECT 'text' AS column_name, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS d,
         avg(length(text)) AS l, count(*) AS n FROM documents
  UNION ALL
  SELECT 'lang', count(DISTINCT lang), avg(length(lang)), count(*) FROM documents
  UNION ALL
  SELECT 'source', count(DISTINCT source), avg(length(source)), count(*) FROM documents
) WHERE d > greatest(30, n * 0.5)
""")
def high_card_text(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return C.high_card_text(d).select("column_name", "n_distinct", F.round("mean_len", 4).alias("mean_len"))


@register("impute_median", f"""
WITH d AS ({DIRTY_LINEITEM_SQL})
SELECT round(sum(coalesce(l_tax, (SELECT median(l_tax) FROM d))), 6) AS tax_sum,
       round(sum(coalesce(l_discount, (SELECT median(l_discount) FROM d))), 6) AS disc_sum,
       count(*) AS n FROM d
""")
def impute_median(spark, sf):
    d = C.impute_median(dirty_lineitem(spark, sf).select("l_tax", "l_discount"))
    return d.agg(r6(F.sum("l_tax")).alias("tax_sum"), r6(F.sum("l_discount")).alias("disc_sum"),
                 F.count(F.lit(1)).alias("n"))


@register("label_encode", """
SELECT p_type AS value, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)
""")
def label_encode(spark, sf):
    return C.label_dictionary(load(spark, sf, "part"), "p_type")


@register("label_encoded_rows", f"""
WITH d AS ({DIRTY_LINEITEM_SQL}),
e AS (SELECT CASE WHEN l_quantity > 45 THEN NULL ELSE l_returnflag || l_linestatus END AS seg FROM d),
k AS (SELECT seg, dense_rank() OVER (ORDER BY seg) - 1 AS code FROM (SELECT DISTINCT seg FROM e WHERE seg IS NOT NULL))
SELECT CAST(coalesce(code, -1) AS INTEGER) AS seg, count(*) AS n FROM e LEFT JOIN k USING (seg) GROUP BY 1
""")
def label_encoded_rows(spark, sf):
    d = dirty_lineitem(spark, sf).select(
        F.when(F.col("l_quantity") > 45, None).otherwise(F.concat("l_returnflag", "l_linestatus")).alias("seg"))
    return C.label_encode(d, ["seg"]).groupBy("seg").agg(F.count(F.lit(1)).alias("n"))


@register("date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS d_year, CAST(month(o_orderdate) AS INTEGER) AS d_month,
       CAST(day(o_orderdate) AS INTEGER) AS d_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS d_dow
FROM orders
""")
def date_parts(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return C.date_parts(o)


@register("numeric_matrix", """
WITH k AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code
           FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT CAST(c_nationkey AS DOUBLE) AS c_nationkey, round(c_acctbal, 4) AS c_acctbal,
       CAST(code AS DOUBLE) AS c_mktsegment
FROM customer JOIN k USING (c_mktsegment)
""")
def numeric_matrix(spark, sf):
    c = load(spark, sf, "customer")
    m = C.numeric_matrix(c)
    return m.select("c_nationkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")


@register("top_variance_columns", """
SELECT column_name, round(variance, 4) AS variance FROM (
  SELECT 'l_quantity' AS column_name, var_samp(l_quantity) AS variance FROM lineitem
  UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem
  UNION ALL SELECT 'l_linenumber', var_samp(l_linenumber) FROM lineitem
) ORDER BY variance DESC LIMIT 3
""")
def top_variance_columns(spark, sf):
    li = load(spark, sf, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    top = C.top_variance_columns(li.select(*cols), 3)
    return C.variance_table(li, top).select("column_name", F.round("variance", 4).alias("variance"))


@register("drop_constant_columns", """
SELECT 'l_returnflag' AS column_name WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem) > 1
UNION ALL SELECT 'l_linestatus' WHERE (SELECT count(DISTINCT l_linestatus) FROM lineitem) > 1
""")
def drop_constant_columns(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.lit("k").alias("const"))
    kept = C.drop_constant_columns(li)
    return spark.createDataFrame([(c,) for c in kept.columns], "column_name string")


@register("infer_types", f"""
SELECT 0 AS pos, 'o_orderkey' AS column_name, 'number' AS kind
UNION ALL SELECT 1, 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) <= least(12, greatest(2, floor(count(*) / 2))) THEN 'category' ELSE 'text' END FROM orders
UNION ALL SELECT 2, 'o_orderdate', 'date'
UNION ALL SELECT 3, 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) <= least(12, greatest(2, floor(count(*) / 2))) THEN 'category' ELSE 'text' END FROM orders
""")
def infer_types(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus",
                                         F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                                         "o_orderpriority")
    return C.infer_ui_types(o)
