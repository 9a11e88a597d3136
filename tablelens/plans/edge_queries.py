"""Tables with NaN, infinities, NULL labels and whole-row checks; sources and sinks;
the rules that other queries reach only in passing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions.scalars import nonfinite_to_null, parse_compact
from tablelens.operators import agg as A
from tablelens.operators import clean as C
from tablelens.operators import evaluate as V
from tablelens.operators import features as X
from tablelens.operators import model as M
from tablelens.operators import profile as P
from tablelens.operators import sample as S
from tablelens.operators import stats as T
from tablelens.operators import text as TX
from tablelens.plans.common import load, r6
from tablelens.plans.profile_queries import _profile_sql
from tablelens.plans.registry import register
from tablelens.plans.sample_queries import hash_sql
from tablelens.plans.text_queries import _TC_SQL, all_docs

# lineitem with NaN tax on line 3, infinite discounts on line 5 and no flag on every fourth order
# (the oracles read what is not a number as missing)
NAN_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE l_discount END AS l_discount,
       CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag
FROM lineitem
"""
NAN_COLS = [("l_orderkey", "numeric"), ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
            ("l_tax", "numeric"), ("l_discount", "numeric"), ("l_returnflag", "string")]
D = f"WITH d AS ({NAN_SQL})"


def nan_lineitem(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_linenumber") == 5, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_orderkey") % 4 != 0, F.col("l_returnflag")).alias("l_returnflag"))


@register("profile_nan", _profile_sql(NAN_COLS, table=NAN_SQL))
def profile_nan(spark, sf):
    return P.profile_columns(nan_lineitem(spark, sf))


@register("median_nan", f"""
{D}, m AS (SELECT median(l_tax) AS t, median(l_discount) AS u FROM d)
SELECT count(*) AS n, round(sum(coalesce(l_tax, t)), 6) AS tax, round(sum(coalesce(l_discount, u)), 6) AS discount FROM d, m
""")
def median_nan(spark, sf):
    return C.impute_median(nan_lineitem(spark, sf), ["l_tax", "l_discount"]).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_tax"), 6).alias("tax"), F.round(F.sum("l_discount"), 6).alias("discount"))


@register("standardize_nan", f"""
{D}, z AS (SELECT l_orderkey, l_linenumber, (l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER () AS l_tax FROM d)
SELECT l_orderkey, l_linenumber, round(l_tax, 6) AS l_tax FROM z
""")
def standardize_nan(spark, sf):
    z = X.standardize(nan_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_tax"), ["l_tax"])
    return z.withColumn("l_tax", r6(F.col("l_tax")))


@register("minmax_nan", f"""
{D}, z AS (SELECT l_orderkey, l_linenumber, (l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()) AS l_discount FROM d)
SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS l_discount FROM z
""")
def minmax_nan(spark, sf):
    z = X.minmax(nan_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_discount"), ["l_discount"])
    return z.withColumn("l_discount", r6(F.col("l_discount")))


@register("box_nan", f"""
{D} SELECT 'class ' || l_returnflag AS label, min(l_tax) AS min, round(quantile_cont(l_tax, 0.25), 6) AS q1,
    round(median(l_tax), 6) AS med, round(quantile_cont(l_tax, 0.75), 6) AS q3, max(l_tax) AS max
FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1
""")
def box_nan(spark, sf):
    b = A.box_summary(nan_lineitem(spark, sf), "l_tax", "l_returnflag")
    return b.select("label", "min", *[r6(F.col(c)).alias(c) for c in ("q1", "med", "q3")], "max")


@register("corr_nan", f"""
{D}, p AS (SELECT 'l_tax' AS a, 'l_discount' AS b, corr(l_tax, l_discount) AS r FROM d
           UNION ALL SELECT 'l_tax', 'l_quantity', corr(l_tax, l_quantity) FROM d
           UNION ALL SELECT 'l_discount', 'l_quantity', corr(l_discount, l_quantity) FROM d)
SELECT a, b, round(r, 6) AS r FROM p
""")
def corr_nan(spark, sf):
    c = T.corr_long(nan_lineitem(spark, sf), ["l_tax", "l_discount", "l_quantity"])
    return c.select("a", "b", r6(F.col("r")).alias("r"))


@register("quality_nan", f"""
{D}, c AS (SELECT (1 - count(l_tax) / count(*)) + (1 - count(l_discount) / count(*)) + (1 - count(l_returnflag) / count(*)) AS miss,
                  count(*) AS n FROM d),
q AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS dup FROM d)
SELECT CAST(greatest(0, least(100, round_even(100 - miss / 7 * 140 - dup / n * 80, 0))) AS INTEGER) AS score,
       round_even(miss / 7 * 100, 1) AS missing, CAST(dup AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS constant_cols FROM c, q
""")
def quality_nan(spark, sf):
    """P2 over all columns."""
    return P.quality_score(nan_lineitem(spark, sf))


@register("duplicates_whole_rows", """
WITH d AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS BIGINT) AS duplicates FROM d
""")
def duplicates_whole_rows(spark, sf):
    """P3 on a table of which whole rows repeat."""
    return P.duplicate_rows(load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@register("split_null_labels", f"""
{D}, r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY {hash_sql("l_orderkey, l_linenumber")}, l_orderkey, l_linenumber) AS rk,
                  count(*) OVER (PARTITION BY l_returnflag) AS nc FROM d)
SELECT l_returnflag, CASE WHEN rk <= ceil(nc * 0.2) THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM r GROUP BY ALL
""")
def split_null_labels(spark, sf):
    d = S.stratified_split(nan_lineitem(spark, sf), "l_returnflag", ["l_orderkey", "l_linenumber"])
    return d.groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("n"))


@register("kfold_null_labels", f"""
{D}, r AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {hash_sql("l_orderkey, l_linenumber")}, l_orderkey, l_linenumber) AS rk FROM d)
SELECT l_returnflag, CAST((rk - 1) % 3 AS INTEGER) AS fold, count(*) AS n FROM r GROUP BY ALL
""")
def kfold_null_labels(spark, sf):
    d = S.kfold(nan_lineitem(spark, sf), ["l_orderkey", "l_linenumber"], k=3, label="l_returnflag")
    return d.groupBy("l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("nonfinite", f"""
{D} SELECT count(*) AS n, count(l_tax) AS taxes, count(l_discount) AS discounts, round(max(l_discount), 6) AS most FROM d
""")
def nonfinite(spark, sf):
    """S11."""
    d = nan_lineitem(spark, sf).select(*[nonfinite_to_null(F.col(c)).alias(c) for c in ("l_tax", "l_discount")])
    return d.agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("taxes"), F.count("l_discount").alias("discounts"),
                 r6(F.max("l_discount")).alias("most"))


@register("compact_numbers", """
SELECT o_orderkey, round(CASE WHEN o_totalprice >= 100000 THEN round(o_totalprice / 1000, 1) * 1000 ELSE round(o_totalprice, 0) END, 2) AS v
FROM orders
""")
def compact_numbers(spark, sf):
    """Prices shown as ``123.4k`` or ``98,765`` and read back."""
    p = F.col("o_totalprice")
    shown = F.when(p >= 100000, F.concat(F.format_string("%.1f", F.round(p / 1000, 1)), F.lit("k"))).otherwise(
        F.format_number(F.round(p, 0), 0))
    return load(spark, sf, "orders").select("o_orderkey", F.round(parse_compact(shown), 2).alias("v"))


def _scratch(spark, name):
    import uuid

    from tablelens.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/tablelens-{uuid.uuid4().hex}/{name}"


@register("csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, (SELECT count(*) FROM customer) AS rows FROM customer")
def csv_scan(spark, sf):
    """Customer written as CSV in several files, sized without parsing, and read back."""
    from tablelens.operators.ranks import attach_scalars
    from tablelens.sources import io
    c, path = load(spark, sf, "customer"), _scratch(spark, "customer_csv")
    io.write_result(c.repartition(3), path, "csv")
    return attach_scalars(io.read_csv(spark, path, schema=c.schema), io.source_row_count(spark, path, "csv"))


@register("json_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def json_scan(spark, sf):
    """Orders written as JSON lines and read back."""
    from tablelens.sources import io
    o, path = load(spark, sf, "orders").drop("o_orderdate"), _scratch(spark, "orders_json")
    io.write_result(o, path, "json")
    return io.read_json(spark, path, schema=o.schema)


@register("proportional_sample", f"""
SELECT event_id FROM events WHERE {hash_sql('event_id', 7)} / 4294967296.0 < 0.25
""")
def proportional_sample(spark, sf):
    """I5."""
    from tablelens.sources.io import proportional_sample as sample
    return sample(load(spark, sf, "events"), 0.25, ["event_id"], 7).select("event_id")


@register("preconditions", """
SELECT 'quality' AS target, 'classification' AS task, (SELECT count(quality) FROM labels) >= 8 AS usable
UNION ALL SELECT 'missing', 'classification', false
UNION ALL SELECT 'lang', 'regression', (SELECT count(TRY_CAST(lang AS DOUBLE)) FROM documents) >= 8
UNION ALL SELECT 'n_chars', 'regression', (SELECT count(n_chars) FROM documents) >= 8
""")
def preconditions(spark, sf):
    """Which targets a task can use."""
    tables = {"labels": load(spark, sf, "labels"), "documents": load(spark, sf, "documents")}

    def usable(table, target, task):
        try:
            M.check_preconditions(tables[table], target, task)
        except ValueError:
            return False
        return True
    asked = [("labels", "quality", "classification"), ("labels", "missing", "classification"),
             ("documents", "lang", "regression"), ("documents", "n_chars", "regression")]
    return spark.createDataFrame([(t, k, usable(d, t, k)) for d, t, k in asked], "target string, task string, usable boolean")


@register("verdict_silhouette", """
WITH s AS (SELECT avg(l_discount) * 8 AS v FROM lineitem),
l AS (SELECT CASE WHEN v >= 0.5 THEN 'excellent' WHEN v >= 0.35 THEN 'good' WHEN v >= 0.2 THEN 'fair' ELSE 'weak' END AS level FROM s)
SELECT level, CASE level WHEN 'excellent' THEN 'Well-separated segments' WHEN 'good' THEN 'Reasonably distinct segments'
       WHEN 'fair' THEN 'Overlapping segments' ELSE 'Weak segmentation' END AS label FROM l
""")
def verdict_silhouette(spark, sf):
    """P6, the cut-offs of clusterings, on a score between 0 and 1 that the table gives."""
    return V.verdict(load(spark, sf, "lineitem").agg((F.avg("l_discount") * 8).alias("value")), "silhouette")


@register("tfidf_matrix", f"""
WITH {_TC_SQL},
n AS (SELECT count(*) AS n FROM docs),
v AS (SELECT term, count(*) AS df FROM tc GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 300),
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tc JOIN v USING (term), n)
SELECT doc_id AS doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
""")
def tfidf_matrix(spark, sf):
    """E5: the feature matrix of the NLP models."""
    return TX.tfidf_matrix(all_docs(spark, sf), "doc_id", "text").withColumn("weight", r6(F.col("weight")))


@register("nlp_model_search")
def nlp_model_search(spark, sf):
    """M1 on text alone: quality labels from the documents' words."""
    docs = load(spark, sf, "documents").select("doc_id", "text").join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return M.model_search(M.prepare_supervised(docs, "quality", "nlp", key_cols=["doc_id"]))[0]


@register("forecast_shape", """
WITH m AS (SELECT l_returnflag, date_trunc('month', l_shipdate) AS t, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_returnflag, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 12),
p AS (SELECT *, CASE WHEN n >= 60 THEN 12 WHEN n >= 28 THEN 7 ELSE 1 END AS per, greatest(6, least(24, n // 6)) AS horizon FROM g)
SELECT l_returnflag, least(n, 60) AS history, horizon AS forecast, CAST(CASE WHEN n > 2 * per THEN per ELSE 1 END AS INTEGER) AS period FROM p
""")
def forecast_shape(spark, sf):
    """Points shown and forecast for each series, with its period."""
    from tablelens.operators.series import holt_winters
    from tablelens.plans.series_queries import monthly
    f = holt_winters(monthly(spark, sf), ["l_returnflag"], "month", "revenue")
    return f.groupBy("l_returnflag").agg(F.count(F.when(F.col("kind") == "history", 1)).alias("history"),
                                         F.count(F.when(F.col("kind") == "forecast", 1)).alias("forecast"), F.max("period").alias("period"))


@register("findings_drivers", """
WITH b AS (SELECT * FROM (VALUES ('charged', abs((SELECT corr(l_extendedprice * (1 - l_discount), l_extendedprice) FROM lineitem))),
                                 ('l_tax', abs((SELECT corr(l_tax, l_extendedprice) FROM lineitem))),
                                 ('l_discount', abs((SELECT corr(l_discount, l_extendedprice) FROM lineitem)))) t(label, c)),
v AS (SELECT label, greatest(0.04, c / max(c) OVER ()) AS value FROM b),
d AS (SELECT label, value, row_number() OVER (ORDER BY value DESC, label) AS rk FROM v),
g AS (SELECT CAST(floor(l_quantity / 10) AS INTEGER) AS label, avg(CAST(l_quantity >= 45 AS DOUBLE)) AS rate FROM lineitem GROUP BY 1),
s AS (SELECT label, rate / (SELECT avg(CAST(l_quantity >= 45 AS DOUBLE)) FROM lineitem) AS ratio FROM g ORDER BY rate DESC, CAST(label AS VARCHAR) LIMIT 1)
SELECT 'dominant_driver' AS rule, label AS subject, round(value, 6) AS value, 'info' AS kind FROM d
WHERE rk = 1 AND value >= 0.85 AND (SELECT value FROM d WHERE rk = 2) < 0.6
UNION ALL SELECT 'best_segment', CAST(label AS VARCHAR), round(ratio, 6), 'info' FROM s WHERE ratio >= 1.3
""")
def findings_drivers(spark, sf):
    """P5, the rules on drivers and segments."""
    from tablelens.operators.charts import correlation_bars
    li = load(spark, sf, "lineitem").withColumns({
        "big": (F.col("l_quantity") >= 45).cast("int"), "tens": F.floor(F.col("l_quantity") / 10).cast("int"),
        "charged": F.col("l_extendedprice") * (1 - F.col("l_discount"))})
    bars = correlation_bars(li, ["charged", "l_tax", "l_discount"], "l_extendedprice")
    segments = A.segment_rate(li, "tens", "big", 1, top=20)
    found = P.quality_findings(li.select("l_quantity", "big"), "big", 1, bars=bars, segments=segments)
    return found.where(F.col("rule").isin("dominant_driver", "best_segment")).select(
        "rule", "subject", r6(F.col("value")).alias("value"), "kind")


@register("headline_nan", f"""
{D} SELECT count(*) AS rows, 7 AS columns, round((3 * count(*) - count(l_tax) - count(l_discount) - count(l_returnflag)) / (7 * count(*)) * 100, 6) AS avg_missing_pct,
           (SELECT round(max(c) / sum(c), 6) FROM (SELECT count(*) AS c FROM d WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag)) AS majority_share
FROM d
""")
def headline_nan(spark, sf):
    """G7 where values are missing."""
    h = A.headline_stats(nan_lineitem(spark, sf), "l_returnflag", is_classification=True)
    return h.select("rows", "columns", r6(F.col("avg_missing_pct")).alias("avg_missing_pct"), r6(F.col("majority_share")).alias("majority_share"))


@register("learning_curve_sizes", f"""
WITH k AS (SELECT concat_ws('#', l_orderkey, l_linenumber) AS k FROM lineitem),
t AS (SELECT {hash_sql('k', 7)} / 4294967296.0 AS u, {hash_sql('k', 43)} % 3 AS fold FROM k WHERE {hash_sql('k')} / 4294967296.0 >= 0.2),
s AS (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0]) AS share)
SELECT CAST(count(*) FILTER (WHERE fold <> 0 AND u < share) AS BIGINT) AS n FROM t, s GROUP BY share
""")
def learning_curve_sizes(spark, sf):
    """Training rows behind each point of the learning curve (its scores are no SQL)."""
    from tablelens.plans.model_queries import learning_curve
    return learning_curve(spark, sf).select("n")


@register("smote_bounds", f"""
WITH t AS (SELECT toxic, n_chars FROM labels JOIN documents USING (doc_id) WHERE {hash_sql('doc_id')} / 4294967296.0 >= 0.2),
c AS (SELECT toxic, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi FROM t GROUP BY 1)
SELECT (SELECT max(n) - min(n) FROM c) AS synthetic, (SELECT count(*) FROM t) AS rows, true AS inside
""")
def smote_bounds(spark, sf):
    """Synthetic rows made, and whether all lie inside the range of the class they are of."""
    from tablelens.operators.oversample import smote
    from tablelens.operators.ranks import attach_scalars
    from tablelens.plans.model_queries import _smote_train
    out, info = smote(_smote_train(spark, sf), "toxic", ["n_chars", "words"], "doc_id")
    own = out.where((F.col("synthetic") == 0) & (F.col("toxic") == F.lit(info["minority"]))).agg(
        F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    made = attach_scalars(out, own)
    return made.agg(F.sum("synthetic").cast("long").alias("synthetic"), F.sum(1 - F.col("synthetic")).cast("long").alias("rows"),
                    F.min((F.col("synthetic") == 0) | F.col("n_chars").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)).alias("inside"))
