"""M3-M9, M12, M15, T18 on deterministic pseudo-scores derived from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import evaluate as V
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register
from tablelens.plans.sample_queries import hash_sql


def scored(spark, sf):
    li = load(spark, sf, "lineitem")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("l_discount") * 6 + F.col("l_tax") * 2
                                       + F.when(F.col("l_linestatus") == "F", 0.1).otherwise(0.0)))
    cls = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     F.round(p, 4).alias("p"), (F.round(p, 4) >= 0.5).cast("int").alias("pred"),
                     "l_returnflag", cls.alias("pred_cls"), "l_extendedprice",
                     (F.col("l_quantity") * 1500.0 + 1000.0).alias("price_hat"))


SCORED_SQL = """
SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y,
       round(least(1.0, greatest(0.0, l_discount * 6 + l_tax * 2 + CASE WHEN l_linestatus = 'F' THEN 0.1 ELSE 0.0 END)), 4) AS p,
       CAST(round(least(1.0, greatest(0.0, l_discount * 6 + l_tax * 2 + CASE WHEN l_linestatus = 'F' THEN 0.1 ELSE 0.0 END)), 4) >= 0.5 AS INTEGER) AS pred,
       l_returnflag, ['A', 'N', 'R'][l_linenumber % 3 + 1] AS pred_cls, l_extendedprice,
       l_quantity * 1500.0 + 1000.0 AS price_hat
FROM lineitem
"""


@register("confusion", f"""
WITH d AS ({SCORED_SQL}), l AS (SELECT DISTINCT l_returnflag AS v FROM d UNION SELECT DISTINCT pred_cls FROM d),
c AS (SELECT l_returnflag AS actual, pred_cls AS predicted, count(*) AS n FROM d GROUP BY 1, 2)
SELECT a.v AS actual, b.v AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v
""")
def confusion(spark, sf):
    return V.confusion(scored(spark, sf), "l_returnflag", "pred_cls")


_PER_CLASS_SQL = f"""
WITH d AS ({SCORED_SQL}),
s AS (SELECT l_returnflag AS label, count(*) AS support FROM d GROUP BY 1),
p AS (SELECT pred_cls AS label, count(*) AS npred FROM d GROUP BY 1),
t AS (SELECT l_returnflag AS label, count(*) AS tp FROM d WHERE l_returnflag = pred_cls GROUP BY 1),
m AS (SELECT label, coalesce(tp, 0) * 1.0 / npred AS pr, coalesce(tp, 0) * 1.0 / support AS rc
      FROM s JOIN p USING (label) LEFT JOIN t USING (label))
SELECT label, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1, support FROM m JOIN s USING (label)
"""


@register("per_class", _PER_CLASS_SQL)
def per_class(spark, sf):
    pc = V.per_class(scored(spark, sf), "l_returnflag", "pred_cls")
    return pc.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("classification_metrics", f"""
WITH d AS ({SCORED_SQL}),
tp AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE pred = 1) AS pp,
              count(*) FILTER (WHERE y = 1) AS ap, avg(CAST(y = pred AS DOUBLE)) AS acc FROM d),
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS mr FROM d),
auc AS (SELECT (sum(mr) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
               / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM r)
SELECT 'Accuracy' AS metric, round(acc, 6) AS value FROM tp
UNION ALL SELECT 'Precision', round(coalesce(tp * 1.0 / nullif(pp, 0), 0), 6) FROM tp
UNION ALL SELECT 'Recall', round(coalesce(tp * 1.0 / nullif(ap, 0), 0), 6) FROM tp
UNION ALL SELECT 'F1', round(coalesce(2.0 * tp / nullif(pp + ap, 0), 0), 6) FROM tp
UNION ALL SELECT 'ROC-AUC', round(auc, 6) FROM auc
""")
def classification_metrics(spark, sf):
    m = V.classification_metrics(scored(spark, sf), "y", "pred", positive=1, score="p")
    return m.select("metric", r6(F.col("value")).alias("value"))


@register("macro_metrics", f"""
WITH pc AS ({_PER_CLASS_SQL})
SELECT 'Accuracy' AS metric, round((SELECT avg(CAST(l_returnflag = pred_cls AS DOUBLE)) FROM ({SCORED_SQL})), 6) AS value
UNION ALL SELECT 'Precision', round(avg(precision), 6) FROM pc
UNION ALL SELECT 'Recall', round(avg(recall), 6) FROM pc
UNION ALL SELECT 'F1', round(avg(f1), 6) FROM pc
""")
def macro_metrics(spark, sf):
    m = V.classification_metrics(scored(spark, sf), "l_returnflag", "pred_cls")
    return m.select("metric", r6(F.col("value")).alias("value"))


_POINTS_SQL = f"""
WITH d AS ({SCORED_SQL}),
g AS (SELECT p AS s, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY p),
c AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
             row_number() OVER (ORDER BY s DESC) AS i, sum(pos) OVER () AS P, sum(neg) OVER () AS N,
             count(*) OVER () AS m FROM g)
"""


@register("roc_curve", _POINTS_SQL + """,
k AS (SELECT *, lag(tp) OVER (ORDER BY i) AS tp_prev, lag(fp) OVER (ORDER BY i) AS fp_prev,
             lead(tp) OVER (ORDER BY i) AS tp_next, lead(fp) OVER (ORDER BY i) AS fp_next FROM c),
kept AS (SELECT * FROM k WHERE i = 1 OR tp_next IS NULL OR tp_next - 2 * tp + coalesce(tp_prev, 0) <> 0
                               OR fp_next - 2 * fp + coalesce(fp_prev, 0) <> 0),
curve AS (SELECT 0 AS k, 0.0 AS x, 0.0 AS y
          UNION ALL SELECT row_number() OVER (ORDER BY i), fp * 1.0 / N, tp * 1.0 / P FROM kept),
n AS (SELECT count(*) AS n FROM curve)
SELECT CAST(k AS BIGINT) AS k, round(x, 6) AS x, round(y, 6) AS y FROM curve, n WHERE k % greatest(1, n // 40) = 0
""")
def roc_curve(spark, sf):
    c = V.roc_curve(scored(spark, sf), "y", "p", 1)
    return c.select("k", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@register("pr_curve", _POINTS_SQL + """,
curve AS (SELECT m - i AS k, tp * 1.0 / P AS x, tp * 1.0 / (tp + fp) AS y FROM c
          UNION ALL SELECT max(m), 0.0, 1.0 FROM c),
n AS (SELECT count(*) AS n FROM curve)
SELECT CAST(k AS BIGINT) AS k, round(x, 6) AS x, round(y, 6) AS y FROM curve, n WHERE k % greatest(1, n // 40) = 0
""")
def pr_curve(spark, sf):
    c = V.pr_curve(scored(spark, sf), "y", "p", 1)
    return c.select("k", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@register("average_precision", _POINTS_SQL + """
SELECT round(sum(pos * 1.0 / P * tp / (tp + fp)), 6) AS ap FROM c
""")
def average_precision(spark, sf):
    return V.average_precision(scored(spark, sf), "y", "p", 1).select(r6(F.col("ap")).alias("ap"))


@register("calibration", f"""
WITH d AS ({SCORED_SQL}),
e AS (SELECT quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM d),
b AS (SELECT p, y, len(list_filter(q, lambda x: x < p)) AS bin FROM d, e)
SELECT CAST(bin AS INTEGER) AS bin, round(avg(p), 6) AS x, round(avg(y), 6) AS y FROM b GROUP BY bin
""")
def calibration(spark, sf):
    c = V.calibration(scored(spark, sf), "y", "p", 1)
    return c.select("bin", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@register("regression_metrics", f"""
WITH d AS ({SCORED_SQL})
SELECT 'R2' AS metric, round(1 - avg(power(l_extendedprice - price_hat, 2)) / var_pop(l_extendedprice), 6) AS value FROM d
UNION ALL SELECT 'RMSE', round(sqrt(avg(power(l_extendedprice - price_hat, 2))), 4) FROM d
UNION ALL SELECT 'MAE', round(avg(abs(l_extendedprice - price_hat)), 4) FROM d
UNION ALL SELECT 'MAPE', round(avg(CASE WHEN abs(l_extendedprice) >= 1e-9 THEN abs((l_extendedprice - price_hat) / l_extendedprice) END) * 100, 6) FROM d
""")
def regression_metrics(spark, sf):
    m = V.regression_metrics(scored(spark, sf), "l_extendedprice", "price_hat")
    return m.select("metric", F.when(F.col("metric").isin("RMSE", "MAE"), F.round("value", 4))
                    .otherwise(r6(F.col("value"))).alias("value"))


@register("residual_sample", f"""
WITH d AS ({SCORED_SQL})
SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, price_hat AS pred FROM d
ORDER BY {hash_sql('l_orderkey, l_linenumber')}, l_orderkey, l_linenumber LIMIT 200
""")
def residual_sample(spark, sf):
    return V.residual_sample(scored(spark, sf), ["l_orderkey", "l_linenumber"], "l_extendedprice", "price_hat")


# what-if: empirical curves of mean order total per acctbal / nation bin, applied to every customer
def _whatif_inputs(spark, sf):
    c = load(spark, sf, "customer")
    o = load(spark, sf, "orders")
    spend = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"))
    cs = c.join(spend, c.c_custkey == spend.o_custkey, "left").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"),
        F.coalesce("spend", F.lit(0.0)).alias("spend"))
    mm = cs.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).first()
    b = F.least(F.floor((F.col("c_acctbal") - mm["lo"]) / (mm["hi"] - mm["lo"]) * 10), F.lit(9.0)).cast("int")
    curve_a = cs.groupBy(b.alias("i")).agg(F.avg("c_acctbal").alias("x"), F.avg("spend").alias("pred")) \
                .withColumn("feature", F.lit("c_acctbal"))
    curve_n = cs.groupBy(F.floor(F.col("c_nationkey") / 5).cast("int").alias("i")) \
                .agg(F.avg("c_nationkey").alias("x"), F.avg("spend").alias("pred")).withColumn("feature", F.lit("c_nationkey"))
    curves = curve_a.unionByName(curve_n)
    base = cs.agg(F.avg("spend")).first()[0]
    return cs, curves, base


@register("whatif_score", """
WITH sp AS (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY 1),
cs AS (SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, coalesce(spend, 0.0) AS spend
       FROM customer LEFT JOIN sp ON c_custkey = o_custkey),
mm AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(spend) AS base FROM cs),
cu AS (SELECT 'c_acctbal' AS feature, CAST(least(floor((c_acctbal - lo) / (hi - lo) * 10), 9) AS INTEGER) AS i,
              avg(c_acctbal) AS x, avg(spend) AS pred FROM cs, mm GROUP BY 2
       UNION ALL SELECT 'c_nationkey', CAST(floor(c_nationkey / 5) AS INTEGER), avg(c_nationkey), avg(spend) FROM cs GROUP BY 2),
ends AS (SELECT feature, arg_min(pred, i) AS p_first, min(x) AS x_first, arg_max(pred, i) AS p_last, max(x) AS x_last
         FROM cu GROUP BY 1),
seg AS (SELECT a.feature, a.i, a.x AS x0, a.pred AS p0, b.x AS x1, b.pred AS p1
        FROM cu a JOIN cu b ON a.feature = b.feature AND b.i = a.i + 1),
lng AS (SELECT c_custkey, 'c_acctbal' AS feature, c_acctbal AS v FROM cs
        UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey FROM cs),
j AS (SELECT l.c_custkey, l.feature, s.i,
             CASE WHEN v <= x_first THEN p_first WHEN v >= x_last THEN p_last
                  WHEN v BETWEEN x0 AND x1 THEN p0 + (v - x0) / CASE WHEN x1 = x0 THEN 1 ELSE x1 - x0 END * (p1 - p0) END AS val
      FROM lng l JOIN seg s USING (feature) JOIN ends USING (feature)),
per AS (SELECT c_custkey, feature, arg_min(val, i) AS val FROM j WHERE val IS NOT NULL GROUP BY 1, 2)
SELECT c_custkey, round((SELECT base FROM mm) + sum(val - (SELECT base FROM mm)), 4) AS score FROM per GROUP BY 1
""")
def whatif_score(spark, sf):
    cs, curves, base = _whatif_inputs(spark, sf)
    s = V.whatif_score(cs, ["c_custkey"], curves, base)
    return s.select("c_custkey", F.round("score", 4).alias("score"))


def _verdict_sql(score_sql: str, cuts, labels) -> str:
    hi, mid, lo = cuts
    lab = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in labels.items())
    return f"""
WITH s AS ({score_sql}),
l AS (SELECT CASE WHEN value >= {hi} THEN 'excellent' WHEN value >= {mid} THEN 'good'
                  WHEN value >= {lo} THEN 'fair' ELSE 'weak' END AS level FROM s)
SELECT level, CASE level {lab} END AS label FROM l
"""


_AUC_SQL = f"""
WITH d AS ({SCORED_SQL}),
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS mr FROM d)
SELECT (sum(mr) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
       / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS value FROM r
"""

_LIFT_SQL = f"""
WITH d AS ({SCORED_SQL})
SELECT avg(CAST(l_returnflag = pred_cls AS DOUBLE))
       - (SELECT max(c) * 1.0 / sum(c) FROM (SELECT count(*) AS c FROM d GROUP BY l_returnflag)) AS value FROM d
"""


@register("verdict_auc", _verdict_sql(_AUC_SQL, V.VERDICT_CUTS["auc"], V.VERDICT_LABELS))
def verdict_auc(spark, sf):
    auc = V.roc_auc(scored(spark, sf), "y", "p", 1).select(F.col("auc").alias("value"))
    return V.verdict(auc, "auc")


@register("verdict_lift", _verdict_sql(_LIFT_SQL, V.VERDICT_CUTS["lift"], V.VERDICT_LABELS))
def verdict_lift(spark, sf):
    from tablelens.operators.ranks import attach_scalars
    d = scored(spark, sf)
    acc = d.agg(F.avg((F.col("l_returnflag") == F.col("pred_cls")).cast("double")).alias("acc"))
    maj = d.groupBy("l_returnflag").count().agg((F.max("count") / F.sum("count")).alias("maj"))
    lift = attach_scalars(acc, maj).select((F.col("acc") - F.col("maj")).alias("value"))
    return V.verdict(lift, "lift")


@register("verdict_r2", _verdict_sql(f"""
WITH d AS ({SCORED_SQL})
SELECT 1 - avg(power(l_extendedprice - price_hat, 2)) / var_pop(l_extendedprice) AS value FROM d
""", V.VERDICT_CUTS["r2"], V.VERDICT_LABELS))
def verdict_r2(spark, sf):
    m = V.regression_metrics(scored(spark, sf), "l_extendedprice", "price_hat").where(F.col("metric") == "R2")
    return V.verdict(m, "r2")
