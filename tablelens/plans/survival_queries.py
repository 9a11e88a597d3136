"""U12-U15 on lineitem: T = l_quantity, E = (l_returnflag = 'R')."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import survival as V
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register


def frame(spark, sf):
    li = load(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("churn"),
                                            F.col("l_quantity").alias("tenure"))
    return V.survival_frame(li, "tenure", "churn")


_KM_SQL = """
WITH g AS (SELECT l_quantity AS t, sum(CAST(l_returnflag = 'R' AS INTEGER)) AS events, count(*) AS c
           FROM lineitem GROUP BY 1),
r AS (SELECT t, events, CAST(sum(c) OVER (ORDER BY t DESC) AS BIGINT) AS at_risk FROM g),
l AS (SELECT *, CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END AS lg,
             CASE WHEN events >= at_risk AND events > 0 THEN 1 ELSE 0 END AS z FROM r),
k AS (SELECT t, at_risk, events, CASE WHEN sum(z) OVER (ORDER BY t) > 0 THEN 0.0 ELSE exp(sum(lg) OVER (ORDER BY t)) END AS s
      FROM l),
curve AS (SELECT t, at_risk, CAST(events AS BIGINT) AS events, s FROM k
          UNION ALL SELECT 0.0, (SELECT count(*) FROM lineitem), 0, 1.0 WHERE (SELECT min(l_quantity) FROM lineitem) > 0)
"""


@register("kaplan_meier", _KM_SQL + "SELECT t, at_risk, events, round(s, 6) AS s FROM curve")
def kaplan_meier(spark, sf):
    c = V.kaplan_meier(frame(spark, sf))
    return c.select("t", "at_risk", "events", r6(F.col("s")).alias("s"))


@register("km_curve", _KM_SQL + """,
n AS (SELECT *, row_number() OVER (ORDER BY t) AS rk, count(*) OVER () AS m FROM curve)
SELECT t, round(s, 4) AS s FROM n WHERE (rk - 1) % greatest(1, m // 40) = 0
""")
def km_curve(spark, sf):
    c = V.km_thinned(V.kaplan_meier(frame(spark, sf)))
    return c.select("t", F.round("s", 4).alias("s"))


@register("km_median", _KM_SQL + "SELECT coalesce(min(t) FILTER (WHERE s <= 0.5), max(t)) AS median FROM curve")
def km_median(spark, sf):
    return V.km_median(V.kaplan_meier(frame(spark, sf)))


@register("event_rate", """
SELECT count(*) AS subjects, CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS events,
       round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS event_rate,
       round(1 - avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS censored
FROM lineitem
""")
def event_rate(spark, sf):
    e = V.event_rate(frame(spark, sf))
    return e.select("subjects", "events", r6(F.col("event_rate")).alias("event_rate"),
                    r6(F.col("censored")).alias("censored"))


@register("survival_columns", """
SELECT 'churn' AS event, CASE WHEN count(l_quantity) > 0.8 * count(*) THEN 'tenure'
       WHEN count(l_extendedprice) > 0.8 * count(*) AND count(*) FILTER (WHERE l_extendedprice >= 0) > 0.9 * count(l_extendedprice)
       THEN 'amount' END AS duration FROM lineitem
""")
def survival_columns(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"),
                                            (F.col("l_returnflag") == "R").cast("int").alias("churn"),
                                            F.col("l_extendedprice").alias("amount"),
                                            F.col("l_quantity").alias("tenure"))
    ev, dur = V.choose_columns(li, "churn")
    return spark.createDataFrame([(ev, dur)], "event string, duration string")


@register("cox_hazards")
def cox_hazards(spark, sf):
    li = load(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("E"),
                                            F.col("l_quantity").alias("T"), "l_extendedprice", "l_discount", "l_tax")
    hr = V.cox_ph(li, "T", "E", ["l_extendedprice", "l_discount", "l_tax"])
    return V.hazard_bars(hr)
