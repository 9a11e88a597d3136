"""U8-U11 over events (daily, by type) and lineitem (monthly, by return flag)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import series as T
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register


def daily(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def monthly(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.groupBy("l_returnflag", F.date_trunc("month", "l_shipdate").alias("month")).agg(
        F.sum("l_extendedprice").alias("revenue"))


@register("daily_series", """
SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY 1, 2
""")
def daily_series(spark, sf):
    return daily(spark, sf).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n",
                                   F.round("total", 4).alias("total"))


@register("series_plan", """
WITH g AS (SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY 1),
p AS (SELECT event_type, n, CASE WHEN n >= 60 THEN 12 WHEN n >= 28 THEN 7 ELSE 1 END AS period FROM g)
SELECT event_type, n, period, period > 1 AND n > 2 * period AS seasonal,
       CAST(greatest(6, least(24, n // 6)) AS INTEGER) AS horizon FROM p
""")
def series_plan(spark, sf):
    return T.series_plan(daily(spark, sf), ["event_type"])


@register("history_tail", """
WITH m AS (SELECT l_returnflag, date_trunc('month', l_shipdate) AS month, sum(l_extendedprice) AS revenue
           FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY month DESC) AS rk,
             count(*) OVER (PARTITION BY l_returnflag) AS c FROM m)
SELECT l_returnflag, month, round(revenue, 2) AS value, CAST(least(c, 60) - rk AS INTEGER) AS idx FROM r WHERE rk <= 60
""")
def history_tail(spark, sf):
    h = T.history_tail(monthly(spark, sf), ["l_returnflag"], "month", "revenue", 60)
    return h.select("l_returnflag", "month", F.round("value", 2).alias("value"), "idx")


@register("series_columns", """
WITH c AS (SELECT 1 AS pos, 'event_id' AS name, count(event_id) / count(*) AS num, 0 AS dates FROM events
           UNION ALL SELECT 2, 'ts', 0, count(ts) / count(*) FROM events
           UNION ALL SELECT 3, 'user_id', count(user_id) / count(*), 0 FROM events
           UNION ALL SELECT 4, 'event_type', count(TRY_CAST(event_type AS DOUBLE)) / count(*), count(TRY_CAST(event_type AS TIMESTAMP)) / count(*) FROM events
           UNION ALL SELECT 5, 'value', count(value) / count(*), 0 FROM events
           UNION ALL SELECT 6, 'props', count(TRY_CAST(props AS DOUBLE)) / count(*), count(TRY_CAST(props AS TIMESTAMP)) / count(*) FROM events)
SELECT (SELECT name FROM c WHERE num > 0.8 ORDER BY pos DESC LIMIT 1) AS value_col,
       (SELECT name FROM c WHERE num <= 0.8 AND dates > 0.8 ORDER BY pos LIMIT 1) AS date_col
""")
def series_columns(spark, sf):
    v, d = T.pick_columns(load(spark, sf, "events"))
    return spark.createDataFrame([(v, d)], "value_col string, date_col string")


@register("holt_winters")
def holt_winters(spark, sf):
    return T.holt_winters(monthly(spark, sf), ["l_returnflag"], "month", "revenue")


@register("holt_winters_daily")
def holt_winters_daily(spark, sf):
    return T.holt_winters(daily(spark, sf), ["event_type"], "day", "n")
