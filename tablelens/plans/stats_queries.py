"""A1-A4 and H1-H8 over lineitem / orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import stats as S
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_union(cols):
    from itertools import combinations
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, {i} AS pos FROM lineitem"
                              for i, (a, b) in enumerate(combinations(cols, 2)))


@register("corr_pairs", f"""
SELECT a, b, round_even(abs(r), 2) AS r FROM ({_corr_union(NUM + ['l_linenumber'])})
WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY round_even(abs(r), 2) DESC, pos LIMIT 6
""")
def corr_pairs(spark, sf):
    return S.corr_pairs(load(spark, sf, "lineitem"), NUM + ["l_linenumber"], top=6)


@register("corr_matrix", f"""
WITH c AS ({_corr_union(NUM)})
SELECT a, b, round_even(coalesce(r, 0), 2) AS r FROM c UNION ALL SELECT b, a, round_even(coalesce(r, 0), 2) FROM c
UNION ALL SELECT x, x, 1.0 FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(x)
""")
def corr_matrix(spark, sf):
    return S.corr_matrix(load(spark, sf, "lineitem"), NUM)


@register("direction_signs", """
SELECT 'l_quantity' AS feature, CAST(coalesce(nullif(sign(corr(l_quantity, l_extendedprice)), 0), 1) AS INTEGER) AS sign FROM lineitem
UNION ALL SELECT 'l_discount', CAST(coalesce(nullif(sign(corr(l_discount, l_extendedprice)), 0), 1) AS INTEGER) FROM lineitem
UNION ALL SELECT 'l_tax', CAST(coalesce(nullif(sign(corr(l_tax, l_extendedprice)), 0), 1) AS INTEGER) FROM lineitem
""")
def direction_signs(spark, sf):
    return S.direction_signs(load(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


def _moments_sql(features, group, table="lineitem"):
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({group} AS VARCHAR) AS grp, count({f}) AS n, avg({f}) AS mean, "
        f"var_samp({f}) AS var FROM {table} WHERE {group} IS NOT NULL AND {f} IS NOT NULL GROUP BY 2"
        for f in features)


@register("welch_t", f"""
WITH m AS ({_moments_sql(['l_extendedprice', 'l_quantity', 'l_discount'], 'l_linestatus')}),
o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY grp) AS i FROM m),
a AS (SELECT * FROM o WHERE i = 1), b AS (SELECT * FROM o WHERE i = 2)
SELECT a.feature, a.grp AS grp1, b.grp AS grp2, a.n AS n1, b.n AS n2,
       round((a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n), 6) AS stat,
       round(abs(a.mean - b.mean) / sqrt((a.var + b.var) / 2), 6) AS effect
FROM a JOIN b USING (feature)
""")
def welch_t(spark, sf):
    mom = S.group_moments(load(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], "l_linestatus")
    w = S.welch_t(mom)
    return w.select("feature", "grp1", "grp2", "n1", "n2", r6(F.col("stat")).alias("stat"),
                    r6(F.col("effect")).alias("effect"))


@register("mann_whitney", """
WITH r AS (SELECT l_linestatus AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS mr
           FROM lineitem),
s AS (SELECT g, sum(mr) AS R, count(*) AS n FROM r GROUP BY g),
o AS (SELECT *, row_number() OVER (ORDER BY g) AS i FROM s)
SELECT 'l_quantity' AS feature, a.g AS grp1, b.g AS grp2, a.n AS n1, b.n AS n2, round(a.R - a.n * (a.n + 1) / 2.0, 4) AS stat
FROM o a, o b WHERE a.i = 1 AND b.i = 2
""")
def mann_whitney(spark, sf):
    u = S.mann_whitney(load(spark, sf, "lineitem"), ["l_quantity"], "l_linestatus")
    return u.select("feature", "grp1", "grp2", "n1", "n2", F.round("stat", 4).alias("stat"))


@register("anova", f"""
WITH m AS ({_moments_sql(['l_extendedprice', 'l_discount'], 'l_returnflag')}),
g AS (SELECT feature, count(*) AS k, sum(n) AS N, sum(n * mean) AS sx, sum(n * mean * mean) AS snm2,
             sum((n - 1) * var) AS ssw FROM m WHERE n >= 3 GROUP BY feature)
SELECT feature, k, CAST(N AS BIGINT) AS N, round(((snm2 - sx * sx / N) / (k - 1)) / (ssw / (N - k)), 6) AS stat,
       round((snm2 - sx * sx / N) / ((snm2 - sx * sx / N) + ssw), 8) AS eta2
FROM g
""")
def anova(spark, sf):
    mom = S.group_moments(load(spark, sf, "lineitem"), ["l_extendedprice", "l_discount"], "l_returnflag")
    a = S.anova(mom)
    return a.select("feature", "k", "N", r6(F.col("stat")).alias("stat"), F.round("eta2", 8).alias("eta2"))


@register("kruskal", """
WITH r AS (SELECT l_returnflag AS g, l_quantity AS x,
                  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS mr FROM lineitem),
s AS (SELECT g, sum(mr) AS R, count(*) AS n FROM r GROUP BY g),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)),
h AS (SELECT count(*) AS k, sum(n) AS n, sum(R * R / n) AS s FROM s)
SELECT 'l_quantity' AS feature, k, CAST(n AS BIGINT) AS n, round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS stat
FROM h, t
""")
def kruskal(spark, sf):
    k = S.kruskal(load(spark, sf, "lineitem"), ["l_quantity"], "l_returnflag")
    return k.select("feature", "k", "n", r6(F.col("stat")).alias("stat"))


@register("chi_square", """
WITH c AS (SELECT l_returnflag AS v, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2),
rt AS (SELECT v, sum(o) AS rt FROM c GROUP BY v), ct AS (SELECT y, sum(o) AS ct FROM c GROUP BY y),
n AS (SELECT sum(o) AS n FROM c)
SELECT 'l_returnflag' AS feature, round(sum(o * o / (rt * ct / n)) - any_value(n), 6) AS stat,
       round(sqrt((sum(o * o / (rt * ct / n)) - any_value(n)) / (any_value(n) * 1)), 6) AS effect
FROM c JOIN rt USING (v) JOIN ct USING (y), n
""")
def chi_square(spark, sf):
    ch = S.chi_square(load(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus")
    return ch.select("feature", r6(F.col("stat")).alias("stat"), r6(F.col("effect")).alias("effect"))


_YATES_SRC = """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'y' ELSE 'n' END AS urgent,
       CASE WHEN o_orderstatus = 'F' THEN 'y' ELSE 'n' END AS filled FROM orders"""


@register("chi_square_yates", f"""
WITH d AS ({_YATES_SRC}),
c AS (SELECT urgent AS v, filled AS y, count(*) AS o FROM d GROUP BY 1, 2),
rt AS (SELECT v, sum(o) AS rt FROM c GROUP BY v), ct AS (SELECT y, sum(o) AS ct FROM c GROUP BY y),
n AS (SELECT sum(o) AS n FROM c),
g AS (SELECT rt.v, ct.y, rt.rt * ct.ct / n.n AS e, coalesce(c.o, 0) AS o FROM rt, ct, n LEFT JOIN c ON c.v = rt.v AND c.y = ct.y)
SELECT 'urgent' AS feature,
       round(sum(power(o + least(0.5, abs(e - o)) * sign(e - o) - e, 2) / e), 6) AS stat FROM g
""")
def chi_square_yates(spark, sf):
    o = load(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "y").otherwise("n").alias("urgent"),
        F.when(F.col("o_orderstatus") == "F", "y").otherwise("n").alias("filled"))
    ch = S.chi_square(o, ["urgent"], "filled")
    return ch.select("feature", r6(F.col("stat")).alias("stat"))


@register("pearson", """
SELECT 'l_quantity' AS feature, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS stat FROM lineitem
UNION ALL SELECT 'l_discount', count(*), round(corr(l_discount, l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_tax', count(*), round(corr(l_tax, l_extendedprice), 6) FROM lineitem
""")
def pearson(spark, sf):
    p = S.pearson(load(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return p.select("feature", "n", r6(F.col("stat")).alias("stat"))


@register("jarque_bera", """
WITH d AS (SELECT l_returnflag AS g, l_extendedprice AS x, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS mu
           FROM lineitem),
m AS (SELECT g, count(*) AS n, avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3, avg(power(x - mu, 4)) AS m4
      FROM d GROUP BY g)
SELECT g AS grp, n, round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 4) AS jb FROM m
""")
def jarque_bera(spark, sf):
    mom = S.jarque_bera(S.group_moments(load(spark, sf, "lineitem"), ["l_extendedprice"], "l_returnflag"))
    return mom.select("grp", "n", F.round("jb", 4).alias("jb"))


@register("shapiro_wilk")
def shapiro_wilk(spark, sf):
    """Account balances by nation; nations of 5,000 customers or more are not normal without a test."""
    return S.shapiro_wilk(S.value_cells(load(spark, sf, "customer"), ["c_acctbal"], [], "c_nationkey").drop("v"))


@register("shapiro_gate", """
SELECT 'c_acctbal' AS feature, CAST(c_nationkey AS VARCHAR) AS grp, CAST(count(*) AS BIGINT) AS n, count(*) < 5000 AS tested
FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY c_nationkey HAVING count(*) >= 3
""")
def shapiro_gate(spark, sf):
    """Which groups the normality test is made of: a W between 0 and 1 below 5,000 rows, none above."""
    return shapiro_wilk(spark, sf).select("feature", "grp", "n", F.coalesce(F.col("w").between(0.0, 1.0), F.lit(False)).alias("tested"))


@register("statistics")
def statistics(spark, sf):
    li = load(spark, sf, "lineitem")
    return S.statistics(li, "l_linestatus", True, ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"])


@register("statistics_regression")
def statistics_regression(spark, sf):
    li = load(spark, sf, "lineitem")
    return S.statistics(li, "l_extendedprice", False, ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"])


@register("corr_heatmap", f"""
WITH p AS (SELECT a, b, round_even(abs(r), 2) AS r, pos FROM ({_corr_union(NUM)})
           WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY round_even(abs(r), 2) DESC, pos LIMIT 6),
s AS (SELECT a AS x, b AS y, r FROM p UNION ALL SELECT b, a, r FROM p),
l AS (SELECT DISTINCT x AS label FROM s)
SELECT label,
       CASE WHEN label = 'l_quantity' THEN 1.0 ELSE coalesce((SELECT r FROM s WHERE x = label AND y = 'l_quantity'), 0.0) END AS l_quantity,
       CASE WHEN label = 'l_extendedprice' THEN 1.0 ELSE coalesce((SELECT r FROM s WHERE x = label AND y = 'l_extendedprice'), 0.0) END AS l_extendedprice,
       CASE WHEN label = 'l_discount' THEN 1.0 ELSE coalesce((SELECT r FROM s WHERE x = label AND y = 'l_discount'), 0.0) END AS l_discount,
       CASE WHEN label = 'l_tax' THEN 1.0 ELSE coalesce((SELECT r FROM s WHERE x = label AND y = 'l_tax'), 0.0) END AS l_tax
FROM l
""")
def corr_heatmap(spark, sf):
    """A3 over the A1 result (a result table of at most six pairs)."""
    return S.pairs_to_matrix(S.corr_pairs(load(spark, sf, "lineitem"), NUM, top=6))


# The tests that H8 picks, without the p-values (their functions are not in SQL): at these sizes
# no group is normal by the gate, as uniform values are far from it.
_U = """
SELECT '{0}' AS feature, 'Mann-Whitney U' AS test, any_value(r) - any_value(n1) * (any_value(n1) + 1) / 2.0 AS stat,
       round_even(abs(any_value(m1) - any_value(m2)) / sqrt((any_value(v1) + any_value(v2)) / 2), 2) AS effect, 'Cohen''s d' AS effect_name
FROM (SELECT sum(mid) FILTER (g = lo) AS r, count(*) FILTER (g = lo) AS n1, avg(x) FILTER (g = lo) AS m1, avg(x) FILTER (g <> lo) AS m2,
             var_samp(x) FILTER (g = lo) AS v1, var_samp(x) FILTER (g <> lo) AS v2
      FROM (SELECT l_linestatus AS g, min(l_linestatus) OVER () AS lo, {0} AS x,
                   rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS mid FROM lineitem))
"""
_F = """
SELECT '{0}' AS feature, 'one-way ANOVA' AS test, (sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS stat,
       0.0 AS effect, 'η²' AS effect_name
FROM (SELECT count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY {0}), (SELECT avg(l_extendedprice) AS g FROM lineitem)
"""
_R = """
SELECT '{0}' AS feature, 'Pearson r' AS test, round_even(corr({0}, l_extendedprice), 3) AS stat, round_even(abs(corr({0}, l_extendedprice)), 2) AS effect,
       '|r|' AS effect_name FROM lineitem
"""


def _tests(found):
    return found.select("feature", "test", F.round("stat", 3).alias("stat"), "effect", "effect_name")


@register("statistics_tests", f"""
WITH c AS (SELECT l_returnflag AS v, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2),
g AS (SELECT v, y, r * k / n AS e, n FROM (SELECT v, sum(o) AS r FROM c GROUP BY v), (SELECT y, sum(o) AS k FROM c GROUP BY y), (SELECT sum(o) AS n FROM c)),
e AS (SELECT g.*, coalesce(o, 0) AS o FROM g LEFT JOIN c USING (v, y)),
x AS (SELECT sum(power(o - e, 2) / e) AS chi2, any_value(n) AS n, least(count(DISTINCT v), count(DISTINCT y)) - 1 AS d FROM e)
SELECT feature, test, round(stat, 3) AS stat, effect, effect_name FROM (
  {" UNION ALL ".join(_U.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount"))}
  UNION ALL SELECT 'l_returnflag', 'chi-square', chi2, round_even(sqrt(chi2 / (n * d)), 2), 'Cramér''s V' FROM x)
""")
def statistics_tests(spark, sf):
    return _tests(statistics(spark, sf))


@register("statistics_regression_tests", f"""
SELECT feature, test, round(stat, 3) AS stat, effect, effect_name FROM (
  {" UNION ALL ".join([_R.format("l_quantity"), _R.format("l_discount"), _F.format("l_returnflag"), _F.format("l_linestatus")])})
""")
def statistics_regression_tests(spark, sf):
    return _tests(statistics_regression(spark, sf))
