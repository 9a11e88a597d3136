"""P1-P5 over lineitem with derived NULLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import profile as P
from tablelens.plans.common import DIRTY_LINEITEM_COLS, DIRTY_LINEITEM_SQL, dirty_lineitem
from tablelens.plans.registry import register


def _profile_sql(cols, target=None, table=DIRTY_LINEITEM_SQL) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        if c == target:
            role = "'target'"
        elif kind in ("numeric", "date"):
            role = f"'{kind}'"
        else:
            role = (f"CASE WHEN avg(length({c})) > 20 AND count(DISTINCT {c}) > greatest(20, count(*) * 0.5) "
                    f"THEN 'text' ELSE 'categorical' END")
        parts.append(f"SELECT {i} AS pos, '{c}' AS name, {role} AS type, "
                     f"round_even(100.0 * (count(*) - count({c})) / count(*), 1) AS missing, "
                     f"count(DISTINCT {c}) AS unique FROM d")
    return f"WITH d AS ({table}) " + " UNION ALL ".join(parts)


@register("profile_columns", _profile_sql(DIRTY_LINEITEM_COLS, target="l_returnflag"))
def profile_columns(spark, sf):
    return P.profile_columns(dirty_lineitem(spark, sf), target="l_returnflag")


_DUP_SQL = f"""
WITH d AS ({DIRTY_LINEITEM_SQL}), k AS (SELECT l_returnflag, l_linestatus, l_tax FROM d)
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM k)) AS BIGINT) AS duplicates FROM k
"""


@register("duplicate_rows", _DUP_SQL)
def duplicate_rows(spark, sf):
    return P.duplicate_rows(dirty_lineitem(spark, sf).select("l_returnflag", "l_linestatus", "l_tax"))


def _const_sql():
    d = f"({DIRTY_LINEITEM_SQL}) d"
    parts = [f"SELECT {i} AS pos, '{c}' AS name FROM (SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS k FROM {d}) WHERE k <= 1"
             for i, (c, _) in enumerate(DIRTY_LINEITEM_COLS + [("flag_const", "string")])]
    return " UNION ALL ".join(parts).replace(f"FROM ({DIRTY_LINEITEM_SQL}) d", f"FROM (SELECT *, 'x' AS flag_const FROM ({DIRTY_LINEITEM_SQL})) d")


@register("constant_columns", _const_sql())
def constant_columns(spark, sf):
    from pyspark.sql import functions as F
    return P.constant_columns(dirty_lineitem(spark, sf).withColumn("flag_const", F.lit("x")))


_QUALITY_SQL = f"""
WITH d AS (SELECT l_returnflag, l_linestatus, l_tax, qty_text FROM ({DIRTY_LINEITEM_SQL})),
m AS (SELECT ((count(*) - count(l_returnflag)) + (count(*) - count(l_linestatus))
              + (count(*) - count(l_tax)) + (count(*) - count(qty_text))) / (4.0 * count(*)) AS miss,
             count(*) AS n FROM d),
c AS (SELECT (CASE WHEN count(DISTINCT l_returnflag) + max(CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END) <= 1 THEN 1 ELSE 0 END
            + CASE WHEN count(DISTINCT l_linestatus) + max(CASE WHEN l_linestatus IS NULL THEN 1 ELSE 0 END) <= 1 THEN 1 ELSE 0 END
            + CASE WHEN count(DISTINCT l_tax) + max(CASE WHEN l_tax IS NULL THEN 1 ELSE 0 END) <= 1 THEN 1 ELSE 0 END
            + CASE WHEN count(DISTINCT qty_text) + max(CASE WHEN qty_text IS NULL THEN 1 ELSE 0 END) <= 1 THEN 1 ELSE 0 END) AS k FROM d),
u AS (SELECT count(*) AS dn FROM (SELECT DISTINCT * FROM d))
SELECT CAST(greatest(0, least(100, round_even(100 - miss * 140 - (n - dn) / greatest(n, 1) * 80 - k * 3, 0))) AS INTEGER) AS score,
       round_even(miss * 100, 1) AS missing, CAST(n - dn AS BIGINT) AS duplicates, CAST(k AS BIGINT) AS constant_cols
FROM m, c, u
"""


@register("quality_score", _QUALITY_SQL)
def quality_score(spark, sf):
    return P.quality_score(dirty_lineitem(spark, sf).select("l_returnflag", "l_linestatus", "l_tax", "qty_text"))


def _find_sql() -> str:
    cols = ["l_returnflag", "l_linestatus", "l_tax", "qty_text"]
    miss = " UNION ALL ".join(
        f"SELECT 1 AS ord, {i} AS sub_ord, 'missing' AS rule, '{c}' AS subject, "
        f"100.0 * (count(*) - count({c})) / count(*) AS value, 'warn' AS kind FROM d "
        f"HAVING 100.0 * (count(*) - count({c})) / count(*) >= 5" for i, c in enumerate(cols))
    q = _QUALITY_SQL.strip()
    q = q[q.index("m AS ("):]
    return f"""
WITH d AS (SELECT l_returnflag, l_linestatus, l_tax, qty_text FROM ({DIRTY_LINEITEM_SQL})), {q.split("SELECT CAST(greatest")[0].rstrip()},
qs AS (SELECT CAST(greatest(0, least(100, round_even(100 - miss * 140 - (n - dn) / greatest(n, 1) * 80 - k * 3, 0))) AS INTEGER) AS score,
              CAST(n - dn AS BIGINT) AS duplicates FROM m, c, u)
{miss}
UNION ALL
SELECT 4, 0, 'imbalanced_target', 'l_linestatus', value, 'warn'
FROM (SELECT max(c) * 1.0 / sum(c) AS value FROM (SELECT count(*) AS c FROM d WHERE l_linestatus IS NOT NULL GROUP BY l_linestatus))
WHERE value >= 0.7
UNION ALL
SELECT 6, 0, CASE WHEN score >= 90 THEN 'quality' ELSE 'duplicates' END, NULL,
       CAST(CASE WHEN score >= 90 THEN score ELSE duplicates END AS DOUBLE),
       CASE WHEN score >= 90 THEN 'good' ELSE 'warn' END
FROM qs WHERE score >= 90 OR duplicates > 0
"""


@register("quality_findings", _find_sql())
def quality_findings(spark, sf):
    d = dirty_lineitem(spark, sf).select("l_returnflag", "l_linestatus", "l_tax", "qty_text")
    return P.quality_findings(d, target="l_linestatus")


@register("source_rows", """
SELECT 'lineitem' AS table_name, count(*) AS rows FROM lineitem
UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'documents', count(*) FROM documents
""")
def source_rows(spark, sf):
    """I4: row counts without building the tables (Parquet answers from footers)."""
    from tablelens.session import table_path
    from tablelens.sources.io import source_row_count
    parts = [source_row_count(spark, table_path(sf, t)).select(F.lit(t).alias("table_name"), "rows")
             for t in ("lineitem", "orders", "documents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
