"""Column dictionary and data-quality score.

One pass over the table gives every column's counts, text lengths, least and
greatest value: a row a task is shuffled.  Constants follow from these.
Distinct values are counted only where they are shown, and then by digests of two hashes (16
bytes, whatever the length of a value), reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.scalars import finite_input, is_datetime_type, is_numeric_type
from tablelens.operators.ranks import attach_scalars


def _text(df: DataFrame, c: str):
    return F.col(f"`{c}`").cast("string")


@finite_input
def column_facts(df: DataFrame) -> DataFrame:
    """Per column: pos, name, n, missing_n, mean_len (of non-null text), constant (at most
    one distinct value, NULL counted as a value).  One aggregate; no rows for an empty table."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        kind = df.schema[c].dataType
        value = F.col(f"`{c}`") if isinstance(kind, T.AtomicType) else F.xxhash64(_text(df, c))
        aggs += [F.count(F.col(f"`{c}`")).alias(f"c{i}"), F.avg(F.length(_text(df, c))).alias(f"l{i}"),
                 (F.min(value) == F.max(value)).alias(f"s{i}")]
    row = df.agg(*aggs)
    facts = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"), "n", (F.col("n") - F.col(f"c{i}")).alias("missing_n"),
                               F.col(f"l{i}").alias("mean_len"),
                               ((F.col(f"c{i}") == 0) | ((F.col(f"c{i}") == F.col("n")) & F.col(f"s{i}"))).alias("constant"))
                      for i, c in enumerate(df.columns)])
    return row.where("n > 0").select(F.explode(facts).alias("f")).select("f.*")


@finite_input
def distinct_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``pos, unique``: non-null distinct values of the columns, by digests of their text."""
    cols = df.columns if cols is None else cols
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(_text(df, c))).alias("a"),
                               F.xxhash64(_text(df, c), F.lit(i + 1)).alias("b")) for i, c in enumerate(cols)])
    long = df.select(F.explode(cells).alias("s")).select("s.*").where(F.col("a").isNotNull())
    return (long.groupBy("pos", "a", "b").agg(F.lit(1).alias("one")).groupBy("pos")
            .agg(F.count(F.lit(1)).cast("long").alias("unique")))


def column_stats(df: DataFrame) -> DataFrame:
    """:func:`column_facts` with ``unique`` (non-null distinct values)."""
    return (column_facts(df).join(distinct_values(df), "pos", "left")
            .withColumn("unique", F.coalesce("unique", F.lit(0).cast("long"))))


@finite_input
def profile_columns(df: DataFrame, target: str | None = None, max_cols: int | None = None) -> DataFrame:
    """``name, type, missing (% of rows, 1 decimal), unique`` for every column.

    type: target / numeric / date / text (mean length > 20 and more than
    max(20, n/2) distinct) / categorical.  No 30-column cap unless asked.
    """
    cols = df.columns[:max_cols] if max_cols else df.columns
    sub = df.select(*[F.col(f"`{c}`") for c in cols])
    kinds = {c: ("target" if c == target else "numeric" if is_numeric_type(sub.schema[c].dataType)
                 else "date" if is_datetime_type(sub.schema[c].dataType) else "other") for c in cols}
    kind_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(kinds[c]))])
    st = column_stats(sub)
    kind = kind_map[F.col("name")]
    is_text = (F.col("mean_len") > 20) & (F.col("unique") > F.greatest(F.lit(20.0), F.col("n") * 0.5))
    role = (F.when(kind != "other", kind).when(is_text, F.lit("text")).otherwise(F.lit("categorical")))
    return st.select(
        "pos", "name", role.alias("type"),
        F.bround(F.col("missing_n") * 100.0 / F.col("n"), 1).alias("missing"),
        "unique",
    )


@finite_input
def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (all but the first of each group)."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicates"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value (NULL counts as a value)."""
    return column_facts(df).where("constant").select("pos", "name")


def quality_score(df: DataFrame) -> DataFrame:
    """``score = round(100 - miss*140 - dup/n*80 - const*3)`` clamped to 0..100,
    with ``missing`` in percent, ``duplicates`` and ``constant_cols``."""
    st = column_facts(df).agg(
        F.avg(F.col("missing_n") / F.col("n")).alias("miss"),
        F.sum(F.when(F.col("constant"), 1).otherwise(0)).cast("long").alias("constant_cols"),
        F.max("n").alias("n"),
    )
    j = attach_scalars(st, duplicate_rows(df))
    raw = 100 - F.col("miss") * 140 - F.col("duplicates") / F.greatest(F.col("n"), F.lit(1)) * 80 \
        - F.col("constant_cols") * 3
    return j.select(
        F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw, 0))).cast("int").alias("score"),
        F.bround(F.col("miss") * 100, 1).alias("missing"),
        "duplicates", "constant_cols",
    )


@finite_input
def quality_findings(df: DataFrame, target: str | None = None, positive=None,
                     corr_pairs: DataFrame | None = None, bars: DataFrame | None = None,
                     segments: DataFrame | None = None, max_rows: int = 8) -> DataFrame:
    """P5: rule findings as rows ``(rule, subject, value, kind)``.

    Rules: a column with >=5 % missing (warn); a driver pair with |r| >= 0.9
    (warn, first only); a driver of ``bars`` (M13) at 0.85 or more with the next
    under 0.6 (info); class majority share >= 70 % (warn); the segment of
    ``segments`` (G2) whose rate of ``positive`` is 1.3 times that of the table or
    more (info); quality score >= 90 (good) else duplicates > 0 (warn).  At most
    ``max_rows`` rows, in rule order.
    """
    st = column_facts(df)
    parts = [st.where(F.col("missing_n") * 100.0 / F.col("n") >= 5)
               .select(F.lit(1).alias("ord"), F.col("pos").alias("sub_ord"), F.lit("missing").alias("rule"),
                       F.col("name").alias("subject"),
                       (F.col("missing_n") * 100.0 / F.col("n")).alias("value"), F.lit("warn").alias("kind"))]
    if corr_pairs is not None:
        w = corr_pairs.where(F.col("r") >= 0.9).orderBy(F.desc("r"), "a", "b").limit(1)
        parts.append(w.select(F.lit(2).alias("ord"), F.lit(0).alias("sub_ord"), F.lit("redundant_pair").alias("rule"),
                              F.concat_ws(" & ", "a", "b").alias("subject"), F.col("r").cast("double").alias("value"),
                              F.lit("warn").alias("kind")))
    if bars is not None:
        first = bars.orderBy(F.desc("value"), "label").limit(2).agg(
            F.max(F.struct("value", "label")).alias("top"), F.when(F.count(F.lit(1)) > 1, F.min("value")).alias("next"))
        parts.append(first.where((F.col("top.value") >= 0.85) & (F.col("next").isNull() | (F.col("next") < 0.6))).select(
            F.lit(3).alias("ord"), F.lit(0).alias("sub_ord"), F.lit("dominant_driver").alias("rule"),
            F.col("top.label").alias("subject"), F.col("top.value").cast("double").alias("value"), F.lit("info").alias("kind")))
    if target is not None and segments is not None and positive is not None:
        base = df.where(F.col(target).isNotNull()).agg(F.avg((F.col(target) == F.lit(positive)).cast("double")).alias("base"))
        best = attach_scalars(segments.orderBy(F.desc("value"), "label").limit(1), base)
        parts.append(best.where((F.col("base") > 0) & (F.col("value") / F.col("base") >= 1.3)).select(
            F.lit(5).alias("ord"), F.lit(0).alias("sub_ord"), F.lit("best_segment").alias("rule"),
            F.col("label").alias("subject"), (F.col("value") / F.col("base")).alias("value"), F.lit("info").alias("kind")))
    if target is not None:
        vc = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("c"))
        share = vc.agg((F.max("c") / F.sum("c")).alias("value"))
        parts.append(share.where(F.col("value") >= 0.7).select(
            F.lit(4).alias("ord"), F.lit(0).alias("sub_ord"), F.lit("imbalanced_target").alias("rule"),
            F.lit(target).alias("subject"), F.col("value"), F.lit("warn").alias("kind")))
    q = quality_score(df)
    parts.append(q.select(
        F.lit(6).alias("ord"), F.lit(0).alias("sub_ord"),
        F.when(F.col("score") >= 90, F.lit("quality")).otherwise(F.lit("duplicates")).alias("rule"),
        F.lit(None).cast("string").alias("subject"),
        F.when(F.col("score") >= 90, F.col("score")).otherwise(F.col("duplicates")).cast("double").alias("value"),
        F.when(F.col("score") >= 90, F.lit("good")).otherwise(F.lit("warn")).alias("kind"),
    ).where((F.col("kind") == "good") | (F.col("value") > 0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("ord", "sub_ord").limit(max_rows)
