"""Schema inference and cleaning.

Every decision that depends on the data (is this text numeric? is this an id?
which column is the target?) is made from ONE aggregate job over all candidate
columns; the decision comes back to the driver as a handful of scalars and the
transformation is then a lazy projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.scalars import (
    finite_input,
    is_datetime_type, is_numeric_type, is_string_type, to_number, weekday_mon0,
)
from tablelens.operators.ranks import medians, prefix_sum

# Column names that mark a likely target.
TARGET_NAMES = ["target", "label", "labels", "class", "outcome", "y", "result",
                "churn", "default", "fraud", "survived", "price", "sales", "revenue"]

# Text date layouts tried in order (Spark datetime patterns).
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd",
                "MM/dd/yyyy", "MM-dd-yyyy", "yyyy-MM-dd HH:mm"]


def _q(c: str) -> F.Column:
    return F.col(f"`{c}`")


def trim_column_names(df: DataFrame) -> DataFrame:
    """Strip surrounding blanks from every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def numeric_text_stats(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Per non-numeric column: rows, non-null values and values that parse as
    numbers — one aggregate pass, rows ``(column, n, nonnull, valid)``."""
    ex = set(exclude or [])
    cols = [c for c in df.columns if c not in ex and not is_numeric_type(df.schema[c].dataType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n long, nonnull long, valid long")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count(_q(c)).alias(f"nn{i}"), F.count(to_number(_q(c))).alias(f"v{i}")]
    row = df.agg(*aggs)
    st = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n"),
                            F.col(f"nn{i}").alias("nonnull"), F.col(f"v{i}").alias("valid"))
                   for i, c in enumerate(cols)])
    return row.select(F.explode(st).alias("s")).select("s.column_name", "s.n", "s.nonnull", "s.valid")


def coerce_numeric(df: DataFrame, target: str | None = None, threshold: float = 0.8):
    """Replace text columns where at least ``threshold`` of the rows parse as
    numbers; unparsable values become NULL.  Returns ``(df, log)`` where log rows
    are ``(column, n_valid, n_bad)`` for the coerced columns."""
    st = numeric_text_stats(df, [target] if target else [])
    chosen = st.where((F.col("valid") >= threshold * F.col("n")) & (F.col("valid") > 0))
    picked = {r["column_name"]: r for r in chosen.collect()}  # one row per column
    out = df.select(*[(to_number(_q(c)) if c in picked else _q(c)).alias(c) for c in df.columns])
    log = chosen.select("column_name", F.col("valid").alias("n_valid"),
                        (F.col("nonnull") - F.col("valid")).alias("n_bad"))
    return out, log


def _long_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot columns to ``(k, v)`` with v the value as text (NULL kept)."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), _q(c).cast("string").alias("v"))
                                         for c in cols])).alias("s")).select("s.k", "s.v")


@finite_input
def id_like_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """C3 rule: name is ``id`` or ends in ``id`` (any case), or a text column whose
    distinct count (NULL included) equals the row count and whose mean text
    length (NULL read as 'nan') is under 25.  All text columns are measured by
    one unpivoted aggregation (no per-column distinct expansion)."""
    by_name = [c for c in df.columns if c != target and c.lower().endswith("id")]
    text = [c for c in df.columns if c != target and c not in by_name
            and not is_numeric_type(df.schema[c].dataType)]
    if not text:
        return by_name
    g = _long_text(df, text).groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    st = g.groupBy("k").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("n"),
                            (F.sum(F.length(F.coalesce("v", F.lit("nan"))) * F.col("c")) / F.sum("c")).alias("l"))
    got = {r["k"]: r for r in st.collect()}  # one row per text column
    return by_name + [c for c in text if c in got and got[c]["d"] == got[c]["n"] and got[c]["l"] < 25]


def drop_id_columns(df: DataFrame, target: str | None = None):
    """Drop identifier columns.  Returns ``(df, dropped_names)``."""
    ids = id_like_columns(df, target)
    return df.drop(*ids), ids


@finite_input
def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """C4: rows with a NULL target are removed."""
    return df.na.drop(subset=[target])


def finite_target(df: DataFrame, target: str) -> DataFrame:
    """Regression target as a finite double; other rows removed."""
    y = to_number(_q(target)) if not is_numeric_type(df.schema[target].dataType) else _q(target).cast("double")
    return df.withColumn(target, y).where(_q(target).isNotNull() & ~F.isnan(_q(target))
                                          & (F.abs(_q(target)) < F.lit(float("inf"))))


#: Estimates beyond this many times a bound need no exact count.
NEAR = 2


@finite_input
def distinct_counts(df: DataFrame, cols: list[str], upto: int | None = None) -> dict[str, int]:
    """Non-null distinct counts of several columns: exact, or with ``upto`` exact where they may be at most that.

    Sketches of a kilobyte or two a column tell in one pass which columns are beyond
    ``upto``; only the others' values are counted, and those are few."""
    if not cols:
        return {}
    from tablelens.operators.profile import distinct_values
    got = {}
    if upto is not None:
        row = df.agg(*[F.approx_count_distinct(_q(c).cast("string"), 0.05).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        got = {c: int(row[f"d{i}"]) for i, c in enumerate(cols) if row[f"d{i}"] > NEAR * upto + 8}
    left = [c for c in cols if c not in got]
    if left:
        exact = {r["pos"]: r["unique"] for r in distinct_values(df.select(*[_q(c) for c in left])).collect()}  # a row a column
        got |= {c: int(exact.get(i, 0)) for i, c in enumerate(left)}
    return {c: got[c] for c in cols}


def auto_target(df: DataFrame) -> str:
    """A column with a known target name; else the last text column with
    2..10 distinct values; else the last column."""
    named = [c for c in df.columns if c.strip().lower() in TARGET_NAMES]
    if named or not df.columns:
        return named[0] if named else ""
    counts = distinct_counts(df, [c for c in df.columns if not is_numeric_type(df.schema[c].dataType)], upto=10)
    few = [c for c, n in counts.items() if n in range(2, 11)]
    return (few or df.columns)[-1]


def task_kind(df: DataFrame, target: str, distinct: int | None = None) -> str:
    """C7: 'classification' or 'regression' from the target's type and distinct count."""
    dt = df.schema[target].dataType
    if not is_numeric_type(dt):
        return "classification"
    k = distinct if distinct is not None else distinct_counts(df, [target])[target]
    if isinstance(dt, (T.FloatType, T.DoubleType)) and k > 15:
        return "regression"
    return "classification" if k <= 15 else "regression"


def high_card_text(df: DataFrame, target: str | None = None) -> DataFrame:
    """Non-numeric columns with more than max(30, n/2) distinct values
    (NULL counted), with their mean text length: rows ``(column, distinct, mean_len)``."""
    cols = [c for c in df.columns if c != target and not is_numeric_type(df.schema[c].dataType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct long, mean_len double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), _q(c).cast("string").alias("v"))
                                         for c in cols])).alias("s")).select("s.k", "s.v")
    g = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    st = g.groupBy("k").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n"),
                            (F.sum(F.length("v") * F.col("c")) / F.sum(F.when(F.col("v").isNotNull(), F.col("c"))))
                            .alias("mean_len"))
    return st.where(F.col("n_distinct") > F.greatest(F.lit(30.0), F.col("n") * 0.5)) \
             .select(F.col("k").alias("column_name"), F.col("n_distinct").cast("long"), "mean_len")


@finite_input
def impute_median(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fill NULL numerics with the exact column median (distributed order
    statistics for all columns in one job)."""
    cols = cols or [c for c in df.columns if is_numeric_type(df.schema[c].dataType)]
    med = medians(df, cols)
    fill = {c: float(v) for c, v in med.items() if v is not None}
    return df.select(*[(F.coalesce(_q(c).cast("double"), F.lit(fill[c])).alias(c) if c in fill else _q(c))
                       for c in df.columns])


def label_dictionary(df: DataFrame, col: str) -> DataFrame:
    """C10 dictionary: ``(value, code)`` with codes 0.. in sorted value order.

    Built from the distinct values with the bucketed running count, so a large
    dictionary is never ranked in a single task."""
    d = df.select(_q(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct() \
          .withColumn("_one", F.lit(1).cast("long"))
    r = prefix_sum(d, "value", ["_one"])
    return r.select("value", (F.col("cum__one") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace text by its code; NULL -> -1 (pandas ``cat.codes``).

    The dictionaries of all columns are built together; each is joined by its
    column, broadcast or not as the optimizer finds by its bytes."""
    if not cols:
        return df
    values = _long_text(df, cols).where(F.col("v").isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    codes = prefix_sum(values, "v", ["_one"], partition_cols=["k"]).select(
        "k", "v", (F.col("cum__one") - 1).cast("int").alias("code"))
    out = df
    for i, c in enumerate(cols):
        own = codes.where(F.col("k") == F.lit(c)).select(F.col("v").alias(f"_v{i}"), F.col("code").alias(f"_code{i}"))
        out = out.join(own, _q(c).cast("string") == F.col(f"_v{i}"), "left")
        out = out.withColumn(c, F.coalesce(F.col(f"_code{i}"), F.lit(-1))).drop(f"_v{i}", f"_code{i}")
    return out


def parse_datetime_text(c: F.Column) -> F.Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def date_like_columns(df: DataFrame) -> list[str]:
    """C11 rule: text with mean length <= 30, at least 60 % of values containing
    one of ``- / :``, and more than 80 % parsable."""
    text = [c for c in df.columns if is_string_type(df.schema[c].dataType)]
    if not text:
        return []
    aggs = []
    for i, c in enumerate(text):
        s = _q(c)
        aggs += [F.avg(F.length(s)).alias(f"l{i}"),
                 F.avg(F.when(s.isNull(), None).when(s.rlike("[-/:]"), 1.0).otherwise(0.0)).alias(f"p{i}")]
    r = df.agg(*aggs).first()
    likely = [c for i, c in enumerate(text) if r[f"l{i}"] is not None and r[f"l{i}"] <= 30 and r[f"p{i}"] >= 0.6]
    if not likely:
        return []
    counts = _long_text(df, likely).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))  # a distinct text is parsed once
    valid = F.sum(F.when(parse_datetime_text(F.col("v")).isNotNull(), F.col("n")).otherwise(0))
    share = {r["k"]: r["ok"] for r in counts.groupBy("k").agg((valid / F.sum("n")).alias("ok")).collect()}  # a row per column
    return [c for c in likely if share[c] > 0.8]


def date_parts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C11: replace date-like text (and native timestamps when named) by
    ``<c>_year, <c>_month, <c>_day, <c>_dow`` (Monday = 0)."""
    cols = cols if cols is not None else date_like_columns(df)
    out = df
    for c in cols:
        t = _q(c) if is_datetime_type(df.schema[c].dataType) else parse_datetime_text(_q(c))
        out = (out.withColumn(f"{c}_year", F.year(t)).withColumn(f"{c}_month", F.month(t))
                  .withColumn(f"{c}_day", F.dayofmonth(t)).withColumn(f"{c}_dow", weekday_mon0(t)).drop(c))
    return out


@finite_input
def variances(df: DataFrame, cols: list[str]) -> dict[str, float]:
    r = df.agg(*[F.var_samp(_q(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"v{i}"] if r[f"v{i}"] is not None else 0.0) for i, c in enumerate(cols)}


def top_variance_columns(df: DataFrame, k: int = 150) -> list[str]:
    """Names of the ``k`` highest-variance numeric columns (stable order)."""
    num = [c for c in df.columns if is_numeric_type(df.schema[c].dataType)]
    v = variances(df, num)
    return [c for c, _ in sorted(v.items(), key=lambda kv: (-kv[1], num.index(kv[0])))[:k]]


@finite_input
def variance_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """C13 as a table ``(column, variance)`` from one aggregate."""
    row = df.agg(*[F.var_samp(_q(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    st = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"v{i}"), F.lit(0.0)).alias("variance"))
                   for i, c in enumerate(cols)])
    return row.select(F.explode(st).alias("s")).select("s.column_name", "s.variance")


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """C14: keep columns with more than one distinct non-null value, told by least and greatest."""
    from tablelens.functions.scalars import finite_table
    values = {c: _q(c) if isinstance(df.schema[c].dataType, T.AtomicType) else F.xxhash64(_q(c).cast("string")) for c in df.columns}
    row = finite_table(df).agg(*[(F.min(v) < F.max(v)).alias(f"v{i}") for i, v in enumerate(values.values())]).first()
    return df.select(*[_q(c) for i, c in enumerate(df.columns) if row[f"v{i}"]])


@finite_input
def numeric_matrix(df: DataFrame, drop: str | None = None, max_cols: int | None = None,
                   keep: list[str] | None = None) -> DataFrame:
    """Drop ids (and ``drop``), coerce numeric text, label-encode other
    text, impute medians then 0; with ``max_cols`` keep that many highest-variance columns.
    ``keep`` columns (row keys) pass through untouched and are not features."""
    keep = list(keep or [])
    feats = df.drop(*keep)
    ids = id_like_columns(feats)
    cols = [c for c in feats.columns if c not in ids and c != drop]
    work = df.select(*[_q(c) for c in keep + cols])
    stats = numeric_text_stats(work.select(*[_q(c) for c in cols]))
    coerce = {r["column_name"] for r in stats.where((F.col("valid") >= 0.8 * F.col("n")) & (F.col("valid") > 0))
              .collect()}
    work = work.select(*[(to_number(_q(c)).alias(c) if c in coerce else _q(c)) for c in work.columns])
    text = [c for c in cols if c not in coerce and is_string_type(work.schema[c].dataType)]
    other = [c for c in cols if c not in text and not is_numeric_type(work.schema[c].dataType) and c not in coerce]
    work = work.drop(*other)
    cols = [c for c in cols if c not in other]
    work = label_encode(work, text)
    med = medians(work, cols)
    work = work.select(*[_q(c) for c in keep],
                       *[F.coalesce(_q(c).cast("double"), F.lit(med.get(c)), F.lit(0.0)).alias(c) for c in cols])
    if max_cols and len(cols) > max_cols:
        v = variances(work, cols)
        cols = sorted(cols, key=lambda c: (-v[c], cols.index(c)))[:max_cols]
    return work.select(*[_q(c) for c in keep], *[_q(c).cast("double").alias(c) for c in cols])


@finite_input
def infer_ui_types(df: DataFrame) -> DataFrame:
    """Per column over ALL rows (text form): number / date / category / text.  One pass
    with a sketch of each column's distinct values; they are counted only where they may be few."""
    cols = df.columns
    date_re = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"
    shown = df.select(*[F.coalesce(_q(c).cast("string"), F.lit("")).alias(c) for c in cols])
    row = shown.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (
        F.min(((_q(c) != "") & to_number(_q(c)).isNotNull()).cast("int")).alias(f"num{i}"),
        F.min(_q(c).rlike(date_re).cast("int")).alias(f"dt{i}"),
        F.approx_count_distinct(_q(c), 0.05).alias(f"d{i}"))]).first()
    n = row["n"]
    few = min(12, max(2, n // 2))
    near = [c for i, c in enumerate(cols) if n and not row[f"num{i}"] and not row[f"dt{i}"] and row[f"d{i}"] <= NEAR * few + 8]
    exact = distinct_counts(shown, near)
    kind = lambda i, c: ("number" if row[f"num{i}"] else "date" if row[f"dt{i}"]
                         else "category" if c in exact and exact[c] <= few else "text")
    rows = [(i, c, kind(i, c)) for i, c in enumerate(cols)] if n else []
    return df.sparkSession.createDataFrame(rows, "pos int, column_name string, kind string")
