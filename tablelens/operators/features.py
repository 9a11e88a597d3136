"""Feature engineering (E1-E4) and encoding recipes.

Statistics needed to transform (min, max, mean, sigma, skew, variance) come
from one aggregate job and are embedded as literals — a projection, no join.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.scalars import finite_input, hash_unit, is_numeric_type
from tablelens.operators.clean import distinct_counts, variances


def _q(c: str):
    return F.col(f"`{c}`")


def sample_skew(c) -> F.Column:
    """Bias-corrected sample skewness (pandas ``skew``): Spark's population
    skewness times sqrt(n(n-1))/(n-2)."""
    n = F.count(c)
    return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)


@finite_input
def skew_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column_name, skew, min, n`` for numeric columns, one pass."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in (
        sample_skew(_q(c).cast("double")).alias(f"s{i}"), F.min(_q(c)).cast("double").alias(f"m{i}"),
        F.count(_q(c)).alias(f"n{i}"))])
    st = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("skew"),
                            F.col(f"m{i}").alias("min"), F.col(f"n{i}").alias("n")) for i, c in enumerate(cols)])
    return row.select(F.explode(st).alias("s")).select("s.*")


def log_candidates(df: DataFrame, cols: list[str] | None = None, max_new: int = 3) -> list[str]:
    """E1 rule: non-negative, more than 10 distinct values, skew > 2; first 3."""
    cols = cols or [c for c in df.columns if is_numeric_type(df.schema[c].dataType)]
    st = {r["column_name"]: r for r in skew_table(df, cols).collect()}
    dc = distinct_counts(df, cols, upto=10)
    out = []
    for c in cols:
        r = st[c]
        if r["min"] is not None and r["min"] >= 0 and dc[c] > 10 and (r["skew"] or 0) > 2 and len(out) < max_new:
            out.append(c)
    return out


@finite_input
def log_features(df: DataFrame, cols: list[str] | None = None, max_new: int = 3) -> DataFrame:
    """Add ``log_<c> = log1p(c)`` for skewed non-negative columns."""
    picked = log_candidates(df, cols, max_new)
    return df.select("*", *[F.log1p(_q(c).cast("double")).alias(f"log_{c}") for c in picked])


@finite_input
def interaction_feature(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``<a>_x_<b>`` = product of the two highest-variance numeric columns."""
    cols = cols or [c for c in df.columns if is_numeric_type(df.schema[c].dataType)]
    if len(cols) < 2:
        return df
    v = variances(df, cols)
    a, b = sorted(cols, key=lambda c: (-v[c], cols.index(c)))[:2]
    return df.withColumn(f"{a}_x_{b}", _q(a) * _q(b))


@finite_input
def standardize(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population sigma (scikit-learn ``StandardScaler``);
    a zero sigma leaves the centred value unscaled."""
    r = df.agg(*[x for i, c in enumerate(cols) for x in
                 (F.avg(_q(c)).alias(f"a{i}"), F.stddev_pop(_q(c)).alias(f"s{i}"))]).first()
    exprs = {}
    for i, c in enumerate(cols):
        mu, sd = r[f"a{i}"] or 0.0, r[f"s{i}"] or 0.0
        exprs[c + suffix] = (_q(c) - F.lit(mu)) / F.lit(sd if sd > 0 else 1.0)
    if suffix:
        return df.select("*", *[e.alias(n) for n, e in exprs.items()])
    return df.select(*[(exprs[c].alias(c) if c in exprs else _q(c)) for c in df.columns])


@finite_input
def minmax(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - min) / (max - min); a constant column maps to 0.5."""
    r = df.agg(*[x for i, c in enumerate(cols) for x in
                 (F.min(_q(c)).alias(f"lo{i}"), F.max(_q(c)).alias(f"hi{i}"))]).first()
    exprs = {}
    for i, c in enumerate(cols):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is None or hi is None or hi <= lo:
            exprs[c + suffix] = F.when(_q(c).isNotNull(), F.lit(0.5))
        else:
            exprs[c + suffix] = (_q(c) - F.lit(float(lo))) / F.lit(float(hi - lo))
    if suffix:
        return df.select("*", *[e.alias(n) for n, e in exprs.items()])
    return df.select(*[(exprs[c].alias(c) if c in exprs else _q(c)) for c in df.columns])


def one_hot(df: DataFrame, col: str, values: list | None = None, prefix: str | None = None,
            max_values: int | None = 1000) -> DataFrame:
    """One 0/1 column per category value (values sorted; NULL gets none).
    The result has a column per value, so ``max_values`` (None: no limit) guards
    against encoding an id; for more values use the label or target encoder."""
    if values is None:
        seen = df.select(_q(col)).where(_q(col).isNotNull()).distinct()
        rows = (seen if max_values is None else seen.limit(max_values + 1)).collect()  # a value per new column
        if max_values is not None and len(rows) > max_values:
            raise ValueError(f"{col} has over {max_values} values; raise max_values to encode them all")
        values = sorted(r[0] for r in rows)
    p = prefix or col
    return df.select("*", *[F.when(_q(col) == F.lit(v), 1).otherwise(0).alias(f"{p}_{v}") for v in values])


@finite_input
def target_encode(df: DataFrame, col: str, target: str, train_mask: F.Column | None = None) -> DataFrame:
    """Mean target per category fitted on the training rows only, joined
    back to every row; unseen categories get the training mean."""
    train = df.where(train_mask) if train_mask is not None else df
    enc = train.groupBy(_q(col).alias("_k")).agg(F.avg(_q(target).cast("double")).alias(f"{col}_te"))
    gm = train.agg(F.avg(_q(target).cast("double"))).first()[0]
    out = df.join(enc, _q(col).eqNullSafe(F.col("_k")), "left").drop("_k")
    return out.withColumn(f"{col}_te", F.coalesce(F.col(f"{col}_te"), F.lit(gm)))


def pairwise_interactions(df: DataFrame, cols: list[str]) -> DataFrame:
    """``a_x_b`` for every pair of the given columns (a fixed, small list)."""
    return df.select("*", *[(_q(a) * _q(b)).alias(f"{a}_x_{b}") for a, b in combinations(cols, 2)])


def hash_train_mask(key_cols: list[str], test_fraction: float = 0.2, seed: int = 42) -> F.Column:
    return hash_unit(key_cols, seed) >= F.lit(float(test_fraction))
