"""Column expressions (S1-S13) shared by every operator.

All of these are built-in Spark SQL expressions, so they stay inside
whole-stage codegen.  Text that is parsed as a number goes through a regex
guard first: Spark's cast accepts suffixes such as ``'1d'``/``'1f'`` that
pandas and most SQL engines reject.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "NUMBER_PATTERN", "to_number", "is_number_text", "hash_int", "hash_unit", "hash_bucket",
    "nonfinite_to_null", "finite_table", "finite_input", "parse_compact", "weekday_mon0",
    "is_numeric_type", "is_datetime_type", "is_string_type", "round_half_even",
]

# Fixed value: plain decimal / scientific notation, optional sign, surrounding blanks.
NUMBER_PATTERN = r"^\s*[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?\s*$"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType, T.BooleanType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_number_text(c: Column) -> Column:
    return c.rlike(NUMBER_PATTERN)


def to_number(c: Column) -> Column:
    """pandas ``to_numeric(errors='coerce')`` for text: NULL unless the whole
    string is a plain number."""
    s = c.cast("string")
    return F.when(is_number_text(s), F.trim(s).try_cast("double"))


def nonfinite_to_null(c: Column) -> Column:
    """NaN and +/-Inf become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def finite_table(df: DataFrame) -> DataFrame:
    """Missing-value normalisation: NaN and +/-Inf of every float column become
    NULL, as all operators count missing values.  A projection, or nothing where
    no column is a float."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[(nonfinite_to_null(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`"))
                       for c in df.columns])


def finite_input(fn):
    """Operators whose first argument is a table: it is read with NaN and +/-Inf as missing."""
    @functools.wraps(fn)
    def run(df, *args, **kw):
        return fn(finite_table(df), *args, **kw)
    return run


def hash_int(cols: list[str | Column], seed: int = 42) -> Column:
    """Portable 32-bit hash: first 8 hex digits of md5('k1#k2#...#seed').

    The same value comes out of any SQL engine with md5, which makes samples,
    splits and folds reproducible outside Spark (the DuckDB oracle)."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    key = F.concat_ws("#", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_unit(cols: list[str | Column], seed: int = 42) -> Column:
    """Uniform in [0, 1) from :func:`hash_int`."""
    return hash_int(cols, seed) / F.lit(4294967296.0)


def hash_bucket(cols: list[str | Column], k: int, seed: int = 42) -> Column:
    return (hash_int(cols, seed) % F.lit(k)).cast("int")


def parse_compact(c: Column) -> Column:
    """Best-effort number from display text: ``9.7k`` -> 9700, ``62%`` -> 62,
    ``1.2M`` -> 1200000; no number -> 0."""
    s = F.regexp_replace(c.cast("string"), ",", "")
    pat = r"(-?[0-9]+[.]?[0-9]*)\s*([kKmM%]?)"
    num = F.regexp_extract(s, pat, 1)
    suf = F.regexp_extract(s, pat, 2)
    v = F.when(num == "", F.lit(0.0)).otherwise(num.try_cast("double"))
    mult = (F.when(F.lower(suf) == "k", F.lit(1000.0))
            .when(F.lower(suf) == "m", F.lit(1000000.0)).otherwise(F.lit(1.0)))
    return F.coalesce(v, F.lit(0.0)) * mult


def weekday_mon0(c: Column) -> Column:
    """Day of week with Monday = 0 (pandas ``dayofweek``)."""
    return F.weekday(c)


def round_half_even(c: Column, scale: int) -> Column:
    """Python's ``round`` (banker's rounding)."""
    return F.bround(c, scale)
