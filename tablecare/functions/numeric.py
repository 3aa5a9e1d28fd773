"""Numeric column expressions shared by the operators and mirrored in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def rnd(c: Column, digits: int = 4) -> Column:
    """Half-up rounding computed with plain IEEE operations.

    Spark's ``round`` rounds the shortest decimal rendering while DuckDB
    rounds the binary value, so ties such as 1.005 differ. ``floor(x*10^d +
    .5)/10^d`` is evaluated identically by both engines; beyond 1e14 the value
    is returned unchanged (no overflow of the integral floor)."""
    scale = float(10 ** digits)
    return F.when(F.abs(c) < F.lit(1e14), F.floor(c * scale + 0.5) / scale).otherwise(c.cast("double"))


def rnd_sql(expr: str, digits: int = 4) -> str:
    """SQL text of :func:`rnd` for the oracle (same arithmetic)."""
    scale = float(10 ** digits)
    return (f"(CASE WHEN abs({expr}) < 1e14 THEN floor(({expr}) * {scale} + 0.5) / {scale} "
            f"ELSE CAST({expr} AS DOUBLE) END)")


def as_double(c: Column) -> Column:
    """Cast to double and treat NaN as missing (NaN and NULL are one concept)."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def family_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dt, NESTED_TYPES):
        return "nested"
    return "other"


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def skewness_unbiased(x: Column) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``skew``, DuckDB ``skewness``).

    Spark's ``skewness`` is the population g1; G1 = g1*sqrt(n(n-1))/(n-2).
    NULL when fewer than three values or zero variance."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def safe_corr(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r; NULL (not an error) on constant input."""
    xm = F.when(y.isNotNull(), x)
    ym = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym))


def safe_corr_sql(x: str, y: str) -> str:
    xm = f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    ym = f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return (f"(covar_pop({xm}, {ym}) / NULLIF(stddev_pop({xm}) * stddev_pop({ym}), 0))")


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin index in [0, bins-1]; last bin closed; single-valued column → bin 0."""
    w = (hi - lo) / F.lit(float(bins))
    return F.when(hi > lo, F.least(F.floor((x - lo) / w), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def hash_bucket(key: Column, seed: int = 42) -> Column:
    """Deterministic 0..9999 bucket from md5(seed-key); DuckDB computes the
    same integer with md5 + hex parse (used for train/test splits)."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")))
    return (F.conv(F.substring(h, 1, 7), 16, 10).cast("bigint") % 10000).cast("int")


def hash_bucket_sql(key: str, seed: int = 42) -> str:
    return (f"CAST((('0x' || substr(md5(concat_ws('-', '{seed}', CAST({key} AS VARCHAR))), 1, 7))::BIGINT "
            f"% 10000) AS INTEGER)")
