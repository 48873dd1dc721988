"""F1, X4, X7 and moment corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order (booleans and datetimes excluded)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    """String (categorical) columns in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FRACTIONAL_TYPES)


def finite_or_null(c: Column, fractional: bool = True) -> Column:
    """+-Inf and NaN become null (pandas treats NaN as missing)."""
    if not fractional:
        return c
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def is_infinite(c: Column) -> Column:
    """True for +-Inf."""
    return F.abs(c) == F.lit(float("inf"))


def sample_skewness(c: str) -> Column:
    """Bias-adjusted skewness G1 (pandas ``skew``, DuckDB ``skewness``); null for n < 3."""
    n = F.count(c)
    g1 = F.skewness(c)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    """Bias-adjusted excess kurtosis G2 (pandas ``kurtosis``, DuckDB ``kurtosis``); null for n < 4."""
    n = F.count(c)
    g2 = F.kurtosis(c)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
