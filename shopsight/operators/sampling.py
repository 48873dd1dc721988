"""Repeatable sampling and splitting by row hash.

A row's fate depends only on its own values and the seed (md5 of a canonical
text form), so it does not change with partitioning, retries or executor
loss, and the same rule can be written in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_key(df: DataFrame, columns: Sequence[str] | None = None, seed: int = 42) -> Column:
    """Canonical text of a row: integers as digits, doubles scaled by 1e4 and
    rounded to integers, timestamps as ``yyyy-MM-dd HH:mm:ss``, strings as is;
    nulls are skipped; the seed is the first field."""
    cols = list(columns) if columns is not None else df.columns
    parts = [F.lit(str(seed))]
    for c in cols:
        t = df.schema[c].dataType
        x = F.col(c)
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            parts.append(F.round(x.cast("double") * 10000).cast("long").cast("string"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            parts.append(F.date_format(x, "yyyy-MM-dd HH:mm:ss"))
        elif isinstance(t, T.DateType):
            parts.append(F.date_format(x, "yyyy-MM-dd"))
        else:
            parts.append(x.cast("string"))
    return F.concat_ws("|", *parts)


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, seed: int = 42) -> Column:
    return F.md5(row_key(df, columns, seed))


def hash_sample(df: DataFrame, n: int = 2000, seed: int = 42, columns: Sequence[str] | None = None) -> DataFrame:
    """``min(n, rows)`` rows with the smallest row hashes (bottom-k).
    Planned as a per-partition top-k plus a bounded final merge."""
    return df.withColumn("_h", row_hash(df, columns, seed)).orderBy("_h").limit(n).drop("_h")


def split_bucket(df: DataFrame, seed: int = 42, columns: Sequence[str] | None = None) -> Column:
    """0..99 bucket from the first 32 bits of the row hash."""
    h = row_hash(df, columns, seed)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(100))


def train_validation_split(df: DataFrame, validation_pct: int = 20, seed: int = 42,
                           columns: Sequence[str] | None = None) -> DataFrame:
    """Adds ``split`` = 'train' / 'validation' (about ``validation_pct`` %)."""
    b = split_bucket(df, seed, columns)
    return df.withColumn("split", F.when(b < 100 - validation_pct, "train").otherwise("validation"))


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """L2: the first ``n`` rows in a stated order (a top-n per task plus a
    bounded merge; without an order Spark's ``limit`` order is arbitrary)."""
    cols = list(order_by) if order_by is not None else df.columns
    return df.orderBy(*cols).limit(n)
