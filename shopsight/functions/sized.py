"""Broadcasting behind a check of the size in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_BYTES = 16 << 20


def table_bytes(df: DataFrame) -> int:
    """About the bytes of a table's rows in memory: 16 a column, and the length of
    texts.  Reads the whole table, so pass one that is written or cheap."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = F.lit(16 * max(len(df.columns), 1)).cast("long")
    for t in texts:
        width = width + t
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_bytes``; beyond that it is
    left to a shuffle join, whose skewed partitions AQE splits."""
    return F.broadcast(df) if table_bytes(df) <= max_bytes else df
