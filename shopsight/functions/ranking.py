"""Row numbers over a whole table without a window in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.session import ensure_checkpoint_dir

#: ``monotonically_increasing_id`` holds the partition above this bit, the row below.
_ROW_BITS = 33


def rows_before(df: DataFrame, order: Sequence[Column], *, count_col: str | None = None, name: str = "before", parts: int | None = None) -> DataFrame:
    """``df`` with a long column ``name``: the number of rows that come before a row
    in ``order`` (each row counts as ``count_col`` rows where that is given).

    The table is split into ranges of ``order``, sorted within each, and cut from its
    lineage in the shared checkpoint folder, so that a lost executor cannot draw the
    ranges anew.  A row's number is the prefix count of its range plus its place there;
    the prefix table has one row a range.  Rows that tie in all of ``order`` meet in
    one range: pass a unique key, or aggregate equal rows to ``count_col`` first."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    at, part, offset = (_free(df, c) for c in ("_at", "_part", "_offset"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()).checkpoint()
    ranged = ranged.withColumn(part, F.shiftright(at, _ROW_BITS))
    sizes = ranged.groupBy(part).agg(F.sum(count_col).alias(offset) if count_col else F.count("*").alias(offset))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum(offset).over(ahead), F.lit(0)).alias(offset))  # one row a range
    if count_col:
        within = F.coalesce(F.sum(count_col).over(Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranged = ranged.withColumn(at, within)
    else:
        ranged = ranged.withColumn(at, F.col(at).bitwiseAND((1 << _ROW_BITS) - 1))
    return ranged.join(F.broadcast(sizes), part).select(*df.columns, (F.col(offset) + F.col(at)).cast("long").alias(name))


def _free(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
