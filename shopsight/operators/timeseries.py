"""Additive decomposition of daily revenue (trend, seasonal, residual).

The fact table is first reduced to one row per (series, day) by a partial
aggregate, gaps are filled with zero-revenue days, and the moving average is a
row-frame window.  The window is partitioned by the series keys; without keys
the single series has one row per calendar day (thousands of rows), which is
the only data that reaches one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_series(df: DataFrame, time_col: str = "ts", value: str = "gross_revenue",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Daily sums with every missing day between the first and last day filled with 0."""
    keys = list(keys)
    daily = (df.where(F.col(time_col).isNotNull())
             .groupBy(*keys, F.to_date(time_col).alias("date")).agg(F.sum(value).alias("observed")))
    span = daily.groupBy(*keys).agg(F.min("date").alias("_d0"), F.max("date").alias("_d1"))
    days = span.select(*keys, "_d0", F.explode(F.sequence("_d0", "_d1", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return (days.join(daily, [*keys, "date"], "left")
            .select(*keys, "date", F.datediff("date", "_d0").alias("t"),
                    F.coalesce("observed", F.lit(0.0)).alias("observed")))


def decompose(series: DataFrame, period: int = 30, keys: Sequence[str] = (), value: str = "observed") -> DataFrame:
    """Classical additive decomposition (centred moving average trend, period
    means of the detrended series centred to zero, residual).  ``series`` has
    ``keys..., t`` (0-based day index) and ``value``."""
    keys = list(keys)
    half = period // 2
    w = Window.partitionBy(*keys).orderBy("t")
    win = w.rowsBetween(-half, half)
    n = F.max("t").over(Window.partitionBy(*keys)) + 1
    y = F.col(value)
    if period % 2 == 0:  # 2 x period moving average: half weights at both ends
        ma = (F.sum(y).over(win) - 0.5 * (F.lag(y, half).over(w) + F.lead(y, half).over(w))) / period
    else:
        ma = F.sum(y).over(win) / period
    trended = series.withColumn("_n", n).withColumn(
        "trend", F.when((F.col("t") >= half) & (F.col("t") < F.col("_n") - half), ma))
    detr = trended.withColumn("_phase", F.pmod(F.col("t"), F.lit(period)))
    phase_avg = detr.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_pa"))
    centred = phase_avg.withColumn("seasonal", F.col("_pa") - F.avg("_pa").over(Window.partitionBy(*keys)))
    out = detr.join(centred.select(*keys, "_phase", "seasonal"), [*keys, "_phase"], "left")
    return (out.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
            .drop("_phase", "_n").orderBy(*keys, "t"))


def daily_decomposition(df: DataFrame, time_col: str = "ts", value: str = "gross_revenue", period: int = 30,
                        keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., date, observed, trend, seasonal, resid``."""
    s = daily_series(df, time_col, value, keys)
    return decompose(s, period, keys).select(*keys, "date", "observed", "trend", "seasonal", "resid")
