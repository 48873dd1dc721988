"""Revenue and quantity breakdowns.

Each breakdown is one ``groupBy`` with partial (map-side) aggregation, so a hot
group key costs one row per map task in the shuffle.  Fixed small dimensions
(weekdays, age bands) are joined as literal tables of at most seven rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.functions.calendar import (AGE_BAND_LABELS, WEEKDAY_ORDER, age_band, weekday_name, year_month)
from shopsight.functions.quantiles import quantile_table

REVENUE = "gross_revenue"


def _sum0(col: str, alias: str) -> F.Column:
    """pandas sum: nulls skipped, an all-null group gives 0."""
    return F.coalesce(F.sum(col), F.lit(0.0)).alias(alias)


def revenue_by(df: DataFrame, key: F.Column | str, key_name: str, value: str = REVENUE,
               descending: bool = False) -> DataFrame:
    """Generic ``groupby(key)[value].sum()``; null keys are dropped (pandas rule)."""
    k = F.col(key) if isinstance(key, str) else key
    out = (df.select(k.alias(key_name), F.col(value))
           .where(F.col(key_name).isNotNull())
           .groupBy(key_name).agg(_sum0(value, value)))
    if descending:
        return out.orderBy(F.desc(value), F.asc(key_name))
    return out.orderBy(key_name)


def revenue_by_month(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """A1."""
    return revenue_by(df, year_month(time_col), "year_month")


def revenue_by_day(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """A2: one row per calendar date with sales."""
    return revenue_by(df, F.to_date(time_col), "date")


def revenue_by_weekday(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """A3: Monday..Sunday, a weekday without sales gives a null revenue row."""
    spark = df.sparkSession
    days = spark.createDataFrame(list(enumerate(WEEKDAY_ORDER)), "weekday_pos int, weekday string")
    agg = (df.groupBy(weekday_name(time_col).alias("weekday")).agg(F.sum(REVENUE).alias(REVENUE)))
    return (F.broadcast(days).join(agg, "weekday", "left")
            .orderBy("weekday_pos").select("weekday", REVENUE))


def revenue_by_month_number(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """A4."""
    return revenue_by(df, F.month(time_col), "month")


def revenue_by_country(df: DataFrame) -> DataFrame:
    """A5: descending revenue."""
    return revenue_by(df, "country", "country", descending=True)


def revenue_by_age_group(df: DataFrame) -> DataFrame:
    """Every band is listed; empty bands give 0; ages outside (18, 100] are dropped."""
    spark = df.sparkSession
    bands = spark.createDataFrame(list(enumerate(AGE_BAND_LABELS)), "band_pos int, age_group string")
    agg = (df.select(age_band("age").alias("age_group"), REVENUE).where(F.col("age_group").isNotNull())
           .groupBy("age_group").agg(F.sum(REVENUE).alias("_s")))
    return (F.broadcast(bands).join(agg, "age_group", "left")
            .select("age_group", F.coalesce("_s", F.lit(0.0)).alias(REVENUE), "band_pos")
            .orderBy("band_pos").drop("band_pos"))


def revenue_by_gender(df: DataFrame) -> DataFrame:
    """A7."""
    return revenue_by(df, "gender", "gender")


def revenue_by_loyalty_tier(df: DataFrame) -> DataFrame:
    """A8."""
    return revenue_by(df, "loyalty_tier", "loyalty_tier")


def revenue_by_category(df: DataFrame) -> DataFrame:
    """Descending revenue."""
    return revenue_by(df, "category", "category", descending=True)


def quantity_by_category(df: DataFrame) -> DataFrame:
    """A10: descending quantity."""
    return revenue_by(df, "category", "category", value="quantity", descending=True)


def age_histogram(df: DataFrame, n_bins: int = 30, width: float | None = None, column: str = "age") -> DataFrame:
    """Equal-width histogram of ``column`` with at most ``n_bins`` bins over
    [min, max] (the last bin is closed).  Bins without rows are omitted.
    ``width`` overrides the computed width.  Columns: bin, bin_start, bin_end, count."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    if width:
        w = float(width)
        nb = int((hi - lo) // w) + 1
    else:
        w = (hi - lo) / n_bins if hi > lo else 1.0
        nb = n_bins
    x = F.col(column).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)).cast("int"), F.lit(nb - 1))
    return (df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("bin_start"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("bin_end"), "count")
            .orderBy("bin"))


def group_statistics(df: DataFrame, group_cols: Sequence[str] | None = None,
                     values: Sequence[str] = (REVENUE, "quantity")) -> DataFrame:
    """Sum, mean, median, std and count of each value column by every
    categorical column, in one long table (column, value, metric columns).

    The (column, value) pairs are produced by one ``explode`` so all groupings
    share a single shuffle; medians use the distributed exact quantile."""
    from shopsight.functions.numeric import string_columns
    group_cols = list(group_cols) if group_cols is not None else string_columns(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("column"), F.col(g).cast("string").alias("value"))
                                for g in group_cols])).alias("_g")
    long = df.select(pairs, *values).select("_g.column", "_g.value", *values).where(F.col("value").isNotNull())
    aggs = []
    for v in values:
        aggs += [_sum0(v, f"{v}_sum"), F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"),
                 F.count(v).alias(f"{v}_count")]
    base = long.groupBy("column", "value").agg(*aggs)
    # all medians in one distributed solve, the measures side by side: a sketch a measure
    # under one key keeps the keys of a task below the number from which Spark sorts its rows
    med = quantile_table(long.withColumnRenamed("value", "_val"), values, [0.5], keys=["column", "_val"], name="_m")
    med_wide = med.groupBy("column", "_val").agg(*[
        F.max(F.when(F.col("_m") == v, F.col("value"))).alias(f"{v}_median") for v in values])
    base = base.join(med_wide.withColumnRenamed("_val", "value"), ["column", "value"], "left")
    ordered = ["column", "value"]
    for v in values:
        ordered += [f"{v}_sum", f"{v}_mean", f"{v}_median", f"{v}_std", f"{v}_count"]
    return base.select(*ordered)


def refund_rate(df: DataFrame, flag: str = "is_refunded") -> DataFrame:
    """Refunded transactions / all transactions (one row)."""
    return df.agg(F.count("*").alias("transactions"),
                  F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("refunds")).select(
        "transactions", "refunds", F.try_divide(F.col("refunds"), F.col("transactions")).alias("refund_rate"))


def refunds_by_category(df: DataFrame, flag: str = "is_refunded") -> DataFrame:
    """Refunds, transactions and refund rate per category (descending refunds)."""
    return (df.groupBy("category").agg(F.count("*").alias("transactions"),
                                       F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("refunds"))
            .withColumn("refund_rate", F.try_divide(F.col("refunds"), F.col("transactions")))
            .orderBy(F.desc("refunds"), "category"))


def campaign_summary(df: DataFrame, campaigns: DataFrame | None = None, key: str = "campaign_id",
                     flag: str = "is_refunded") -> DataFrame:
    """Revenue, orders, refunds and customers per campaign.  When a
    ``campaigns`` table is given its attributes are left-joined."""
    out = df.groupBy(key).agg(
        _sum0(REVENUE, "revenue"), F.count("*").alias("orders"),
        F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("refunds"),
        F.countDistinct("customer_id").alias("customers"))
    if campaigns is not None:
        out = out.join(campaigns, key, "left")
    return out.orderBy(key)
