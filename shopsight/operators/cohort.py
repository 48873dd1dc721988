"""C4-C5 (X2, A23, R1, R3): signup cohorts and retention.

``countDistinct`` per (signup month, cohort index) is planned by Spark as two
aggregations (first by the group and customer, then by the group), both with
map-side combine, so a large cohort is spread over many tasks.  The retention
base is a join on signup month, not a per-row lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsight.functions.calendar import cohort_index, year_month


def cohort_counts(df: DataFrame, time_col: str = "ts", signup_col: str = "signup_date") -> DataFrame:
    """C4: distinct customers per (signup_month, cohort_index).  Rows without a
    signup date are dropped (the reference would fail on them, T20)."""
    return (df.where(F.col(signup_col).isNotNull() & F.col(time_col).isNotNull())
            .select(year_month(signup_col).alias("signup_month"),
                    cohort_index(time_col, signup_col).alias("cohort_index"), "customer_id")
            .groupBy("signup_month", "cohort_index").agg(F.countDistinct("customer_id").alias("customers"))
            .orderBy("signup_month", "cohort_index"))


def cohort_retention(counts: DataFrame, base: str = "first", lowest: int | None = None) -> DataFrame:
    """C5 (long form): retention % = customers / base customers x 100.

    ``base='first'`` (faithful, T11): the base column is the globally lowest
    cohort index, so a cohort without that index has null retention.
    ``base='zero'``: the base is each cohort's index 0.

    The base is found with windows over the cohort-count table, which has one
    row per (signup month, index) pair (bounded by the calendar span), so no
    extra job or self-join is needed."""
    if base == "first":
        base_idx = F.lit(lowest) if lowest is not None else F.min("cohort_index").over(Window.partitionBy())
    elif base == "zero":
        base_idx = F.lit(0)
    else:
        raise ValueError("base must be 'first' or 'zero'")
    by_month = Window.partitionBy("signup_month")
    with_base = counts.withColumn("_bidx", base_idx).withColumn(
        "_base", F.max(F.when(F.col("cohort_index") == F.col("_bidx"), F.col("customers"))).over(by_month))
    return (with_base.withColumn("retention", F.try_divide(F.col("customers").cast("double"), F.col("_base")) * 100)
            .drop("_base", "_bidx").orderBy("signup_month", "cohort_index"))


def cohort_retention_wide(retention: DataFrame, digits: int | None = 1,
                          values: list[int] | None = None) -> DataFrame:
    """C5 (wide form, R1): one row per signup month, one column per cohort
    index (the pivot values are the distinct indices, a small set)."""
    val = F.bround("retention", digits) if digits is not None else F.col("retention")
    if values is None:
        values = cohort_indices(retention)
    return (retention.select("signup_month", "cohort_index", val.alias("retention"))
            .groupBy("signup_month").pivot("cohort_index", values).agg(F.first("retention"))
            .orderBy("signup_month"))


def cohort_indices(counts: DataFrame) -> list[int]:
    """Distinct cohort indices in order (bounded by the calendar span in months)."""
    return [r[0] for r in counts.select("cohort_index").distinct().orderBy("cohort_index").collect()]


def retention_matrix(df: DataFrame, digits: int | None = 1, time_col: str = "ts",
                     signup_col: str = "signup_date") -> DataFrame:
    """C4 + C5 wide in one call: one small job for the distinct indices, then
    the pivot with explicit values (no extra distinct job inside ``pivot``)."""
    counts = cohort_counts(df, time_col, signup_col)
    values = cohort_indices(counts)
    if not values:
        return counts.select("signup_month")
    ret = cohort_retention(counts, "first", lowest=values[0])
    return cohort_retention_wide(ret, digits, values)


def cohort_sketches(df: DataFrame, time_col: str = "ts", signup_col: str = "signup_date", precision: int = 12) -> DataFrame:
    """A23, approximate: an HLL sketch of the customers per (signup_month,
    cohort_index).  Sketches of 2**``precision`` cells can be stored and merged into any
    roll-up without the customers; the relative standard error is about
    1.04 / sqrt(2**precision)."""
    return (df.where(F.col(signup_col).isNotNull() & F.col(time_col).isNotNull())
            .groupBy(year_month(signup_col).alias("signup_month"), cohort_index(time_col, signup_col).alias("cohort_index"))
            .agg(F.hll_sketch_agg(F.col("customer_id"), precision).alias("sketch")))


def sketched_customers(sketches: DataFrame, *by: str) -> DataFrame:
    """Estimated distinct customers of stored sketches, merged to the columns ``by``
    (none: one row for all)."""
    merged = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("customers")
    return sketches.groupBy(*by).agg(merged)
