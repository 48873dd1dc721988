"""C1-C3 (A20-A22, A25, W1-W4, P11, P12): RFM scores and segments.

Plan shape: one ``groupBy(customer_id)`` (partial aggregation, AQE skew
handling) builds the customer table; the quartile edges of Recency and
Monetary are exact distributed quantiles (five numbers each); scoring is a
``when`` chain over literals, so no window ever spans all customers.

The F score is the quartile of ``rank(method='first')`` of Frequency (ties in
ascending customer_id order).  The ranks come from a range-split of the customers and
prefix counts of the ranges (``functions.ranking``), not from a global window.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.functions.calendar import floor_days, ntz_lit
from shopsight.functions.quantiles import quantile_table
from shopsight.functions.ranking import rows_before
from shopsight.session import ensure_checkpoint_dir

QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]

# Segment names, in rule order (first match wins).
SEGMENTS = ["Champions", "Loyal Customers", "Potential Loyalists", "At Risk", "Lost Customers", "Others"]


def reference_day(df: DataFrame, time_col: str = "ts") -> _dt.datetime | None:
    """Latest timestamp + 1 day (one scalar)."""
    last = df.agg(F.max(time_col)).first()[0]
    return None if last is None else last + _dt.timedelta(days=1)


def _customer_aggregate(df: DataFrame, time_col: str) -> DataFrame:
    return df.groupBy("customer_id").agg(
        F.max(time_col).alias("_last"),
        F.count("transaction_id").alias("Frequency"),
        F.coalesce(F.sum("gross_revenue"), F.lit(0.0)).alias("Monetary"))


def _finish_base(agg: DataFrame, today) -> DataFrame:
    out = agg.select(
        "customer_id",
        floor_days(ntz_lit(today), F.col("_last")).alias("Recency"),
        "Frequency",
        F.when(F.isnan("Monetary") | (F.abs("Monetary") == float("inf")), None).otherwise(F.col("Monetary"))
        .alias("Monetary"))
    return out.na.drop("any")


def rfm_base(df: DataFrame, time_col: str = "ts", today: _dt.datetime | None = None) -> DataFrame:
    """customer_id, Recency (floored days since the last purchase),
    Frequency (non-null transaction ids), Monetary (revenue sum, 0 when all
    revenue is null).  Rows with a gap or an infinity are dropped (F1/F7)."""
    today = today if today is not None else reference_day(df, time_col)
    spark = df.sparkSession
    if today is None:
        return spark.createDataFrame([], "customer_id long, Recency long, Frequency long, Monetary double")
    return _finish_base(_customer_aggregate(df, time_col), today)


def _bucket(x: F.Column, edges: list[float]) -> F.Column:
    """1-based bucket of ``x`` among quartile ``edges`` (pandas ``qcut`` with the
    lowest edge included); with tied edges the lowest matching bucket wins."""
    expr = None
    for i, e in enumerate(edges[1:], start=1):
        cond = x <= F.lit(e)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(edges) - 1))


def _edges(df: DataFrame, cols: list[str]) -> dict[str, list[float]]:
    """Exact quartile edges of several columns in one distributed solve."""
    rows = quantile_table(df, cols, QUARTILES).collect()  # 5 values per column
    got = {(r["column"], r["q"]): r["value"] for r in rows}
    return {c: [got[(c, q)] for q in QUARTILES] for c in cols}


def frequency_ranks(customers: DataFrame) -> DataFrame:
    """``rank`` = 1, 2, 3, ... of every customer by Frequency, ties by customer_id
    (null ids last).  The customers are range-split and the ranges counted, so no task orders
    them all and a common Frequency is spread over ranges by its customers."""
    ranked = rows_before(customers, [F.col("Frequency"), F.col("customer_id").asc_nulls_last()], name="rank")
    return ranked.withColumn("rank", F.col("rank") + 1)


def rfm_scores(df: DataFrame, time_col: str = "ts", today: _dt.datetime | None = None) -> DataFrame:
    """C1 + C2: customer_id, Recency, Frequency, Monetary, R_Score, F_Score,
    M_Score, RFM_Score, Segment, CLV (= Monetary)."""
    ensure_checkpoint_dir(df.sparkSession)
    # The customer table feeds several small jobs: it is written once to the shared
    # checkpoint folder.  "Today" comes from it (max of the last purchases), not
    # from another fact-table pass.
    agg = _customer_aggregate(df, time_col).checkpoint()
    if today is None:
        last = agg.agg(F.max("_last")).first()[0]
        today = None if last is None else last + _dt.timedelta(days=1)
    n = 0 if today is None else _finish_base(agg, today).count()
    if not n:  # T21: empty input -> empty result with the full schema
        rfm = df.sparkSession.createDataFrame([], "customer_id long, Recency long, Frequency long, Monetary double")
        return rfm.select("*", *[F.lit(None).cast("string").alias(c) for c in
                                 ("R_Score", "F_Score", "M_Score", "RFM_Score", "Segment")],
                          F.col("Monetary").alias("CLV"))
    rfm = _finish_base(agg, today)
    e = _edges(rfm, ["Recency", "Monetary"])
    f_edges = [1 + (n - 1) * q for q in QUARTILES]
    scored = frequency_ranks(rfm).select(
        "customer_id", "Recency", "Frequency", "Monetary",
        (5 - _bucket(F.col("Recency"), e["Recency"])).cast("string").alias("R_Score"),
        _bucket(F.col("rank"), f_edges).cast("string").alias("F_Score"),
        _bucket(F.col("Monetary"), e["Monetary"]).cast("string").alias("M_Score"))
    scored = scored.withColumn("RFM_Score", F.concat("R_Score", "F_Score", "M_Score"))
    return scored.withColumn("Segment", segment_rule()).withColumn("CLV", F.col("Monetary"))


def segment_rule(r: str = "R_Score", f: str = "F_Score", m: str = "M_Score", rfm: str = "RFM_Score") -> F.Column:
    """C2 as column expressions; first matching rule wins."""
    hi = ["4", "3"]
    lo = ["2", "1"]
    R, Fq, M = F.col(r), F.col(f), F.col(m)
    return (F.when(F.col(rfm) == "444", SEGMENTS[0])
            .when(R.isin(*hi) & Fq.isin(*hi), SEGMENTS[1])
            .when(R.isin(*hi) & M.isin(*hi), SEGMENTS[2])
            .when(R.isin(*lo) & Fq.isin(*hi), SEGMENTS[3])
            .when(R.isin(*lo) & Fq.isin(*lo), SEGMENTS[4])
            .otherwise(SEGMENTS[5]))


def segment_distribution(scores: DataFrame) -> DataFrame:
    """Customers per segment, most common first."""
    return scores.groupBy("Segment").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "Segment")
