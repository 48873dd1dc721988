"""Feature preparation and customer-level features."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.functions.calendar import floor_days, ntz_lit
from shopsight.functions.quantiles import exact_median_row
from shopsight.functions.ranking import rows_before
from shopsight.functions.sized import broadcast_if_small
from shopsight.operators.clean import UNKNOWN

# Model inputs in the reference's order, and the target.
NUMERIC_FEATURES = ["quantity", "discount_applied", "age", "base_price"]
DERIVED_FEATURES = ["days_since_signup", "product_age_days", "is_premium"]
CATEGORICAL_FEATURES = ["country", "gender", "loyalty_tier", "acquisition_channel", "category", "brand"]
TARGET = "gross_revenue"


def feature_names(df: DataFrame) -> list[str]:
    return [f for f in NUMERIC_FEATURES + DERIVED_FEATURES + CATEGORICAL_FEATURES if f in df.columns]


def value_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M3's dictionary as a table: ``column, value, code``, where ``code`` is the dense
    rank 0..k-1 of a column's distinct non-null values in ascending order.  One exploded
    distinct, then prefix counts over ranges of (column, value), so a column may
    have any number of values; it is written once to the shared checkpoint folder."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_p")
    ).select("_p.column", "_p.value").where(F.col("value").isNotNull()).distinct()
    placed = rows_before(pairs, [F.col("column"), F.col("value")], name="_at")
    first = placed.groupBy("column").agg(F.min("_at").alias("_from"))  # one row a column
    return placed.join(F.broadcast(first), "column").select("column", "value", (F.col("_at") - F.col("_from")).alias("code")).checkpoint()


def with_codes(df: DataFrame, columns: Sequence[str], codes: DataFrame, suffix: str = "") -> DataFrame:
    """``df`` with each of ``columns`` replaced by its code (or, with a ``suffix``, the
    code added under that name).  A value that the dictionary lacks, and a null, get no
    code.  A column's dictionary is broadcast if its bytes allow, else joined by shuffle;
    nulls keep out of that shuffle's hot key by AQE's skew splitting."""
    for c in columns:
        part = broadcast_if_small(codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code")))
        df = df.join(part, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
        df = df.withColumn(c + suffix, F.col("_code")).drop("_code")
    return df


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M3: sorted distinct values -> 0..k-1, fitted on all rows.  The codes are plain
    numbers to learners, as in the reference (T13)."""
    cols = [c for c in columns if c in df.columns]
    return with_codes(df, cols, value_codes(df, cols)) if cols else df


def label_encoded_features(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """M1-M8: model table = 13 feature columns (reference order) + target,
    rows with any gap dropped (M7)."""
    d = df
    num = [c for c in NUMERIC_FEATURES if c in d.columns]
    for c in num:  # M1: F1 then median fill (a no-op after cleaning unless gaps remain)
        d = d.withColumn(c, F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf")), None)
                         .otherwise(F.col(c)))
    gaps = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in num]).first().asDict() if num else {}
    fill_cols = [c for c in num if gaps.get(c, 0) > 0]
    if fill_cols:
        med = exact_median_row(d, fill_cols)
        d = d.fillna({c: v for c, v in med.items() if v is not None})
    cats = [c for c in CATEGORICAL_FEATURES if c in d.columns]
    d = d.fillna(UNKNOWN, subset=cats)                     # M2
    for c in cats:
        d = d.withColumn(c, F.col(c).cast("string"))
    d = label_encode(d, cats)                               # M3
    d = d.withColumn("days_since_signup", floor_days(time_col, "signup_date"))              # M4
    d = d.withColumn("product_age_days", F.coalesce(floor_days(time_col, "launch_date"), F.lit(0)))  # M5
    d = d.withColumn("is_premium", F.coalesce(F.col("is_premium").cast("double"), F.lit(0.0)))      # M6
    feats = feature_names(d)
    out = d.select(*[F.col(f).cast("double").alias(f) for f in feats], F.col(TARGET).cast("double").alias(TARGET))
    # M7: drop rows with a gap.  Applied to the model columns after the
    # projection: on the cleaned table every other numeric/string column and
    # launch_date are filled, and gaps in ts/signup_date surface as gaps in the
    # day features.  (A not-null filter over all columns would be pushed below
    # the projections and inline every derived expression into one predicate,
    # ~5x slower.)
    return out.na.drop("any")


def validate_features(df: DataFrame, feats: Sequence[str], min_rows: int = 100) -> int:
    """M9: one aggregate; raises on empty input or non-finite values, warns on few rows."""
    import warnings
    aggs = [F.count("*").alias("_n")] + [
        F.count_if(F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == float("inf"))).alias(f) for f in feats]
    row = df.agg(*aggs).first().asDict()
    n = row.pop("_n")
    if n == 0:
        raise ValueError("no rows left for modelling after cleaning")
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ValueError(f"non-finite feature values: {bad}")
    if n < min_rows:
        warnings.warn(f"low sample size for models: {n} rows")
    return n


def one_hot_features(df: DataFrame, columns: Sequence[str] = ("country", "loyalty_tier", "category")) -> DataFrame:
    """One-hot vectors (all levels kept, by ascending value; a null has no level)
    for ``columns``, as sparse ML vectors ``<column>_onehot``."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    codes = value_codes(df, cols)
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}  # one row a column
    out = with_codes(df, cols, codes, "_idx")
    for c in cols:
        size = max(sizes.get(c, 0), 1)
        slot = F.coalesce(F.col(f"{c}_idx"), F.lit(size)).cast("int")
        out = out.withColumn(f"{c}_idx", slot.alias(f"{c}_idx", metadata={"ml_attr": {"type": "nominal", "num_vals": int(size) + 1}}))
    enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_onehot" for c in cols], dropLast=True)
    return enc.fit(out).transform(out).drop(*[f"{c}_idx" for c in cols])


def scale_features(df: DataFrame, feats: Sequence[str], fit_on: DataFrame | None = None,
                   method: str = "standard") -> DataFrame:
    """Standardise with the mean and **population** std of ``fit_on``
    (the training rows, as scikit-learn does, T17), or min-max scale.  The
    statistics are one aggregate; the transform is a projection."""
    src = fit_on if fit_on is not None else df
    if method == "standard":
        row = src.agg(*[F.avg(f).alias(f"m_{f}") for f in feats], *[F.stddev_pop(f).alias(f"s_{f}") for f in feats]).first()
        cols = []
        for f in feats:
            m, s = row[f"m_{f}"], row[f"s_{f}"]
            s = s if s else 1.0  # constant column -> 0 after centring (scikit-learn rule)
            cols.append(((F.col(f) - F.lit(m)) / F.lit(s)).alias(f))
    elif method == "minmax":
        row = src.agg(*[F.min(f).alias(f"lo_{f}") for f in feats], *[F.max(f).alias(f"hi_{f}") for f in feats]).first()
        cols = []
        for f in feats:
            lo, hi = row[f"lo_{f}"], row[f"hi_{f}"]
            rng = (hi - lo) if (hi is not None and lo is not None and hi != lo) else 1.0
            cols.append(((F.col(f) - F.lit(lo)) / F.lit(rng)).alias(f))
    else:
        raise ValueError("method must be 'standard' or 'minmax'")
    keep = [c for c in df.columns if c not in set(feats)]
    return df.select(*cols, *keep)


def money_avg(col: str, scale: int = 4) -> F.Column:
    """Average of a money column with an exact sum (decimal, ``scale`` digits)
    so the result does not depend on summation order."""
    return F.sum(F.col(col).cast(f"decimal(38,{scale})")).cast("double") / F.count(col)


def customer_features(df: DataFrame, time_col: str = "ts", today: _dt.datetime | None = None) -> DataFrame:
    """Per customer: purchases, total and average basket size (quantity),
    total and average revenue, floored days since the last purchase (relative
    to the latest timestamp + 1 day)."""
    if today is None:
        last = df.agg(F.max(time_col)).first()[0]
        today = None if last is None else last + _dt.timedelta(days=1)
    agg = df.groupBy("customer_id").agg(
        F.count("*").alias("total_purchases"), F.sum("quantity").alias("total_quantity"),
        F.avg("quantity").alias("avg_basket_size"), F.coalesce(F.sum("gross_revenue"), F.lit(0.0)).alias("total_revenue"),
        money_avg("gross_revenue").alias("avg_order_value"), F.max(time_col).alias("_last"))
    return agg.select("customer_id", "total_purchases", "total_quantity", "avg_basket_size", "total_revenue",
                      "avg_order_value",
                      floor_days(ntz_lit(today), F.col("_last")).alias("days_since_last_purchase"))


def churn_cutoff(today: _dt.datetime, horizon_days: int = 90) -> _dt.datetime:
    """Whoever bought after this moment has not churned, as more than
    ``horizon_days`` whole days lie between it and the reference day."""
    return today - _dt.timedelta(days=horizon_days + 1)


def churn_labels(features: DataFrame, horizon_days: int = 90) -> DataFrame:
    """D13 (horizon is ours): churned = 1 when the last purchase is more than
    ``horizon_days`` before the reference day."""
    return features.withColumn("churned", (F.col("days_since_last_purchase") > horizon_days).cast("int"))


def repurchases(df: DataFrame, time_col: str = "ts", horizon_days: int = 90, today: _dt.datetime | None = None) -> DataFrame:
    """D13 per purchase: transaction_id, customer_id, ``ts``, the customer's next purchase
    time (by time, then transaction_id) and ``repurchased``: 1 if it comes within
    ``horizon_days`` whole days, 0 if it does not, null where the reference day (latest
    time + 1 day) is too near to tell.  Purchases without a customer or a time are left out.

    ``lead`` over a customer would order a heavy customer in one task; here all purchases
    get row numbers by (customer, time, id) from range prefix counts, and each is joined
    with the next number, so a heavy customer is spread over ranges and tasks."""
    rows = df.where(F.col("customer_id").isNotNull() & F.col(time_col).isNotNull()).select("transaction_id", "customer_id", F.col(time_col).alias("ts"))
    if today is None:
        last = rows.agg(F.max("ts")).first()[0]
        today = None if last is None else last + _dt.timedelta(days=1)
    placed = rows_before(rows, [F.col("customer_id"), F.col("ts"), F.col("transaction_id")], name="_at")
    after = placed.select((F.col("_at") - 1).alias("_at"), F.col("customer_id").alias("_who"), F.col("ts").alias("next_ts"))
    both = placed.join(after, "_at", "left").withColumn("next_ts", F.when(F.col("_who") == F.col("customer_id"), F.col("next_ts")))
    days, left = floor_days(F.col("next_ts"), F.col("ts")), floor_days(ntz_lit(today), F.col("ts"))
    flag = F.when(days <= horizon_days, 1).when(days.isNotNull() | (left > horizon_days), 0)
    return both.select("transaction_id", "customer_id", "ts", "next_ts", flag.alias("repurchased"))
