"""Data profiling.

Every per-column statistic is computed for all columns in one pass: either one
wide ``agg`` (counts, moments, correlations) or one ``explode`` to a long
(column, value) table followed by a single ``groupBy`` (distinct counts, modes,
value counts).  Quartiles use the distributed exact quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.functions.numeric import (is_fractional, is_infinite, numeric_columns, sample_kurtosis,
                                         sample_skewness, string_columns)
from shopsight.functions.quantiles import quantile_table

# The columns of the reference's correlation heatmap.
CORRELATION_COLUMNS = ["quantity", "discount_applied", "gross_revenue", "age", "base_price"]


def _long(df: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    """(column, value) pairs for ``columns`` via one explode (no shuffle)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns
    ])).alias("_p")).select("_p.column", "_p.value")


def _is_missing(df: DataFrame, c: str) -> F.Column:
    col = F.col(c)
    return (col.isNull() | F.isnan(col)) if is_fractional(df, c) else col.isNull()


def dataset_shape(df: DataFrame) -> DataFrame:
    """One row with the row and column counts."""
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"))


def missing_counts(df: DataFrame, positive_only: bool = True) -> DataFrame:
    """Null (and NaN) count per column, in schema order; by default
    only columns with at least one gap (F9)."""
    spark = df.sparkSession
    if not df.columns:
        return spark.createDataFrame([], "column string, n_missing long")
    row = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in df.columns])
    order = spark.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "pos int, column string")
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_missing")) for c in df.columns
    ])).alias("_p")).select("_p.column", "_p.n_missing")
    out = F.broadcast(order).join(stacked, "column")  # one row per column on both sides
    if positive_only:
        out = out.where(F.col("n_missing") > 0)
    return out.orderBy("pos").select("column", "n_missing")


def missing_percentage(df: DataFrame) -> DataFrame:
    """Null cells / all cells x 100 (one row)."""
    n_cols = len(df.columns)
    total = sum((F.count_if(_is_missing(df, c)) for c in df.columns), F.lit(0))
    return df.agg(total.alias("missing_cells"), F.count("*").alias("rows")).select(
        "missing_cells", (F.col("rows") * n_cols).alias("cells"),
        F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("rows") * n_cols), F.lit(None).cast("double"))
        .alias("missing_pct"))


def infinity_counts(df: DataFrame, positive_only: bool = True) -> DataFrame:
    """Count of +-Inf per numeric column (only positive counts by default)."""
    spark = df.sparkSession
    cols = [c for c in numeric_columns(df) if is_fractional(df, c)]
    ints = [c for c in numeric_columns(df) if not is_fractional(df, c)]
    if not cols and not ints:
        return spark.createDataFrame([], "column string, n_infinite long")
    aggs = [F.count_if(is_infinite(F.col(c))).alias(c) for c in cols] + [F.lit(0).cast("long").alias(c) for c in ints]
    row = df.agg(*aggs)
    order = [c for c in numeric_columns(df)]
    out = row.select(F.posexplode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("n_infinite")) for c in order
    ])).alias("pos", "_p")).select("pos", "_p.column", "_p.n_infinite")
    if positive_only:
        out = out.where(F.col("n_infinite") > 0)
    return out.orderBy("pos").select("column", "n_infinite")


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max, skew and excess kurtosis per
    numeric column (bias-adjusted moments, T7).  One keyed aggregate on the
    long (column, value) table for the moments plus one distributed
    exact-quantile solve for all quartiles."""
    spark = df.sparkSession
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return spark.createDataFrame([], "column string, count long, mean double, std double, min double, "
                                         "q25 double, q50 double, q75 double, max double, skew double, kurtosis double")
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    # NaN counts as missing (pandas); nanvl keeps moments off NaN.
    d = d.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in cols])
    # Moments on the long (column, value) table: 7 aggregates per column group
    # (a wide aggregate of 7 x k functions exceeds codegen's field limit and
    # runs interpreted, ~5x slower).
    long = _long(d, cols, "double")
    spark = df.sparkSession
    pos = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "pos int, column string")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        sample_skewness("value").alias("skew"), sample_kurtosis("value").alias("kurtosis"))
    moments = F.broadcast(pos).join(moments, "column", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    q = quantile_table(d, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q25"),
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("q50"),
        F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q75"))
    return (moments.join(qw, "column", "left").orderBy("pos")
            .select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurtosis"))


def column_summary(df: DataFrame) -> DataFrame:
    """``describe(include='all')`` for numeric and string columns, one row
    per column: count, unique/top/freq (strings), mean/std/min/quartiles/max
    (numbers).  ``top`` is the most frequent value, ties broken by the lowest
    value.  Distinct counts and modes share one exploded ``groupBy``."""
    nums = numeric_columns(df)
    strs = string_columns(df)
    order = [c for c in df.columns if c in set(nums) | set(strs)]
    spark = df.sparkSession
    pos = spark.createDataFrame([(i, c) for i, c in enumerate(order)], "pos int, column string")
    parts = []
    if strs:
        vc = _long(df, strs, "string").where(F.col("value").isNotNull()).groupBy("column", "value").agg(
            F.count("*").alias("n"))
        s = vc.groupBy("column").agg(
            F.sum("n").alias("count"), F.count("*").alias("unique"))
        # top: highest count, then lowest value (window over distinct values of one column)
        w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
        top = vc.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
            "column", F.col("value").alias("top"), F.col("n").alias("freq"))
        s = s.join(top, "column")
        parts.append(s.select("column", F.col("count").cast("long").alias("count"), "unique", "top", "freq",
                              *[F.lit(None).cast("double").alias(x) for x in
                                ("mean", "std", "min", "q25", "q50", "q75", "max")]))
    if nums:
        n = numeric_summary(df, nums)
        parts.append(n.select("column", "count", F.lit(None).cast("long").alias("unique"),
                              F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"),
                              "mean", "std", "min", "q25", "q50", "q75", "max"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return F.broadcast(pos).join(out, "column").orderBy("pos").drop("pos")


def timestamp_summary(df: DataFrame) -> DataFrame:
    """What ``describe(include='all')`` gives for date and timestamp columns:
    count, mean, min, quartiles and max, in schema order, to the microsecond
    (means and interpolated quartiles rounded down)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    spark = df.sparkSession
    stats = ["mean", "min", "q25", "q50", "q75", "max"]
    if not cols:
        return spark.createDataFrame([], ", ".join(["column string", "count long", *(f"{c} timestamp" for c in stats)]))
    micros = df.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in cols])
    long = _long(micros, cols, "long")
    pos = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "pos int, column string")
    moments = long.groupBy("column").agg(F.count("value").alias("count"), F.sum(F.col("value").cast("decimal(20,0)")).alias("_sum"),
                                         F.min("value").alias("min"), F.max("value").alias("max"))
    moments = moments.withColumn("mean", F.expr("CASE WHEN count > 0 THEN _sum div count END"))
    q = quantile_table(micros, cols, [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("q") == x, F.floor("value"))).alias(c) for c, x in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    return (F.broadcast(pos).join(moments, "column", "left").join(q, "column", "left").orderBy("pos")
            .select("column", F.coalesce("count", F.lit(0)).alias("count"), *[F.timestamp_micros(c).alias(c) for c in stats]))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10,
                 max_columns: int | None = 5) -> DataFrame:
    """The ``top`` most frequent values of each string column with
    their count and share of non-null rows (rounded half-even to 2 digits).

    One exploded ``groupBy(column, value)``; the per-column top-k window gets a
    partial group limit before its shuffle, so a column with millions of
    distinct values only ships ``top`` rows per map task."""
    cols = list(columns) if columns is not None else string_columns(df)
    if max_columns is not None:
        cols = cols[:max_columns]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, rank int, value string, count long, share double")
    vc = _long(df, cols, "string").where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count("*").alias("count"))
    totals = vc.groupBy("column").agg(F.sum("count").alias("_total"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    ranked = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    pos = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "pos int, column string")
    return (ranked.join(F.broadcast(totals), "column").join(F.broadcast(pos), "column")
            .select("pos", "column", "rank", "value", "count",
                    F.bround(F.col("count") / F.col("_total"), 2).alias("share"))
            .orderBy("pos", "rank").drop("pos"))


def value_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every value of each string column with its count and share of non-null
    rows (rounded half-even to 2 digits), by column and falling count."""
    cols = list(columns) if columns is not None else string_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, value string, count long, share double")
    vc = _long(df, cols, "string").where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("count"))
    totals = vc.groupBy("column").agg(F.sum("count").alias("_total"))
    pos = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "pos int, column string")
    return (vc.join(F.broadcast(totals), "column").join(F.broadcast(pos), "column")
            .select("pos", "column", "value", "count", F.bround(F.col("count") / F.col("_total"), 2).alias("share"))
            .orderBy("pos", F.desc("count"), "value").drop("pos"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, complete_rows: bool = True) -> DataFrame:
    """Pearson correlation for every pair of ``columns`` (default: the
    five heatmap columns that exist), as a long table (row, col, corr).

    ``complete_rows`` first drops rows with a gap in any of the columns (A19);
    otherwise each pair uses its own complete rows (pandas ``corr``).

    Plan: pass 1 gets means and gap counts; without gaps, pass 2 sums the
    centred cross products (k(k+1)/2 plain sums that stay in whole-stage
    codegen and are numerically stable).  With gaps, one aggregate of
    pairwise ``corr`` handles each pair's own complete rows."""
    cols = [c for c in (columns if columns is not None else CORRELATION_COLUMNS) if c in df.columns]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "row string, col string, corr double")
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    d = d.select(*[F.when(F.isnan(c) | is_infinite(F.col(c)), None).otherwise(F.col(c)).alias(c) for c in cols])
    if complete_rows:
        d = d.na.drop("any")
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = d.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(cols)]).first()
    values: dict[tuple[int, int], float | None] = {}
    if all(first[f"g{i}"] == 0 for i in range(k)):
        cen = [(F.col(c) - F.lit(first[f"m{i}"])) for i, c in enumerate(cols)] if first["m0"] is not None else None
        if cen is not None:
            row = d.agg(*[F.sum(cen[i] * cen[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
            for i, j in pairs:
                den = (row[f"s{i}_{i}"] or 0.0) * (row[f"s{j}_{j}"] or 0.0)
                values[(i, j)] = row[f"s{i}_{j}"] / den ** 0.5 if den > 0 else None
    else:
        row = d.agg(*[F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            v = row[f"c{i}_{j}"]
            values[(i, j)] = None if v is None or v != v else v
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            cells.append((i, j, a, b, values.get((min(i, j), max(i, j)))))
    return (spark.createDataFrame(cells, "i int, j int, row string, col string, corr double")
            .orderBy("i", "j").select("row", "col", "corr"))


def high_correlation_pairs(df: DataFrame, threshold: float = 0.7, columns: Sequence[str] | None = None) -> DataFrame:
    """D11 (threshold is ours): numeric column pairs with |r| above ``threshold``
    (upper triangle, pairwise-complete rows), strongest first."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    cm = correlation_matrix(df, cols, complete_rows=False)
    idx = {c: i for i, c in enumerate(cols)}
    spark = df.sparkSession
    pos = spark.createDataFrame(list(idx.items()), "name string, p int")
    return (cm.join(F.broadcast(pos.withColumnRenamed("name", "row").withColumnRenamed("p", "pi")), "row")
            .join(F.broadcast(pos.withColumnRenamed("name", "col").withColumnRenamed("p", "pj")), "col")
            .where((F.col("pi") < F.col("pj")) & (F.abs("corr") > threshold))
            .select(F.col("row").alias("feature_a"), F.col("col").alias("feature_b"), "corr")
            .orderBy(F.desc(F.abs("corr")), "feature_a", "feature_b"))


def drop_correlated(df: DataFrame, threshold: float = 0.7, columns: Sequence[str] | None = None) -> DataFrame:
    """Which of the numeric columns to keep.  The columns are taken in order; one
    whose |r| with a column kept before it exceeds ``threshold`` is dropped for the
    strongest such column.  One row a column: column, kept, dropped_for, corr.  The
    choice itself runs over the k x k correlations, not over rows."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    r = {(x["row"], x["col"]): x["corr"] for x in correlation_matrix(df, cols, complete_rows=False).collect()}
    kept, rows = [], []
    for c in cols:
        near = [(abs(r[(k, c)]), k) for k in kept if r[(k, c)] is not None and abs(r[(k, c)]) > threshold]
        best = max(near, key=lambda x: x[0])[1] if near else None
        if best is None:
            kept.append(c)
        rows.append((c, best is None, best, None if best is None else float(r[(best, c)])))
    return df.sparkSession.createDataFrame(rows, "column string, kept boolean, dropped_for string, corr double")
