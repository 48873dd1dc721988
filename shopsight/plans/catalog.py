"""Registered reports: name -> (spark, sf_dir) -> DataFrame, plus the matching
DuckDB oracle SQL.  Reports read the stand-in tables of a test folder; the
wrappers only fix output types for the cross-engine check (doubles rounded,
dates/timestamps rendered as ISO text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.functions.numeric import numeric_columns
from shopsight.operators import profile, revenue
from shopsight.plans.oracle import ORACLE, register
from shopsight.plans.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def stable(df: DataFrame, digits: int = 4, per_col: dict[str, int] | None = None) -> DataFrame:
    """Round doubles and render dates/timestamps as text so results hash the
    same in every engine."""
    out = []
    per_col = per_col or {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round_binary(c.cast("double"), per_col.get(f.name, digits))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def round_binary(c, digits: int):
    """round(x * 10^d) / 10^d on the binary value (half away from zero), the
    rounding most SQL engines apply to doubles; equal inputs round equally."""
    m = float(10 ** digits)
    return F.round(c * F.lit(m)) / F.lit(m)


def query(name: str, sql: str | None = None, digits: int = 4, per_col: dict[str, int] | None = None):
    def deco(fn: Callable[[Workspace], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return stable(fn(Workspace(spark, sf_dir)), digits, per_col)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            register(name, sql)
        return fn
    return deco


def r(expr: str, digits: int = 4, alias: str | None = None) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {digits}) AS {alias or expr}"


TS = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"

CLEAN_SELECT = ", ".join([
    "transaction_id", "customer_id", r("product_id"), TS.format(c="ts"), r("quantity"), r("discount_applied"),
    r("gross_revenue"), "is_refunded", "campaign_id", TS.format(c="signup_date"), "country", r("age"), "gender",
    "loyalty_tier", "acquisition_channel", "category", "brand", r("base_price"), TS.format(c="launch_date"),
    r("is_premium")])


# ---------------------------------------------------------------- tier 0: clean
@query("clean_transactions", f"SELECT {CLEAN_SELECT} FROM clean")
def _clean_transactions(ws: Workspace) -> DataFrame:
    """the cleaned fact table."""
    return ws.clean()


ALL_COLUMNS = ["transaction_id", "customer_id", "product_id", "ts", "quantity", "discount_applied",
               "gross_revenue", "is_refunded", "campaign_id", "signup_date", "country", "age", "gender",
               "loyalty_tier", "acquisition_channel", "category", "brand", "base_price", "launch_date",
               "is_premium"]
DOUBLE_COLUMNS = ["quantity", "discount_applied", "gross_revenue", "base_price"]


def _gaps_sql(table: str) -> str:
    """Per-column gap counts of ``table`` in schema order (long form)."""
    parts = [f"SELECT {i} AS pos, '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS n_missing FROM {table}"
             for i, c in enumerate(ALL_COLUMNS)]
    return " UNION ALL ".join(parts)


@query("raw_missing_counts", f"""
SELECT "column", n_missing FROM ({_gaps_sql('raw')}) WHERE n_missing > 0""")
def _raw_missing_counts(ws: Workspace) -> DataFrame:
    """Gaps per column on the joined table before cleaning."""
    return profile.missing_counts(ws.raw())


# ------------------------------------------------------------ tier 1: revenue
@query("revenue_by_month", f"""
SELECT strftime(ts, '%Y-%m') AS year_month, {r('COALESCE(SUM(gross_revenue), 0)', 4, 'gross_revenue')}
FROM clean GROUP BY 1""", digits=4)
def _revenue_by_month(ws):
    """A1."""
    return revenue.revenue_by_month(ws.clean())


@query("revenue_by_day", f"""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, {r('COALESCE(SUM(gross_revenue), 0)', 4, 'gross_revenue')}
FROM clean GROUP BY 1""", digits=4)
def _revenue_by_day(ws):
    """A2."""
    return revenue.revenue_by_day(ws.clean())


@query("revenue_by_weekday", f"""
SELECT d.weekday, {r('s.gross_revenue', 4, 'gross_revenue')}
FROM (VALUES ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'), ('Friday'), ('Saturday'), ('Sunday')) d(weekday)
LEFT JOIN (SELECT dayname(ts) AS weekday, SUM(gross_revenue) AS gross_revenue FROM clean GROUP BY 1) s
  ON d.weekday = s.weekday""", digits=4)
def _revenue_by_weekday(ws):
    """A3."""
    return revenue.revenue_by_weekday(ws.clean())


@query("revenue_by_month_number", f"""
SELECT month(ts) AS month, {r('COALESCE(SUM(gross_revenue), 0)', 4, 'gross_revenue')}
FROM clean GROUP BY 1""", digits=4)
def _revenue_by_month_number(ws):
    """A4."""
    return revenue.revenue_by_month_number(ws.clean())


for _name, _col, _val in [("revenue_by_country", "country", "gross_revenue"),
                          ("revenue_by_gender", "gender", "gross_revenue"),
                          ("revenue_by_loyalty_tier", "loyalty_tier", "gross_revenue"),
                          ("revenue_by_category", "category", "gross_revenue"),
                          ("quantity_by_category", "category", "quantity")]:
    register(_name, f"""
SELECT {_col}, {r(f'COALESCE(SUM({_val}), 0)', 4, _val)} FROM clean WHERE {_col} IS NOT NULL GROUP BY 1""")

query("revenue_by_country", None, 4)(lambda ws: revenue.revenue_by_country(ws.clean()))
query("revenue_by_gender", None, 4)(lambda ws: revenue.revenue_by_gender(ws.clean()))
query("revenue_by_loyalty_tier", None, 4)(lambda ws: revenue.revenue_by_loyalty_tier(ws.clean()))
query("revenue_by_category", None, 4)(lambda ws: revenue.revenue_by_category(ws.clean()))
query("quantity_by_category", None, 4)(lambda ws: revenue.quantity_by_category(ws.clean()))

_AGE_BAND_SQL = """CASE WHEN age > 18 AND age <= 25 THEN '18-24' WHEN age > 25 AND age <= 35 THEN '25-34'
  WHEN age > 35 AND age <= 45 THEN '35-44' WHEN age > 45 AND age <= 55 THEN '45-54'
  WHEN age > 55 AND age <= 65 THEN '55-64' WHEN age > 65 AND age <= 100 THEN '65+' END"""


@query("revenue_by_age_group", f"""
SELECT b.age_group, {r('COALESCE(s.gross_revenue, 0)', 4, 'gross_revenue')}
FROM (VALUES ('18-24'), ('25-34'), ('35-44'), ('45-54'), ('55-64'), ('65+')) b(age_group)
LEFT JOIN (SELECT {_AGE_BAND_SQL} AS age_group, SUM(gross_revenue) AS gross_revenue FROM clean GROUP BY 1) s
  ON b.age_group = s.age_group""", digits=4)
def _revenue_by_age_group(ws):
    """A6."""
    return revenue.revenue_by_age_group(ws.clean())


@query("age_histogram", f"""
WITH s AS (SELECT MIN(CAST(age AS DOUBLE)) AS lo, MAX(CAST(age AS DOUBLE)) AS hi FROM clean),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1.0 END AS w FROM s),
b AS (SELECT CAST(LEAST(FLOOR((CAST(age AS DOUBLE) - lo) / w), 29) AS INTEGER) AS bin, lo, w
      FROM clean CROSS JOIN w WHERE age IS NOT NULL)
SELECT bin, {r('lo + bin * w', 4, 'bin_start')}, {r('lo + (bin + 1) * w', 4, 'bin_end')}, COUNT(*) AS count
FROM b GROUP BY bin, lo, w""")
def _age_histogram(ws):
    """30 equal-width bins over [min, max]."""
    return revenue.age_histogram(ws.clean(), n_bins=30)


# ---------------------------------------------------------- tier 2: profiling
@query("dataset_shape", "SELECT COUNT(*) AS rows, CAST(20 AS BIGINT) AS columns FROM clean")
def _dataset_shape(ws):
    """A12."""
    return profile.dataset_shape(ws.clean())


@query("missing_counts", f"""
SELECT "column", n_missing FROM ({_gaps_sql('clean')}) WHERE n_missing > 0""")
def _missing_counts(ws):
    """A14 on the cleaned table (gaps left after cleaning; normally none)."""
    return profile.missing_counts(ws.clean())


@query("missing_percentage", f"""
SELECT CAST(SUM(n_missing) AS BIGINT) AS missing_cells, CAST(MAX(n) * 20 AS BIGINT) AS cells,
       {r('SUM(n_missing) * 100.0 / (MAX(n) * 20)', 4, 'missing_pct')}
FROM ({_gaps_sql('clean')}) g CROSS JOIN (SELECT COUNT(*) AS n FROM clean) t""")
def _missing_percentage(ws):
    """A24 on the cleaned table."""
    return profile.missing_percentage(ws.clean())


_INF_SQL = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS \"column\", CAST(COUNT(*) FILTER (WHERE isinf({c})) AS BIGINT) AS n_infinite FROM clean"
    for i, c in enumerate(DOUBLE_COLUMNS))


@query("infinity_counts", f"""
SELECT "column", n_infinite FROM ({_INF_SQL}) WHERE n_infinite > 0""")
def _infinity_counts(ws):
    """A15."""
    return profile.infinity_counts(ws.clean())


@query("refund_rate", f"""
SELECT COUNT(*) AS transactions, CAST(SUM(is_refunded) AS BIGINT) AS refunds,
       {r('SUM(is_refunded) / COUNT(*)', 6, 'refund_rate')} FROM clean""", digits=6)
def _refund_rate(ws):
    """D5."""
    return revenue.refund_rate(ws.clean())


@query("refunds_by_category", f"""
SELECT category, COUNT(*) AS transactions, CAST(SUM(is_refunded) AS BIGINT) AS refunds,
       {r('SUM(is_refunded) / COUNT(*)', 6, 'refund_rate')} FROM clean GROUP BY category""", digits=6)
def _refunds_by_category(ws):
    """D6."""
    return revenue.refunds_by_category(ws.clean())


@query("campaign_summary", f"""
SELECT campaign_id, {r('COALESCE(SUM(gross_revenue), 0)', 4, 'revenue')}, COUNT(*) AS orders,
       CAST(SUM(is_refunded) AS BIGINT) AS refunds, COUNT(DISTINCT customer_id) AS customers
FROM clean GROUP BY campaign_id""", digits=4)
def _campaign_summary(ws):
    """D7 (campaign key of the stand-in: supplier key mod 10)."""
    return revenue.campaign_summary(ws.clean())


def oracle() -> dict[str, str]:
    return dict(ORACLE)


# ------------------------------------------------------------- tier 3: RFM
from shopsight.operators import cohort as _cohort  # noqa: E402
from shopsight.operators import rfm as _rfm  # noqa: E402

_RFM_CTE = """
, rfm AS (
  SELECT customer_id,
         CAST(FLOOR((epoch_us((SELECT MAX(ts) FROM clean) + INTERVAL 1 DAY) - epoch_us(MAX(ts))) / 86400000000.0)
              AS BIGINT) AS Recency,
         COUNT(transaction_id) AS Frequency,
         COALESCE(SUM(gross_revenue), 0) AS Monetary
  FROM clean GROUP BY customer_id
), edges AS (
  SELECT quantile_cont(Recency, [0, 0.25, 0.5, 0.75, 1]) AS re,
         quantile_cont(Monetary, [0, 0.25, 0.5, 0.75, 1]) AS me, COUNT(*) AS n FROM rfm
), scored AS (
  SELECT customer_id, Recency, Frequency, Monetary,
    CAST(5 - CASE WHEN Recency <= re[2] THEN 1 WHEN Recency <= re[3] THEN 2 WHEN Recency <= re[4] THEN 3 ELSE 4 END
         AS VARCHAR) AS R_Score,
    CASE WHEN frank <= FLOOR(1 + (n - 1) * 0.25) THEN '1' WHEN frank <= FLOOR(1 + (n - 1) * 0.5) THEN '2'
         WHEN frank <= FLOOR(1 + (n - 1) * 0.75) THEN '3' ELSE '4' END AS F_Score,
    CASE WHEN Monetary <= me[2] THEN '1' WHEN Monetary <= me[3] THEN '2' WHEN Monetary <= me[4] THEN '3' ELSE '4' END
         AS M_Score
  FROM (SELECT rfm.*, ROW_NUMBER() OVER (ORDER BY Frequency, customer_id) AS frank FROM rfm) CROSS JOIN edges
), segmented AS (
  SELECT *, R_Score || F_Score || M_Score AS RFM_Score,
    CASE WHEN R_Score || F_Score || M_Score = '444' THEN 'Champions'
         WHEN R_Score IN ('4', '3') AND F_Score IN ('4', '3') THEN 'Loyal Customers'
         WHEN R_Score IN ('4', '3') AND M_Score IN ('4', '3') THEN 'Potential Loyalists'
         WHEN R_Score IN ('2', '1') AND F_Score IN ('4', '3') THEN 'At Risk'
         WHEN R_Score IN ('2', '1') AND F_Score IN ('2', '1') THEN 'Lost Customers'
         ELSE 'Others' END AS Segment,
    Monetary AS CLV
  FROM scored
)
"""


@query("rfm_base", _RFM_CTE + f"SELECT customer_id, Recency, Frequency, {r('Monetary')} FROM rfm")
def _rfm_base(ws):
    """A20."""
    return _rfm.rfm_base(ws.clean())


@query("frequency_ranks", _RFM_CTE + """
SELECT customer_id, Frequency, frank AS "rank" FROM (
  SELECT customer_id, Frequency, ROW_NUMBER() OVER (ORDER BY Frequency, customer_id) AS frank FROM rfm)""")
def _frequency_ranks(ws):
    """The rank of every customer by Frequency."""
    return _rfm.frequency_ranks(_rfm.rfm_base(ws.clean()).select("customer_id", "Frequency"))


@query("rfm_scores", _RFM_CTE + f"""
SELECT customer_id, Recency, Frequency, {r('Monetary')}, R_Score, F_Score, M_Score, RFM_Score, Segment, {r('CLV')}
FROM segmented""")
def _rfm_scores(ws):
    """C1."""
    return _rfm.rfm_scores(ws.clean())


@query("rfm_segments", _RFM_CTE + "SELECT customer_id, RFM_Score, Segment FROM segmented")
def _rfm_segments(ws):
    """C2."""
    return _rfm.rfm_scores(ws.clean()).select("customer_id", "RFM_Score", "Segment")


@query("rfm_segment_distribution", _RFM_CTE + 'SELECT Segment, COUNT(*) AS "count" FROM segmented GROUP BY Segment')
def _rfm_segment_distribution(ws):
    """C3."""
    return _rfm.segment_distribution(_rfm.rfm_scores(ws.clean()))


# ---------------------------------------------------------- tier 4: cohorts
_COHORT_CTE = """
, cc AS (
  SELECT strftime(signup_date, '%Y-%m') AS signup_month,
         CAST(FLOOR(datediff('day', date_trunc('month', signup_date), date_trunc('month', ts)) / 30) AS BIGINT)
           AS cohort_index,
         COUNT(DISTINCT customer_id) AS customers
  FROM clean WHERE signup_date IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2
), ret AS (
  SELECT cc.signup_month, cc.cohort_index, cc.customers,
         CAST(cc.customers AS DOUBLE) / b.customers * 100 AS retention
  FROM cc LEFT JOIN (SELECT signup_month, customers FROM cc
                     WHERE cohort_index = (SELECT MIN(cohort_index) FROM cc)) b
    ON cc.signup_month = b.signup_month
)
"""


@query("cohort_counts", _COHORT_CTE + "SELECT signup_month, cohort_index, customers FROM cc")
def _cohort_counts(ws):
    """C4."""
    return _cohort.cohort_counts(ws.clean())


@query("cohort_retention_long", _COHORT_CTE + f"SELECT signup_month, cohort_index, customers, {r('retention')} FROM ret")
def _cohort_retention_long(ws):
    """C5 (long), base = globally lowest cohort index."""
    return _cohort.cohort_retention(_cohort.cohort_counts(ws.clean()))


@query("cohort_customers_approx")
def _cohort_customers_approx(ws):
    """A23, approximate: customers per cohort and index from stored HLL sketches, and
    the roll-up of each cohort (index null)."""
    sketches = _cohort.cohort_sketches(ws.clean()).checkpoint()
    return _cohort.sketched_customers(sketches, "signup_month", "cohort_index").unionByName(
        _cohort.sketched_customers(sketches, "signup_month"), allowMissingColumns=True)


@query("cohort_retention_wide")
def _cohort_retention_wide(ws):
    """C5 (wide pivot, retention rounded to 1 digit half-even)."""
    return _cohort.retention_matrix(ws.clean())


# ------------------------------------------------------ tier 2: profiling (cont.)
NUMERIC_CLEAN = ["transaction_id", "customer_id", "product_id", "quantity", "discount_applied", "gross_revenue",
                 "is_refunded", "campaign_id", "age", "base_price", "is_premium"]
STRING_CLEAN = ["country", "gender", "loyalty_tier", "acquisition_channel", "category", "brand"]


def _num_stats_sql(cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS pos, '{c}' AS \"column\", COUNT({c}) AS count, AVG({x}) AS mean, STDDEV_SAMP({x}) AS std, "
            f"MIN({x}) AS min, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50, "
            f"quantile_cont({x}, 0.75) AS q75, MAX({x}) AS max, skewness({x}) AS skew, kurtosis({x}) AS kurtosis "
            f"FROM clean")
    return " UNION ALL ".join(parts)


_NUM_OUT = ", ".join(['"column"', "count"] + [r(c, 6) for c in
                                               ("mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurtosis")])


@query("numeric_summary", f"SELECT {_NUM_OUT} FROM ({_num_stats_sql(NUMERIC_CLEAN)})", digits=6)
def _numeric_summary(ws):
    """A16."""
    return profile.numeric_summary(ws.clean())


def _str_stats_sql(cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM clean "
                     f"WHERE {c} IS NOT NULL GROUP BY {c}")
    vc = " UNION ALL ".join(parts)
    return f"""SELECT "column", SUM(n) AS count, COUNT(*) AS "unique",
  arg_min(value, (-n, value)) AS top, MAX(n) AS freq FROM ({vc}) GROUP BY "column" """


@query("column_summary", f"""
SELECT "column", CAST(count AS BIGINT) AS count, CAST("unique" AS DOUBLE) AS "unique", top, CAST(freq AS DOUBLE) AS freq,
       NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50,
       NULL::DOUBLE AS q75, NULL::DOUBLE AS max
FROM ({_str_stats_sql(STRING_CLEAN)})
UNION ALL
SELECT "column", count, NULL::DOUBLE, NULL::VARCHAR, NULL::DOUBLE,
       {", ".join(r(c, 6) for c in ("mean", "std", "min", "q25", "q50", "q75", "max"))}
FROM ({_num_stats_sql(NUMERIC_CLEAN)})""", digits=6)
def _column_summary(ws):
    """A13 (unique/freq as doubles: they are null for numeric columns)."""
    out = profile.column_summary(ws.clean())
    return out.withColumn("unique", F.col("unique").cast("double")).withColumn("freq", F.col("freq").cast("double"))


TIMESTAMP_CLEAN = ["ts", "signup_date", "launch_date"]


def _ts_stats_sql(cols: list[str]) -> str:
    def text(micros: str, name: str) -> str:
        return f"strftime(make_timestamp(CAST({micros} AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS {name}"

    parts = []
    for c in cols:
        x = f"epoch_us(CAST({c} AS TIMESTAMP))"
        quartiles = [text(f"FLOOR(quantile_cont({x}, {p}))", n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
        parts.append(f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, {text(f'SUM({x}) // COUNT({c})', 'mean')}, {text(f'MIN({x})', 'min')}, "
                     f"{', '.join(quartiles)}, {text(f'MAX({x})', 'max')} FROM clean")
    return " UNION ALL ".join(parts)


@query("timestamp_summary", _ts_stats_sql(TIMESTAMP_CLEAN))
def _timestamp_summary(ws):
    """The date and timestamp columns."""
    return profile.timestamp_summary(ws.clean())


def _value_counts_sql(cols: list[str], top: int = 10) -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM clean "
             f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols]
    vc = " UNION ALL ".join(parts)
    return f"""SELECT "column", CAST(rank AS INTEGER) AS rank, value, count, {r('round_even(count / total, 2)', 4, 'share')}
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank,
             SUM(count) OVER (PARTITION BY "column") AS total FROM ({vc}))
WHERE rank <= {top}"""


def _value_shares_sql(cols: list[str]) -> str:
    vc = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM clean "
                            f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)
    return f"""SELECT "column", value, count, {r('round_even(count / total, 2)', 4, 'share')}
FROM (SELECT *, SUM(count) OVER (PARTITION BY "column") AS total FROM ({vc}))"""


@query("value_counts", _value_counts_sql(STRING_CLEAN[:5]))
def _value_counts(ws):
    """First five string columns, top 10 values with shares."""
    return profile.value_counts(ws.clean(), max_columns=5)


@query("value_shares", _value_shares_sql(STRING_CLEAN))
def _value_shares(ws):
    """Every string column, all values with shares."""
    return profile.value_shares(ws.clean())


_CORR5 = ["quantity", "discount_applied", "gross_revenue", "age", "base_price"]


def _corr_sql(cols: list[str], complete: bool, table: str = "clean") -> str:
    src = table
    if complete:
        src = f"(SELECT * FROM {table} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols) + ")"
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS \"row\", '{b}' AS col, "
                         f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS corr FROM {src}")
    return " UNION ALL ".join(parts)


@query("correlation_matrix", f'SELECT "row", col, {r("corr")} FROM ({_corr_sql(_CORR5, True)})')
def _correlation_matrix(ws):
    """A19."""
    return profile.correlation_matrix(ws.clean())


@query("numeric_correlations", f'SELECT "row", col, {r("corr")} FROM ({_corr_sql(NUMERIC_CLEAN, False)})')
def _numeric_correlations(ws):
    """D3: all pairs of numeric columns."""
    df = ws.clean()
    return profile.correlation_matrix(df, numeric_columns(df), complete_rows=False)


@query("high_correlation_pairs", f"""
SELECT "row" AS feature_a, col AS feature_b, {r('corr')} FROM ({_corr_sql(NUMERIC_CLEAN, False)})
WHERE i < j AND ABS(corr) > 0.7""")
def _high_correlation_pairs(ws):
    """D3 + D11: all numeric columns, pairs with |r| > 0.7."""
    return profile.high_correlation_pairs(ws.clean(), threshold=0.7)


def _group_stats_sql(cols: list[str]) -> str:
    parts = []
    for c in cols:
        m = []
        for v in ("gross_revenue", "quantity"):
            m += [f"COALESCE(SUM({v}), 0) AS {v}_sum", f"AVG({v}) AS {v}_mean", f"median({v}) AS {v}_median",
                  f"STDDEV_SAMP({v}) AS {v}_std", f"COUNT({v}) AS {v}_count"]
        parts.append(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, {', '.join(m)} FROM clean "
                     f"WHERE {c} IS NOT NULL GROUP BY {c}")
    return " UNION ALL ".join(parts)


_GS_OUT = ", ".join(['"column"', "value"] + [
    x for v in ("gross_revenue", "quantity") for x in
    (r(f"{v}_sum", 4), r(f"{v}_mean", 6), r(f"{v}_median", 6), r(f"{v}_std", 6), f"{v}_count")])


@query("group_statistics", f"SELECT {_GS_OUT} FROM ({_group_stats_sql(STRING_CLEAN)})", digits=6)
def _group_statistics(ws):
    """sum/mean/median/std/count of revenue and quantity by every categorical column."""
    out = revenue.group_statistics(ws.clean())
    return out.select(*[F.round(c, 4).alias(c) if c.endswith("_sum") else F.col(c) for c in out.columns])


# ------------------------------------------------ tier 5: documented operators
from shopsight.operators import features as _features  # noqa: E402
from shopsight.operators import sampling as _sampling  # noqa: E402
from shopsight.operators import timeseries as _ts  # noqa: E402


@query("daily_decomposition", f"""
, daily AS (SELECT CAST(ts AS DATE) AS date, SUM(gross_revenue) AS observed FROM clean GROUP BY 1)
, span AS (SELECT MIN(date) AS d0, MAX(date) AS d1 FROM daily)
, days AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date, d0 FROM span)
, series AS (SELECT days.date, datediff('day', days.d0, days.date) AS t, COALESCE(daily.observed, 0) AS observed
             FROM days LEFT JOIN daily ON days.date = daily.date)
, tr AS (SELECT *, COUNT(*) OVER () AS n,
           (SUM(observed) OVER (ORDER BY t ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)
            - 0.5 * (LAG(observed, 15) OVER (ORDER BY t) + LEAD(observed, 15) OVER (ORDER BY t))) / 30 AS ma
         FROM series)
, tr2 AS (SELECT date, t, observed, CASE WHEN t >= 15 AND t < n - 15 THEN ma END AS trend, t % 30 AS phase FROM tr)
, pa AS (SELECT phase, AVG(observed - trend) AS pa FROM tr2 GROUP BY phase)
, pc AS (SELECT phase, pa - AVG(pa) OVER () AS seasonal FROM pa)
SELECT strftime(date, '%Y-%m-%d') AS date, {r('observed')}, {r('trend', 2)}, {r('seasonal', 2)},
       {r('observed - trend - seasonal', 2, 'resid')}
FROM tr2 JOIN pc ON tr2.phase = pc.phase""", digits=2, per_col={"observed": 4})
def _daily_decomposition(ws):
    """Period 30, additive, zero-filled missing days."""
    return _ts.daily_decomposition(ws.clean(), period=30)


_DAYS = "CAST(FLOOR((epoch_us({a}) - epoch_us({b})) / 86400000000.0) AS BIGINT)"
_CUST_CTE = f"""
, cf AS (
  SELECT customer_id, COUNT(*) AS total_purchases, SUM(quantity) AS total_quantity, AVG(quantity) AS avg_basket_size,
         COALESCE(SUM(gross_revenue), 0) AS total_revenue,
         CAST(SUM(CAST(gross_revenue AS DECIMAL(38, 4))) AS DOUBLE) / COUNT(gross_revenue) AS avg_order_value,
         {_DAYS.format(a="(SELECT MAX(ts) FROM clean) + INTERVAL 1 DAY", b="MAX(ts)")} AS days_since_last_purchase
  FROM clean GROUP BY customer_id)
"""


@query("customer_features", _CUST_CTE + f"""
SELECT customer_id, total_purchases, {r('total_quantity')}, {r('avg_basket_size', 6)}, {r('total_revenue')},
       {r('avg_order_value', 6)}, days_since_last_purchase FROM cf""", digits=6)
def _customer_features(ws):
    """D10."""
    out = _features.customer_features(ws.clean())
    return out.withColumn("total_quantity", F.round("total_quantity", 4)).withColumn(
        "total_revenue", F.round("total_revenue", 4))


@query("churn_labels", _CUST_CTE + """
SELECT customer_id, days_since_last_purchase, CAST(days_since_last_purchase > 90 AS INTEGER) AS churned FROM cf""")
def _churn_labels(ws):
    """Churned when the last purchase is more than 90 days old."""
    return _features.churn_labels(_features.customer_features(ws.clean()), 90).select(
        "customer_id", "days_since_last_purchase", "churned")


def _key_sql(cols: list[tuple[str, str]], seed: int = 42) -> str:
    parts = [f"'{seed}'"]
    for c, kind in cols:
        if kind == "d":
            parts.append(f"CAST(CAST(ROUND(CAST({c} AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR)")
        elif kind == "t":
            parts.append(f"strftime({c}, '%Y-%m-%d %H:%M:%S')")
        else:
            parts.append(f"CAST({c} AS VARCHAR)")
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


_CLEAN_KINDS = [("transaction_id", "i"), ("customer_id", "i"), ("product_id", "d"), ("ts", "t"), ("quantity", "d"),
                ("discount_applied", "d"), ("gross_revenue", "d"), ("is_refunded", "i"), ("campaign_id", "i"),
                ("signup_date", "t"), ("country", "s"), ("age", "d"), ("gender", "s"), ("loyalty_tier", "s"),
                ("acquisition_channel", "s"), ("category", "s"), ("brand", "s"), ("base_price", "d"),
                ("launch_date", "t"), ("is_premium", "d")]


@query("discount_revenue_sample", f"""
SELECT transaction_id, customer_id, {r('discount_applied')}, {r('gross_revenue')} FROM clean
ORDER BY {_key_sql(_CLEAN_KINDS)} LIMIT 2000""")
def _discount_revenue_sample(ws):
    """2000 rows chosen by seeded row hash (bottom-k)."""
    return _sampling.hash_sample(ws.clean(), 2000, seed=42).select(
        "transaction_id", "customer_id", "discount_applied", "gross_revenue")


_FEATS = _features.NUMERIC_FEATURES + _features.DERIVED_FEATURES + _features.CATEGORICAL_FEATURES


def _codes(c: str) -> str:
    return (f"(SELECT v AS {c}_v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS {c}_code "
            f"FROM (SELECT DISTINCT CAST(COALESCE({c}, 'Unknown') AS VARCHAR) AS v FROM clean)) {c}_t")


_ENC_CTE = f"""
, enc AS (
  SELECT CAST(quantity AS DOUBLE) AS quantity, CAST(discount_applied AS DOUBLE) AS discount_applied,
         CAST(age AS DOUBLE) AS age, CAST(base_price AS DOUBLE) AS base_price,
         CAST({_DAYS.format(a="ts", b="signup_date")} AS DOUBLE) AS days_since_signup,
         CAST(COALESCE({_DAYS.format(a="ts", b="launch_date")}, 0) AS DOUBLE) AS product_age_days,
         COALESCE(CAST(is_premium AS DOUBLE), 0) AS is_premium,
         {", ".join(f"{c}_code AS {c}" for c in _features.CATEGORICAL_FEATURES)},
         CAST(gross_revenue AS DOUBLE) AS gross_revenue
  FROM clean
  {" ".join(f"JOIN {_codes(c)} ON CAST(COALESCE(clean.{c}, 'Unknown') AS VARCHAR) = {c}_t.{c}_v"
            for c in _features.CATEGORICAL_FEATURES)}
), split AS (
  SELECT *, CASE WHEN CAST(('0x' || substr({_key_sql([(f, 'd') for f in _FEATS + ['gross_revenue']])}, 1, 8))
                           AS BIGINT) % 100 < 80 THEN 'train' ELSE 'validation' END AS split
  FROM enc
)
"""


@query("label_encoded_features", _ENC_CTE + f"SELECT {', '.join(r(f) for f in _FEATS + ['gross_revenue'])} FROM enc")
def _label_encoded_features(ws):
    """M1-M8: 13 model features (reference order) and the target."""
    return ws.model_table().drop("split")


@query("train_validation_split", _ENC_CTE + f"""
SELECT {', '.join(r(f) for f in _FEATS + ['gross_revenue'])}, split FROM split""")
def _train_validation_split(ws):
    """80/20 split by seeded row hash."""
    return ws.model_table()


_SCALE_STATS = ", ".join(f"AVG({f}) AS m_{f}, STDDEV_POP({f}) AS s_{f}" for f in _FEATS)


@query("scaled_features", _ENC_CTE + f"""
, st AS (SELECT {_SCALE_STATS} FROM split WHERE split = 'train')
SELECT {', '.join(r(f"({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END", 6, f) for f in _FEATS)},
       {r('gross_revenue')}, split
FROM split CROSS JOIN st""", digits=6)
def _scaled_features(ws):
    """Standardised with train-split mean and population std."""
    d = ws.model_table()
    out = _features.scale_features(d, _FEATS, fit_on=d.where(F.col("split") == "train"))
    return out.withColumn("gross_revenue", F.round("gross_revenue", 4))


@query("min_max_features", _ENC_CTE + f"""
, st AS (SELECT {', '.join(f"MIN({f}) AS lo_{f}, MAX({f}) AS hi_{f}" for f in _FEATS)} FROM split WHERE split = 'train')
SELECT {', '.join(r(f"({f} - lo_{f}) / CASE WHEN hi_{f} = lo_{f} THEN 1 ELSE hi_{f} - lo_{f} END", 6, f) for f in _FEATS)},
       {r('gross_revenue')}, split
FROM split CROSS JOIN st""", digits=6)
def _min_max_features(ws):
    """Scaled to the train split's range."""
    d = ws.model_table()
    out = _features.scale_features(d, _FEATS, fit_on=d.where(F.col("split") == "train"), method="minmax")
    return out.withColumn("gross_revenue", F.round("gross_revenue", 4))


@query("repurchases", f"""
, nx AS (SELECT transaction_id, customer_id, ts, LEAD(ts) OVER (PARTITION BY customer_id ORDER BY ts, transaction_id) AS next_ts
         FROM clean WHERE customer_id IS NOT NULL AND ts IS NOT NULL)
, dd AS (SELECT *, {_DAYS.format(a="next_ts", b="ts")} AS days,
                {_DAYS.format(a="(SELECT MAX(ts) FROM clean) + INTERVAL 1 DAY", b="ts")} AS remaining FROM nx)
SELECT transaction_id, customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(next_ts, '%Y-%m-%d %H:%M:%S') AS next_ts,
       CAST(CASE WHEN days <= 90 THEN 1 WHEN days IS NOT NULL OR remaining > 90 THEN 0 END AS INTEGER) AS repurchased FROM dd""")
def _repurchases(ws):
    """Each purchase with the customer's next one."""
    return _features.repurchases(ws.clean())


@query("date_parts", """
SELECT transaction_id, CAST(year(ts) AS INTEGER) AS year, CAST(hour(ts) AS INTEGER) AS hour, CAST(year(launch_date) AS INTEGER) AS launch_year
FROM clean""")
def _date_parts(ws):
    """Year and hour of the purchase, year of the launch."""
    from shopsight.functions.calendar import visual_columns
    return visual_columns(ws.clean()).select("transaction_id", *[F.col(c).cast("int").alias(c) for c in ("year", "hour", "launch_year")])


_CF_COLUMNS = ["total_purchases", "total_quantity", "avg_basket_size", "total_revenue", "avg_order_value", "days_since_last_purchase"]
_CF_PAIRS = [(a, b) for b in range(len(_CF_COLUMNS)) for a in range(b)]


@query("uncorrelated_features", _CUST_CTE + f"""
, rs AS (SELECT {', '.join(f'corr({_CF_COLUMNS[a]}, {_CF_COLUMNS[b]}) AS r{a}_{b}' for a, b in _CF_PAIRS)} FROM cf)
, pr(a, b, r) AS ({' UNION ALL '.join(f'SELECT {a}, {b}, r{a}_{b} FROM rs' for a, b in _CF_PAIRS)})
, names(i, "column") AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_CF_COLUMNS))})
, near AS (SELECT i, COALESCE(list(a) FILTER (abs(r) > 0.7), []) AS others FROM names LEFT JOIN pr ON b = i GROUP BY i)
, picked AS (SELECT * FROM (WITH RECURSIVE g(i, kept) AS (
    SELECT 0, [0] UNION ALL
    SELECT near.i, CASE WHEN list_has_any(near.others, g.kept) THEN g.kept ELSE list_append(g.kept, near.i) END FROM g JOIN near ON near.i = g.i + 1)
  SELECT kept FROM g ORDER BY i DESC LIMIT 1))
, best AS (SELECT b, arg_max(a, abs(r)) AS a, arg_max(r, abs(r)) AS r FROM pr, picked WHERE list_contains(kept, a) AND NOT list_contains(kept, b) AND abs(r) > 0.7 GROUP BY b)
SELECT n."column", list_contains(kept, n.i) AS kept, o."column" AS dropped_for, {r('best.r', 6, 'corr')}
FROM names n CROSS JOIN picked LEFT JOIN best ON best.b = n.i LEFT JOIN names o ON o.i = best.a""", digits=6)
def _uncorrelated_features(ws):
    """Which customer features stay when correlated ones go."""
    return profile.drop_correlated(_features.customer_features(ws.clean()), 0.7, _CF_COLUMNS)


_ONE_HOT = ("country", "loyalty_tier", "category")


@query("one_hot_features")
def _one_hot_features(ws):
    """One-hot vectors of country, loyalty tier and category (as arrays)."""
    from pyspark.ml.functions import vector_to_array
    out = _features.one_hot_features(ws.clean())
    return out.select("transaction_id", *[vector_to_array(f"{c}_onehot").alias(f"{c}_onehot")
                                          for c in ("country", "loyalty_tier", "category")])


@query("one_hot_positions", "".join(f", {c}_k AS (SELECT {c} AS {c}_v, CAST(ROW_NUMBER() OVER (ORDER BY {c}) AS INTEGER) AS {c}_position, CAST(COUNT(*) OVER () AS INTEGER) AS {c}_levels "
                                    f"FROM (SELECT DISTINCT {c} FROM clean))" for c in _ONE_HOT) + """
SELECT transaction_id, """ + ", ".join(f"{c}_position, {c}_levels" for c in _ONE_HOT) + " FROM clean " + " ".join(f"JOIN {c}_k ON {c} = {c}_v" for c in _ONE_HOT))
def _one_hot_positions(ws):
    """Where each one-hot vector has its one (from 1), and its length."""
    from pyspark.ml.functions import vector_to_array
    out = _features.one_hot_features(ws.clean(), _ONE_HOT)
    return out.select("transaction_id", *[x for c in _ONE_HOT for x in (
        F.array_position(vector_to_array(f"{c}_onehot"), 1.0).cast("int").alias(f"{c}_position"), F.size(vector_to_array(f"{c}_onehot")).alias(f"{c}_levels"))])


# ------------------------------------------------------- tiers 6-8: models
from shopsight.operators import models as _models  # noqa: E402


def _model_data(ws: Workspace) -> DataFrame:
    return ws.model_table()


def _lr(ws):
    return ws.fitted("lr", lambda: _models.linear_regression_metrics(_model_data(ws)))


def _gbt(ws):
    return ws.fitted("gbt", lambda: _models.gbt_metrics(_model_data(ws)))


def _net(ws):
    return ws.fitted("net", lambda: _models.network_metrics(_model_data(ws)))


def _clf(ws):
    return ws.fitted("clf", lambda: _models.churn_classifier(_models.churn_dataset(ws.clean())))


@query("linear_regression_metrics", digits=6)
def _q_lr(ws):
    """OLS, MAE/RMSE/R² on train and validation."""
    return _lr(ws)[1]


@query("actual_vs_predicted", digits=6)
def _q_avp(ws):
    """1000 validation rows, actual vs OLS prediction, y range."""
    return _models.actual_vs_predicted(_model_data(ws), _lr(ws)[0])


@query("gbt_metrics", digits=6)
def _q_gbt(ws):
    """100 trees, rate 0.05, depth 5."""
    return _gbt(ws)[1]


@query("gbt_feature_importance", digits=6)
def _q_gbt_imp(ws):
    """Top-10 feature importances of the boosted trees."""
    return _models.feature_importance(_gbt(ws)[0], _features.feature_names(_model_data(ws)), ws.spark)


@query("boosting_history", digits=6)
def _q_gbt_hist(ws):
    """Train and validation MSE of the boosted trees by number of trees."""
    d = _model_data(ws)
    return _models.boosting_history(d, _gbt(ws)[0], _features.feature_names(d))


@query("ann_metrics", digits=6)
def _q_ann(ws):
    """64-32-16-1 ReLU regressor, Adam, 30 epochs, data-parallel gradients."""
    return _net(ws)[1]


@query("training_history", digits=6)
def _q_hist(ws):
    """Per-epoch train / validation MSE of the network."""
    return _net(ws)[2]


@query("model_comparison", digits=6)
def _q_cmp(ws):
    """OLS vs 50-tree GBT on validation, with best flags."""
    return ws.fitted("cmp", lambda: _models.model_comparison(_model_data(ws)).cache())


@query("classifier_metrics", digits=6)
def _q_clf(ws):
    """Churn network (128-64-1, sigmoid), test loss and accuracy."""
    return _clf(ws)[1]


@query("classifier_history", digits=6)
def _q_clf_hist(ws):
    """Loss and accuracy of both splits by epoch."""
    return _clf(ws)[2]


@query("confusion_matrix")
def _q_conf(ws):
    """Test-set confusion matrix of the churn network."""
    return _clf(ws)[3]


# -------------------------------------------------------------- previews (L2)
@query("clean_preview", f"""
SELECT {CLEAN_SELECT} FROM clean
ORDER BY transaction_id, customer_id, product_id, quantity, discount_applied, gross_revenue, is_refunded,
         campaign_id LIMIT 5""")
def _clean_preview(ws):
    """L2: first five rows of the cleaned table (by transaction id, then row values)."""
    return _sampling.preview(ws.clean(), 5, ["transaction_id", "customer_id", "product_id", "quantity",
                                             "discount_applied", "gross_revenue", "is_refunded", "campaign_id"])


@query("rfm_preview", _RFM_CTE + f"""
SELECT customer_id, Recency, Frequency, {r('Monetary')}, R_Score, F_Score, M_Score, RFM_Score, Segment, {r('CLV')}
FROM segmented ORDER BY customer_id LIMIT 10""")
def _rfm_preview(ws):
    """L2: first ten customers of the RFM table (customer id order, as the reference's sorted group-by)."""
    return _sampling.preview(_rfm.rfm_scores(ws.clean()), 10, ["customer_id"])
