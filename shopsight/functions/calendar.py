"""Calendar keys and day arithmetic with pandas semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday order used by the weekday report (Monday first).
WEEKDAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Age bands, right-closed bins 18,25,35,45,55,65,100 and their labels.
AGE_BIN_EDGES = [18, 25, 35, 45, 55, 65, 100]
AGE_BAND_LABELS = ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]

_MICROS_PER_DAY = 86_400_000_000


def year_month(ts: str | Column) -> Column:
    """``YYYY-MM`` month key."""
    return F.date_format(_c(ts), "yyyy-MM")


def weekday_name(ts: str | Column) -> Column:
    """P5: English weekday name."""
    return F.date_format(_c(ts), "EEEE")


def weekday_position(ts: str | Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.pmod(F.dayofweek(_c(ts)) + 5, F.lit(7))


def age_band(age: str | Column) -> Column:
    """Right-closed bands; 18 and anything above 100 fall outside (null)."""
    a = _c(age)
    expr = None
    for lo, hi, label in zip(AGE_BIN_EDGES[:-1], AGE_BIN_EDGES[1:], AGE_BAND_LABELS):
        cond = (a > lo) & (a <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def age_band_position(age: str | Column) -> Column:
    a = _c(age)
    expr = None
    for i, (lo, hi) in enumerate(zip(AGE_BIN_EDGES[:-1], AGE_BIN_EDGES[1:])):
        cond = (a > lo) & (a <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def floor_days(later: str | Column, earlier: str | Column) -> Column:
    """Whole days between two timestamps, floored like pandas ``.days``
    (-25 hours gives -2).  Computed on wall-clock (NTZ) values, so a daylight
    saving change in the session time zone cannot turn 24 hours into 23."""
    micros = F.timestamp_diff("MICROSECOND", _c(earlier).cast("timestamp_ntz"), _c(later).cast("timestamp_ntz"))
    return F.floor(micros / F.lit(_MICROS_PER_DAY)).cast("long")


def ntz_lit(value) -> Column:
    """A wall-clock timestamp literal (parsed from text, independent of the
    driver's and the session's time zones)."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def month_start(ts: str | Column) -> Column:
    """First day of the month as a date."""
    return F.trunc(_c(ts).cast("date"), "MM")


def cohort_index(purchase_ts: str | Column, signup_ts: str | Column) -> Column:
    """Days between month starts, floor-divided by 30 (not calendar months)."""
    days = F.datediff(month_start(purchase_ts), month_start(signup_ts))
    return F.floor(days / F.lit(30)).cast("long")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def visual_columns(df, time_col: str = "ts"):
    """The derived columns of the reference's chart step (year_month,
    weekday, month, year, hour, launch_year, age_group) in one projection."""
    cols = [year_month(time_col).alias("year_month"), weekday_name(time_col).alias("weekday"),
            F.month(time_col).alias("month"), F.year(time_col).alias("year"), F.hour(time_col).alias("hour")]
    if "launch_date" in df.columns:
        cols.append(F.year("launch_date").alias("launch_year"))
    if "age" in df.columns:
        cols.append(age_band("age").alias("age_group"))
    return df.select("*", *cols)
