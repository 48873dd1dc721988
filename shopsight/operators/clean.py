"""F1-F8: the cleaning pipeline as a fitted transformer.

``Cleaner.fit`` runs one aggregate (null counts, global minimum timestamp) and
the distributed exact medians of the numeric columns; the result is a handful of
numbers.  ``CleanModel.transform`` is then a pure projection +
filter, so it is lazy, pipelined into whatever query follows, and works on
streaming DataFrames too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.functions.calendar import ntz_lit
from shopsight.functions.numeric import INTEGRAL_TYPES, finite_or_null, is_fractional, numeric_columns, string_columns
from shopsight.functions.quantiles import exact_median_row

UNKNOWN = "Unknown"
REVENUE_FLOOR = -1000.0


def replace_infinite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """F1 on the given (default: all numeric) columns."""
    cols = set(columns if columns is not None else numeric_columns(df))
    return df.select(*[
        finite_or_null(F.col(c), is_fractional(df, c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``subset`` (default all columns)."""
    return df.na.drop("any", subset=subset)


@dataclass
class CleanModel:
    medians: dict[str, float]            # numeric columns -> median fill
    to_double: list[str]                 # integral columns that had gaps (pandas makes them float)
    strings: list[str]                   # string columns -> 'Unknown'
    launch_fill: object | None           # min(ts) for launch_date gaps
    time_col: str = "ts"
    exclude: tuple[str, ...] = field(default_factory=tuple)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema.fields:
            c = F.col(f.name)
            if f.name in self.exclude:
                out.append(c)
                continue
            if f.name in self.medians:
                src = finite_or_null(c, is_fractional(df, f.name))
                if f.name in self.to_double:
                    src = src.cast("double")
                fill = F.lit(self.medians[f.name])
                if f.name not in self.to_double and isinstance(f.dataType, INTEGRAL_TYPES):
                    fill = F.round(fill).cast(f.dataType)  # the column had no gap at fit and stays integral
                out.append(F.coalesce(src, fill).alias(f.name))
            elif f.name in self.strings:
                out.append(F.coalesce(c, F.lit(UNKNOWN)).alias(f.name))
            elif f.name == "launch_date" and self.launch_fill is not None:
                out.append(F.coalesce(c, ntz_lit(self.launch_fill).cast(f.dataType)).alias(f.name))
            elif is_fractional(df, f.name):
                out.append(finite_or_null(c).alias(f.name))
            else:
                out.append(c)
        res = df.select(*out)
        if "gross_revenue" in res.columns:
            res = res.where(F.col("gross_revenue") > F.lit(REVENUE_FLOOR))  # F5
        return res


class Cleaner:
    """F1 -> F2 -> F3 -> F4 -> F5.  Statistics come from the table before the
    revenue filter, as in the reference.  ``exclude`` keeps id columns out of
    the median fill (the faithful default fills every numeric column)."""

    def __init__(self, time_col: str = "ts", exclude: tuple[str, ...] = ()):
        self.time_col = time_col
        self.exclude = tuple(exclude)

    def fit(self, df: DataFrame) -> CleanModel:
        nums = [c for c in numeric_columns(df) if c not in self.exclude]
        strs = [c for c in string_columns(df) if c not in self.exclude]
        aggs = [F.count_if(finite_or_null(F.col(c), is_fractional(df, c)).isNull()).alias(c) for c in nums]
        if "launch_date" in df.columns and self.time_col in df.columns:
            aggs.append(F.min(self.time_col).alias("__min_ts"))
        row = df.agg(*aggs).first().asDict() if aggs else {}
        gaps = [c for c in nums if row.get(c, 0) > 0]
        # every column's median is kept: rows seen later may have gaps where these had none
        medians = exact_median_row(replace_infinite(df.select(*nums), nums), nums)
        medians = {k: v for k, v in medians.items() if v is not None}
        to_double = [c for c in gaps if isinstance(df.schema[c].dataType, INTEGRAL_TYPES)]
        return CleanModel(medians, to_double, strs, row.get("__min_ts"), self.time_col, self.exclude)


def clean(df: DataFrame, time_col: str = "ts", exclude: tuple[str, ...] = ()) -> DataFrame:
    """F6 in one call."""
    return Cleaner(time_col, exclude).fit(df).transform(df)
