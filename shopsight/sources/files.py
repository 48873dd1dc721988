"""Reading the five retail tables from CSV or Parquet with explicit schemas.

The retail files carry a ``timestamp`` column; the library's canonical name for
it is ``ts`` (``timestamp`` is a type keyword in most SQL dialects)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("discount_applied", T.DoubleType()),
    T.StructField("gross_revenue", T.DoubleType()),
    T.StructField("campaign_id", T.LongType()),
    T.StructField("refund_flag", T.IntegerType()),
])

CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("signup_date", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("gender", T.StringType()),
    T.StructField("loyalty_tier", T.StringType()),
    T.StructField("acquisition_channel", T.StringType()),
])

PRODUCTS_SCHEMA = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("base_price", T.DoubleType()),
    T.StructField("launch_date", T.StringType()),
    T.StructField("is_premium", T.IntegerType()),
])


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """One table.  CSV columns are found by the names in the header, whatever
    their order, and cast to the type that ``schema`` gives them (no inference
    pass over the data).  Text that does not fit its type raises; a column that
    the file lacks is absent; a column that the schema lacks stays text.
    Parquet carries its own schema."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = spark.read.option("header", True).csv(path)
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    return raw.select(*[_typed(c, types[c]) if c in types else F.col(f"`{c}`") for c in raw.columns])


def read_inferred(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A CSV file of unknown columns: the table with inferred types, and ``rejects``
    (``record``: the text of each line that does not fit the header).  One pass infers
    the types; reading keeps every column of a line, so that the same lines are
    rejected whatever a report selects."""
    reader = spark.read.option("header", True).option("columnPruning", False)
    kinds = reader.option("inferSchema", True).csv(path).schema
    bad = "_rejected"
    while bad in kinds.fieldNames():
        bad += "_"
    raw = reader.option("inferSchema", False).schema(T.StructType([*kinds.fields, T.StructField(bad, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path)
    # Spark refuses to read the rejected text alone; a hash of all columns keeps them in the scan
    raw = raw.where(F.hash(*[F.col(f"`{c}`") for c in raw.columns]) >= -(1 << 31))
    fits = F.col(f"`{bad}`").isNull()
    return raw.where(fits).drop(bad), raw.where(~fits).select(F.col(f"`{bad}`").alias("record"))


def _typed(name: str, kind: T.DataType):
    """A text column as ``kind``.  Whole numbers may be written as 7.0, as
    pandas does for a column with gaps."""
    c = F.col(name)
    if isinstance(kind, T.IntegralType):
        c = F.regexp_replace(c, r"\.0+$", "")
    return c.cast(kind).alias(name)


def _strict_ts(c):
    """Parse, failing on bad text (ANSI ``to_timestamp`` raises)."""
    return F.to_timestamp_ntz(c)


def _lenient_ts(c):
    """S3: parse, bad text becomes null."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def read_retail_files(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """Read ``transactions``, ``customers``, ``products``, ``campaigns`` and
    ``events`` from ``folder`` and apply the date parsing rules.  The types of the last
    two are inferred, and ``campaigns_rejects`` / ``events_rejects`` hold their lines that do not fit.  Optional
    columns missing from a file are simply absent (presence is tested by the
    operators, as the reference does)."""
    ext = "csv" if fmt == "csv" else "parquet"
    tx = read_table(spark, f"{folder}/transactions.{ext}", fmt, TRANSACTIONS_SCHEMA if fmt == "csv" else None)
    cu = read_table(spark, f"{folder}/customers.{ext}", fmt, CUSTOMERS_SCHEMA if fmt == "csv" else None)
    pr = read_table(spark, f"{folder}/products.{ext}", fmt, PRODUCTS_SCHEMA if fmt == "csv" else None)
    if "timestamp" in tx.columns:
        tx = tx.withColumn("ts", _strict_ts(F.col("timestamp").cast("string"))).drop("timestamp")
    if "refund_flag" in tx.columns and "is_refunded" not in tx.columns:
        tx = tx.withColumnRenamed("refund_flag", "is_refunded")
    if "signup_date" in cu.columns:
        cu = cu.withColumn("signup_date", _strict_ts(F.col("signup_date").cast("string")))
    if "launch_date" in pr.columns:
        pr = pr.withColumn("launch_date", _lenient_ts(F.col("launch_date").cast("string")))
    out = {"transactions": tx, "customers": cu, "products": pr}
    for name in ("campaigns", "events"):
        try:
            if fmt == "csv":
                out[name], out[f"{name}_rejects"] = read_inferred(spark, f"{folder}/{name}.csv")
            else:
                out[name] = read_table(spark, f"{folder}/{name}.{ext}", fmt)
        except AnalysisException as e:  # these two files are optional
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out
