"""Stand-in retail tables derived from the TPC-H-like test tables.

The derivation is plain column arithmetic, so its cost grows with the test
tables and Catalyst prunes every column a query does not use.  The same
expressions exist as SQL in ``shopsight.plans.oracle`` for the DuckDB check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    li = _read(spark, sf_dir, "lineitem")
    od = _read(spark, sf_dir, "orders")
    cu = _read(spark, sf_dir, "customer")
    na = _read(spark, sf_dir, "nation")
    pa = _read(spark, sf_dir, "part")

    c = F.col
    # Two fact tables that grow together: joined by shuffle at every size.  A broadcast would
    # follow the bytes of compressed files, with many times as many in the driver's memory.
    transactions = li.join(od.hint("merge"), c("l_orderkey") == c("o_orderkey")).select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("transaction_id"),
        c("o_custkey").alias("customer_id"),
        F.when((c("l_orderkey") + c("l_linenumber")) % 40 == 0, F.lit(None).cast("bigint"))
        .otherwise(c("l_partkey")).alias("product_id"),
        c("o_orderdate").cast("timestamp_ntz").alias("ts"),
        c("l_quantity").alias("quantity"),
        c("l_discount").alias("discount_applied"),
        F.when((c("l_partkey") + c("l_suppkey")) % 50 == 0, F.lit(None).cast("double"))
        .when((c("l_returnflag") == "R") & (c("l_linenumber") == 7), -c("l_extendedprice") / 100)
        .otherwise(c("l_extendedprice") * (1 - c("l_discount"))).alias("gross_revenue"),
        F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("is_refunded"),
        (c("l_suppkey") % 10).alias("campaign_id"),
    )

    customers = cu.join(na, c("c_nationkey") == c("n_nationkey")).select(
        c("c_custkey").alias("customer_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), (c("c_custkey") * 13 % 1800).cast("int"))
        .cast("timestamp_ntz").alias("signup_date"),
        c("n_name").alias("country"),
        F.when(c("c_custkey") % 37 == 0, F.lit(None).cast("bigint"))
        .otherwise(15 + (c("c_custkey") * 7) % 90).alias("age"),
        F.when(c("c_custkey") % 3 == 0, "Female").when(c("c_custkey") % 3 == 1, "Male")
        .otherwise("Other").alias("gender"),
        F.when(c("c_acctbal") < 4000, "Bronze").when(c("c_acctbal") < 7000, "Silver")
        .when(c("c_acctbal") < 9000, "Gold").otherwise("Platinum").alias("loyalty_tier"),
        c("c_mktsegment").alias("acquisition_channel"),
    )

    products = pa.select(
        c("p_partkey").alias("product_id"),
        c("p_type").alias("category"),
        c("p_brand").alias("brand"),
        c("p_retailprice").alias("base_price"),
        F.when(c("p_partkey") % 23 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.date_add(F.lit("1994-06-01").cast("date"), c("p_size") * 20).cast("timestamp_ntz"))
        .alias("launch_date"),
        F.when(c("p_retailprice") >= 980, 1).otherwise(0).alias("is_premium"),
    )
    return {"transactions": transactions, "customers": customers, "products": products}


#: The tables that the stand-ins are built from.
TABLES = ("lineitem", "orders", "customer", "nation", "part")


def load_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables for a test folder: the stand-ins built from the TPC-H-like tables."""
    return standin_tables(spark, sf_dir)
