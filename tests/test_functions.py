"""Micro-fixtures for the pandas semantics traps (T1, T6, T7, T9, T12, T18) and
the distributed exact quantiles."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopsight.functions.calendar import age_band, cohort_index, floor_days
from shopsight.functions.numeric import sample_kurtosis, sample_skewness
from shopsight.functions.quantiles import exact_quantiles, quantile_table
from shopsight.functions.ranking import rows_before


def test_age_bands_right_closed(spark):
    ages = [17, 18, 19, 25, 26, 35, 65, 66, 100, 101]
    expected = [None, None, "18-24", "18-24", "25-34", "25-34", "55-64", "65+", "65+", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, age int")
    got = [r[0] for r in df.orderBy("i").select(age_band("age")).collect()]
    assert got == expected


def test_floor_days_negative(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(floor_days("a", "b")).first()[0] == -2


def test_skew_kurtosis_bias_adjusted(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 50.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    row = df.agg(sample_skewness("x").alias("s"), sample_kurtosis("x").alias("k"), F.stddev_samp("x").alias("d")).first()
    assert row["s"] == pytest.approx(2.3022814009142434, rel=1e-12)
    assert row["k"] == pytest.approx(5.373937561023132, rel=1e-12)
    assert row["d"] == pytest.approx(19.221515722405105, rel=1e-12)
    s = pd.Series(vals)
    assert row["s"] == pytest.approx(s.skew(), rel=1e-12)
    assert row["k"] == pytest.approx(s.kurtosis(), rel=1e-12)


def test_cohort_index_days_over_30(spark):
    pairs = [("2024-01-01", "2024-02-01", 1), ("2024-01-01", "2024-03-01", 2), ("2023-02-01", "2023-03-01", 0),
             ("2023-01-01", "2023-03-01", 1), ("2024-03-01", "2024-02-01", -1), ("2023-01-01", "2024-01-01", 12)]
    df = spark.createDataFrame([(s, p, e) for s, p, e in pairs], "s string, p string, e int")
    got = df.select(cohort_index(F.to_timestamp("p"), F.to_timestamp("s")).alias("c"), "e").collect()
    assert all(r["c"] == r["e"] for r in got)


@pytest.mark.parametrize("max_exact", [100_000, 40])
def test_exact_quantiles_match_numpy(spark, max_exact):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(2000, 1.5), rng.integers(0, 9, 500).astype(float)])
    keys = rng.integers(0, 3, size=len(vals))
    df = spark.createDataFrame(pd.DataFrame({"k": keys.astype("int32"), "v": vals}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, "v", probs, keys=["k"], max_exact=max_exact).collect()
    assert len(got) == 3 * len(probs)
    for r in got:
        assert r["value"] == pytest.approx(np.quantile(vals[keys == r["k"]], r["q"]), abs=1e-12)


def test_exact_quantiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,), (2.0,)], "v double")
    got = exact_quantiles(df, "v", [0.5]).first()
    assert got["value"] == 2.0


@pytest.mark.parametrize("max_exact", [100_000, 3])
def test_exact_quantiles_of_one_hot_value_and_empty_keys(spark, max_exact):
    rows = [("a", 2.0)] * 5000 + [("a", float(k)) for k in range(100, 110)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    hot = [2.0] * 5000 + [float(k) for k in range(100, 110)]
    got = {(r["k"], r["q"]): r["value"] for r in exact_quantiles(df, "v", [0.5, 0.999], keys=["k"], max_exact=max_exact).collect()}
    assert got == {("a", 0.5): 2.0, ("a", 0.999): pytest.approx(np.quantile(hot, 0.999))}
    assert exact_quantiles(df.where("false"), "v", [0.5], keys=["k"]).count() == 0


def test_quantiles_that_a_sketch_misses(spark):
    """With a coarse sketch, whole keys are ranked and the result stays exact."""
    vals = np.random.default_rng(3).normal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"v": vals})).repartition(8)
    probs = [0.01, 0.37, 0.5, 0.93]
    got = {r["q"]: r["value"] for r in exact_quantiles(df, "v", probs, accuracy=400, max_exact=10).collect()}
    assert got == {q: pytest.approx(np.quantile(vals, q), abs=1e-12) for q in probs}


def test_quantiles_of_several_columns_read_the_rows_twice(spark):
    """Two passes for all columns and targets, whatever the sketch leaves; gaps, ties,
    infinities and a column without values included."""
    rng = np.random.default_rng(11)
    n = 6000
    pdf = pd.DataFrame({"k": rng.integers(0, 2, n).astype("int32"), "a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "c": rng.normal(size=n)})
    pdf.loc[::7, "a"], pdf.loc[3, "c"], pdf.loc[4, "c"] = np.nan, np.inf, -np.inf
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.createDataFrame(pdf).repartition(4).withColumn("d", F.lit(None).cast("double")).mapInPandas(count, "k int, a double, b double, c double, d double")
    probs = [0.75, 0.25, 0.5]
    got = {(r["k"], r["column"], r["q"]): r["value"] for r in quantile_table(df, ["a", "b", "c", "d"], probs, ["k"], accuracy=1000).collect()}
    assert read.value == 2 * n
    assert got == {(k, c, q): pytest.approx(np.nanquantile(pdf.loc[pdf.k == k, c], q), abs=1e-12) for k in (0, 1) for c in "abc" for q in probs}


def test_rows_before_counts_every_row_once(spark):
    rows = [(k % 7, k, 1 + k % 3) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, _at int, n int").repartition(6)
    want = {(a, b): i for i, (a, b, _) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    got = rows_before(df, [F.col("a").desc(), F.col("_at")], parts=5)
    assert got.columns == ["a", "_at", "n", "before"]
    assert {(r["a"], r["_at"]): r["before"] for r in got.collect()} == want
    total, ahead = 0, {}
    for a, b, n in sorted(rows, key=lambda r: (-r[0], r[1])):
        ahead[(a, b)] = total
        total += n
    got = rows_before(df, [F.col("a").desc(), F.col("_at")], count_col="n", parts=5)
    assert {(r["a"], r["_at"]): r["before"] for r in got.collect()} == ahead


def test_visual_columns(spark):
    from shopsight.functions.calendar import visual_columns
    df = spark.createDataFrame([(dt.datetime(2024, 3, 4, 13, 5), dt.datetime(2020, 1, 1), 30)],
                               "ts timestamp_ntz, launch_date timestamp_ntz, age int")
    r = visual_columns(df).first()
    assert (r["year_month"], r["weekday"], r["month"], r["year"], r["hour"], r["launch_year"], r["age_group"]) == \
        ("2024-03", "Monday", 3, 2024, 13, 2020, "25-34")


def test_read_retail_csv(spark, tmp_path):
    from shopsight.sources import read_retail_files
    (tmp_path / "transactions.csv").write_text(
        "transaction_id,timestamp,customer_id,product_id,quantity,discount_applied,gross_revenue\n"
        "1,2024-01-02 10:00:00,7,3,2,0.1,19.5\n2,2024-01-03 11:00:00,7,,1,0,\n")
    (tmp_path / "customers.csv").write_text(
        "customer_id,signup_date,country,age,gender,loyalty_tier,acquisition_channel\n7,2023-05-01,US,31,F,Gold,Ads\n")
    (tmp_path / "products.csv").write_text(
        "product_id,category,brand,base_price,launch_date,is_premium\n3,Books,Acme,9.5,not-a-date,0\n")
    t = read_retail_files(spark, str(tmp_path), fmt="csv")
    rows = t["transactions"].orderBy("transaction_id").collect()
    assert rows[0]["ts"] == dt.datetime(2024, 1, 2, 10) and rows[1]["product_id"] is None
    assert t["products"].first()["launch_date"] is None  # bad text -> null (S3)
    assert t["customers"].first()["signup_date"] == dt.datetime(2023, 5, 1)


def test_floor_days_ignores_daylight_saving(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 00:00:00", "2024-03-11 00:00:00")], "a string, b string").select(
            F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
        assert df.select(floor_days("b", "a")).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_csv_columns_by_name(spark, tmp_path):
    from shopsight.sources.files import PRODUCTS_SCHEMA, read_table
    (tmp_path / "p.csv").write_text("brand,extra,product_id,category,is_premium\nacme,x,3,toys,1.0\n")
    t = read_table(spark, str(tmp_path / "p.csv"), "csv", PRODUCTS_SCHEMA)
    assert t.columns == ["brand", "extra", "product_id", "category", "is_premium"]
    assert tuple(t.first()) == ("acme", "x", 3, "toys", 1)
    (tmp_path / "bad.csv").write_text("product_id,category\nthree,toys\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_table(spark, str(tmp_path / "bad.csv"), "csv", PRODUCTS_SCHEMA).collect()


def test_shared_folder_is_asked_for_on_a_cluster():
    from shopsight.session import is_local
    assert is_local("local[8]") and is_local("local")
    assert not is_local("local-cluster[3,2,1024]") and not is_local("spark://host:7077") and not is_local("yarn")
