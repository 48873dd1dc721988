"""Operator fixtures from FIXTURES.md: RFM, cohorts, shares, joins, cleaning."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopsight.operators import cohort, profile, revenue, rfm, sampling, timeseries
from shopsight.operators.clean import Cleaner
from shopsight.sources.joined import join_facts

T = dt.datetime


def _tx(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, transaction_id long, ts timestamp_ntz, gross_revenue double")


RFM_ROWS = [
    (1, 1, T(2024, 3, 30, 10), 100.0), (1, 2, T(2024, 3, 31, 12), 50.0),
    (2, 3, T(2024, 1, 5), 20.0),
    (3, 4, T(2024, 2, 10, 8), 300.0), (3, 5, T(2024, 2, 11, 8), 10.0), (3, 6, T(2024, 3, 1, 23), 5.0),
    (4, 7, T(2023, 12, 31, 13), -40.0),
    (5, 8, T(2024, 3, 15), 75.0),
    (6, 9, T(2024, 3, 20, 6), 60.0), (6, 10, T(2024, 3, 21, 6), 61.0),
]


def test_rfm_fixture(spark):
    df = _tx(spark, RFM_ROWS)
    out = {r["customer_id"]: r for r in rfm.rfm_scores(df, today=T(2024, 4, 1, 12)).collect()}
    expect = {1: (1, 2, 150.0, "434", "Loyal Customers"), 2: (87, 1, 20.0, "111", "Lost Customers"),
              3: (30, 3, 315.0, "244", "At Risk"), 4: (91, 1, -40.0, "111", "Lost Customers"),
              5: (17, 1, 75.0, "322", "Others"), 6: (11, 2, 121.0, "443", "Loyal Customers")}
    for cid, (r, f, m, score, seg) in expect.items():
        row = out[cid]
        assert (row["Recency"], row["Frequency"], row["Monetary"], row["RFM_Score"], row["Segment"]) == \
            (r, f, m, score, seg), cid
        assert row["CLV"] == m


def test_rfm_segment_rule_champions(spark):
    df = spark.createDataFrame([("4", "4", "4")], "R_Score string, F_Score string, M_Score string")
    df = df.withColumn("RFM_Score", F.concat("R_Score", "F_Score", "M_Score"))
    assert df.select(rfm.segment_rule()).first()[0] == "Champions"


def test_f_score_matches_rank_first_quartiles(spark):
    # Frequency ties broken by customer id; quartiles of ranks 1..n
    rng = np.random.default_rng(3)
    n = 203
    freq = rng.integers(1, 5, size=n)
    rows = []
    tid = 0
    for cid in range(n):
        for _ in range(int(freq[cid])):
            rows.append((cid, tid, T(2024, 1, 1), 1.0))
            tid += 1
    out = rfm.rfm_scores(_tx(spark, rows), today=T(2024, 1, 2)).select("customer_id", "F_Score").toPandas()
    ranks = pd.Series(freq, index=range(n)).rank(method="first")
    expected = pd.qcut(ranks, 4, labels=["1", "2", "3", "4"]).astype(str)
    got = out.set_index("customer_id")["F_Score"].sort_index()
    assert (got.values == expected.sort_index().values).all()


def test_rfm_empty_input_keeps_schema(spark):
    empty = _tx(spark, [])
    out = rfm.rfm_scores(empty)
    assert out.count() == 0
    assert {"R_Score", "Segment", "CLV"} <= set(out.columns)


COHORT_ROWS = [(1, "2024-01-15", "2024-01-03"), (2, "2024-01-02", "2024-01-20"), (1, "2024-01-15", "2024-02-10"),
               (3, "2023-02-01", "2023-02-05"), (3, "2023-02-01", "2023-03-05"), (4, "2023-02-11", "2023-03-15"),
               (5, "2024-03-01", "2024-02-20"), (5, "2024-03-01", "2024-03-02"), (6, "2024-03-05", "2024-03-30")]


def test_cohort_retention_first_and_zero(spark):
    df = spark.createDataFrame(COHORT_ROWS, "customer_id long, s string, p string").select(
        "customer_id", F.to_timestamp("s").alias("signup_date"), F.to_timestamp("p").alias("ts"))
    counts = cohort.cohort_counts(df)
    got = {(r["signup_month"], r["cohort_index"]): r["customers"] for r in counts.collect()}
    assert got == {("2023-02", 0): 2, ("2024-01", 0): 2, ("2024-01", 1): 1, ("2024-03", -1): 1, ("2024-03", 0): 2}
    first = {(r["signup_month"], r["cohort_index"]): r["retention"] for r in cohort.cohort_retention(counts).collect()}
    assert first[("2024-03", -1)] == 100.0 and first[("2024-03", 0)] == 200.0
    assert first[("2023-02", 0)] is None and first[("2024-01", 1)] is None
    zero = {(r["signup_month"], r["cohort_index"]): r["retention"]
            for r in cohort.cohort_retention(counts, base="zero").collect()}
    assert zero[("2024-01", 1)] == 50.0 and zero[("2024-03", -1)] == 50.0 and zero[("2023-02", 0)] == 100.0


def test_value_shares_exclude_null(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    got = {r["value"]: r["share"] for r in profile.value_counts(df, ["c"]).collect()}
    assert got == {"a": 0.67, "b": 0.33}


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("x", None)], "category string, gross_revenue double")
    assert revenue.revenue_by_category(df).first()["gross_revenue"] == 0.0


def test_null_join_key_kept(spark):
    tx = spark.createDataFrame([(1, 1), (2, None)], "customer_id long, product_id long")
    cu = spark.createDataFrame([(1, "US"), (2, "IN")], "customer_id long, country string")
    pr = spark.createDataFrame([(1, "Books")], "product_id long, category string")
    out = {r["customer_id"]: r["category"] for r in join_facts(tx, cu, pr).collect()}
    assert out == {1: "Books", 2: None}


def test_cleaner_median_fill_and_filter(spark):
    df = spark.createDataFrame(
        [(1, 10.0, "a", T(2024, 1, 2), None), (2, None, None, T(2024, 1, 1), T(2023, 5, 1)),
         (None, 30.0, "b", T(2024, 1, 3), None), (4, -5000.0, "c", T(2024, 1, 4), None)],
        "product_id long, gross_revenue double, category string, ts timestamp_ntz, launch_date timestamp_ntz")
    out = Cleaner().fit(df).transform(df).orderBy("ts").collect()
    assert len(out) == 3  # -5000 dropped after filling
    assert out[0]["gross_revenue"] == 10.0 and out[0]["category"] == "Unknown"  # median of 10, 30, -5000
    assert out[2]["product_id"] == 2.0  # integral column with a gap becomes double (median of 1, 2, 4)
    assert out[1]["launch_date"] == T(2024, 1, 1)  # global min ts


def test_hash_split_stable_under_repartition(spark):
    df = spark.range(2000).select((F.col("id") * 7).alias("a"), (F.col("id") % 13).cast("double").alias("b"))
    s1 = sampling.train_validation_split(df).select("a", "split")
    s2 = sampling.train_validation_split(df.repartition(17)).select("a", "split")
    assert s1.exceptAll(s2).count() == 0
    share = s1.where(F.col("split") == "validation").count() / 2000
    assert 0.15 < share < 0.25


def test_decomposition_is_additive(spark):
    days = [(T(2024, 1, 1) + dt.timedelta(days=i), float(100 + 10 * np.sin(i / 5) + (i % 7))) for i in range(120)
            if i % 11 != 3]
    df = spark.createDataFrame(days, "ts timestamp_ntz, gross_revenue double")
    out = timeseries.daily_decomposition(df, period=30).toPandas()
    assert len(out) == 120  # gaps filled
    inner = out.dropna()
    assert np.allclose(inner["trend"] + inner["seasonal"] + inner["resid"], inner["observed"])
    assert out["trend"].isna().sum() == 30
    assert abs(out.groupby(np.arange(120) % 30)["seasonal"].first().sum()) < 1e-9


def test_frequency_scores_of_ties_with_any_ids(spark):
    """All customers tied; ids as text and beyond 2**53 keep their own order."""
    import datetime as dt

    import pandas as pd
    from shopsight.operators import rfm
    for ids in ([f"c{k:03d}" for k in range(37)], [2**53 + k for k in range(37)]):
        day = dt.datetime(2024, 1, 1)
        rows = [(c, k, day + dt.timedelta(days=k % 5), 10.0 + k) for k, c in enumerate(ids)]
        kind = "string" if isinstance(ids[0], str) else "bigint"
        df = spark.createDataFrame(rows, f"customer_id {kind}, transaction_id bigint, ts timestamp_ntz, gross_revenue double")
        got = {r["customer_id"]: int(r["F_Score"]) for r in rfm.rfm_scores(df).collect()}
        ranks = pd.Series(1, index=ids).rank(method="first")
        want = (pd.qcut(ranks, 4, labels=False) + 1).to_dict()
        assert got == want


def test_value_shares_are_not_capped(spark):
    from shopsight.operators import profile
    df = spark.createDataFrame([(f"v{k % 40}", None) for k in range(100)], "a string, b string")
    got = profile.value_shares(df).collect()
    assert len(got) == 40 and sum(r["count"] for r in got) == 100
    assert [r["count"] for r in got] == sorted((r["count"] for r in got), reverse=True)


def test_summaries_and_correlations_leave_no_column_out(spark):
    from shopsight.plans.catalog import ALL_COLUMNS, NUMERIC_CLEAN, QUERIES
    from tests.conftest import SF_SMALL
    found = [r["column"] for name in ("column_summary", "timestamp_summary") for r in QUERIES[name](spark, SF_SMALL).collect()]
    assert sorted(found) == sorted(ALL_COLUMNS)
    pairs = {(r["row"], r["col"]) for r in QUERIES["numeric_correlations"](spark, SF_SMALL).collect()}
    assert pairs == {(a, b) for a in NUMERIC_CLEAN for b in NUMERIC_CLEAN}


def test_timestamp_summary(spark):
    rows = [(T(2024, 1, 1), None), (T(2024, 1, 2), None), (T(2024, 1, 4), None), (None, None)]
    out = profile.timestamp_summary(spark.createDataFrame(rows, "a timestamp, b timestamp"))
    assert [tuple(r) for r in out.collect()] == [
        ("a", 3, T(2024, 1, 2, 8), T(2024, 1, 1), T(2024, 1, 1, 12), T(2024, 1, 2), T(2024, 1, 3), T(2024, 1, 4)),
        ("b", 0, *[None] * 6)]
