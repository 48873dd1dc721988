"""Reused tables, inferred types, dictionaries, next purchases, sketches, dropped
columns and gaps that the fit has not seen."""

import datetime as dt
import math
import os
import shutil

import pytest
from pyspark.sql import functions as F

from shopsight.operators import cohort, features, profile
from shopsight.operators.clean import Cleaner
from shopsight.plans import workspace
from shopsight.sources.files import read_inferred, read_retail_files
from tests.conftest import SF_SMALL


def T(*a):
    return dt.datetime(*a)


def test_rewritten_folder_gives_new_results_and_old_tables_are_released(spark, tmp_path):
    folder = str(tmp_path / "data")
    shutil.copytree(SF_SMALL, folder)
    ws = workspace.Workspace(spark, folder)
    before, total = ws.clean().count(), ws.clean().agg(F.sum("quantity")).first()[0]
    held = ws.clean()
    assert held.storageLevel.useMemory and workspace.Workspace(spark, folder + "/") is ws
    more = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    shutil.rmtree(f"{folder}/lineitem.parquet", ignore_errors=True)
    more.withColumn("l_quantity", F.col("l_quantity") + 100).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    again = workspace.Workspace(spark, folder)
    assert again is not ws and not held.storageLevel.useMemory
    assert again.clean().agg(F.sum("quantity")).first()[0] == pytest.approx(total + 100 * before)


def test_large_folders_are_not_persisted(spark, tmp_path):
    folder = str(tmp_path / "data")
    shutil.copytree(SF_SMALL, folder)
    ws = workspace.Workspace(spark, folder, persist_max_bytes=10)
    assert ws.clean().count() > 0 and not ws.clean().storageLevel.useMemory


def test_large_folders_join_the_input_once(spark, tmp_path):
    """Fits, reports and learners read written tables; the written ones go with the workspace."""
    folder = str(tmp_path / "data")
    shutil.copytree(SF_SMALL, folder)
    ws = workspace.Workspace(spark, folder, persist_max_bytes=10)
    for table in (ws.raw(), ws.clean(), ws.model_table()):
        assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()
    small = workspace.Workspace(spark, SF_SMALL)
    assert sorted(ws.model_table().collect()) == sorted(small.model_table().collect())
    assert sorted(map(str, ws.clean().collect())) == sorted(map(str, small.clean().collect()))
    files = ws.raw().inputFiles()
    ws.release()
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_orders_are_joined_by_one_plan_at_every_size(spark):
    """No broadcast of a fact table, however few bytes its files have."""
    plan = workspace.load_tables(spark, SF_SMALL)["transactions"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_inferred_types_and_rejected_lines(spark, tmp_path):
    path = tmp_path / "campaigns.csv"
    path.write_text("id,name,budget,start,active\n1,spring,10.5,2024-03-01,true\n2,,20,2024-04-01,false\n3,odd\n4,x,1,2024-05-01,true,more\n")
    table, rejects = read_inferred(spark, str(path))
    assert dict(table.dtypes) == {"id": "int", "name": "string", "budget": "double", "start": "date", "active": "boolean"}
    assert [tuple(r) for r in table.orderBy("id").collect()] == [(1, "spring", 10.5, dt.date(2024, 3, 1), True), (2, None, 20.0, dt.date(2024, 4, 1), False)]
    assert {r["record"] for r in rejects.collect()} == {"3,odd", "4,x,1,2024-05-01,true,more"}
    assert table.select("id").count() == 2 and rejects.count() == 2
    assert table.agg(F.sum("budget")).first()[0] == 30.5


def test_retail_files_have_typed_campaigns_and_bad_dates_raise(spark, tmp_path):
    files = {"transactions": "transaction_id,timestamp,customer_id\n1,2024-01-01 10:00:00,5\n", "customers": "customer_id,signup_date\n5,2023-01-01\n",
             "products": "product_id,launch_date\n1,nonsense\n", "campaigns": "id,budget\n1,2.5\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    t = read_retail_files(spark, str(tmp_path))
    assert dict(t["campaigns"].dtypes) == {"id": "int", "budget": "double"} and t["campaigns_rejects"].count() == 0
    assert "events" not in t and t["products"].first()["launch_date"] is None  # S3 is lenient
    (tmp_path / "customers.csv").write_text("customer_id,signup_date\n5,nonsense\n")
    with pytest.raises(Exception, match="nonsense"):
        read_retail_files(spark, str(tmp_path))["customers"].collect()


def test_gaps_that_the_fit_has_not_seen_are_filled(spark):
    train = spark.createDataFrame([(1, 2.0, 7), (2, 4.0, 8), (3, 9.0, 12)], "id int, price double, n int")
    model = Cleaner(exclude=("id",)).fit(train)
    later = spark.createDataFrame([(1, None, None), (2, float("inf"), 5), (3, float("nan"), 6)], "id int, price double, n int")
    out = model.transform(later)
    assert out.schema["n"].dataType.simpleString() == "int"
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 4.0, 8), (2, 4.0, 5), (3, 4.0, 6)]


def test_infinite_values_are_counted_and_cleaned(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,), (3.0,)], "v double")
    assert {r["column"]: r["infinite"] if "infinite" in r else r[1] for r in profile.infinity_counts(df).collect()} == {"v": 2}
    assert sorted(r["v"] for r in Cleaner().fit(df).transform(df).collect()) == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0]


def test_value_codes_are_dense_ranks_of_any_number_of_values(spark):
    rows = [(f"v{k % 700:04d}", None if k % 5 == 0 else "one", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, k int").repartition(9)
    codes = {(r["column"], r["value"]): r["code"] for r in features.value_codes(df, ["a", "b"]).collect()}
    assert codes == {**{("a", f"v{k:04d}"): k for k in range(700)}, ("b", "one"): 0}
    out = features.label_encode(df, ["a", "b", "missing"])
    assert out.columns == ["a", "b", "k"] and out.count() == 3000
    assert {(r["k"], r["a"], r["b"]) for r in out.collect()} == {(k, k % 700, None if k % 5 == 0 else 0) for k in range(3000)}
    assert features.label_encode(df.where("false"), ["a"]).count() == 0


def test_one_hot_vectors(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "country string")
    got = {r["country"]: r["country_onehot"].toArray().tolist() for r in features.one_hot_features(df).collect()}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1], None: [0, 0, 0]}


def test_repurchases_of_heavy_customers_and_ties(spark):
    rows = [(k, 1, T(2024, 1, 1) + dt.timedelta(days=k)) for k in range(400)]
    rows += [(1000, 2, T(2024, 1, 1)), (1001, 2, T(2024, 1, 1)), (1002, 2, T(2024, 12, 30)), (1003, None, T(2024, 1, 1)), (1004, 3, None), (1005, 4, T(2024, 2, 1))]
    df = spark.createDataFrame(rows, "transaction_id int, customer_id int, ts timestamp_ntz").repartition(6)
    got = {r["transaction_id"]: (r["next_ts"], r["repurchased"]) for r in features.repurchases(df).collect()}
    assert {k: got[k] for k in range(399)} == {k: (rows[k + 1][2], 1) for k in range(399)}
    assert got[399] == (None, None)  # the reference day is the day after
    assert got[1000] == (T(2024, 1, 1), 1) and got[1001] == (T(2024, 12, 30), 0) and got[1002] == (None, None)
    assert got[1005] == (None, 0) and 1003 not in got and 1004 not in got
    assert features.repurchases(df.where("false")).count() == 0


def test_sketches_merge_within_their_error(spark):
    months = [T(2024, 1, 5), T(2024, 2, 5), T(2024, 3, 5)]
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("customer_id"), F.element_at(F.array(*[F.lit(m) for m in months]), (F.col("id") % 3 + 1).cast("int")).alias("ts"),
                                    F.lit(T(2024, 1, 1)).alias("signup_date"))
    sketches = cohort.cohort_sketches(df, precision=12)
    bound = 4 * 1.04 / math.sqrt(2**12)
    exact = {(r["signup_month"], r["cohort_index"]): r["customers"] for r in cohort.cohort_counts(df).collect()}
    got = {(r["signup_month"], r["cohort_index"]): r["customers"] for r in cohort.sketched_customers(sketches, "signup_month", "cohort_index").collect()}
    assert set(got) == set(exact) and len(exact) == 3
    assert all(abs(got[k] - n) <= bound * n for k, n in exact.items())
    assert abs(cohort.sketched_customers(sketches, "signup_month").first()["customers"] - 20_000) <= bound * 20_000
    assert cohort.sketched_customers(sketches).first()["customers"] == pytest.approx(20_000, rel=bound)


def test_correlated_columns_are_dropped_for_a_kept_one(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("a"), (F.col("id") * -2.0).alias("b"), F.hash("id").cast("double").alias("c"),
                                 (F.col("id") + F.hash("id") % 100).cast("double").alias("d"), F.lit(1.0).alias("e"))
    got = {r["column"]: (r["kept"], r["dropped_for"]) for r in profile.drop_correlated(df, 0.7).collect()}
    assert got == {"a": (True, None), "b": (False, "a"), "c": (True, None), "d": (False, "a"), "e": (True, None)}


def test_guards_of_the_model_table(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0)], "a double, b double")
    with pytest.raises(ValueError, match="non-finite"):
        features.validate_features(df, ["a", "b"])
    with pytest.raises(ValueError, match="no rows"):
        features.validate_features(df.where("false"), ["a"])
    with pytest.warns(UserWarning, match="low sample"):
        assert features.validate_features(df, ["b"]) == 2
