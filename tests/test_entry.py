"""Driver contract on the smallest test folder: entry runs, every registered
query plans and returns a stable schema, every oracle key is a query."""

import __spark_entry__ as entry

from tests.conftest import SF_SMALL

MODEL = {"linear_regression_metrics", "actual_vs_predicted", "gbt_metrics", "gbt_feature_importance", "ann_metrics",
         "training_history", "model_comparison", "classifier_metrics", "classifier_history", "confusion_matrix", "boosting_history"}
BOOSTED = {"gbt_metrics", "gbt_feature_importance", "model_comparison", "boosting_history"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["year_month", "gross_revenue"]


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_model_queries_run_on_smallest_folder(spark):
    """At the registered settings; the boosted trees, of some minutes, are in test_models."""
    qs = entry.queries()
    rows = {name: [r.asDict() for r in qs[name](spark, SF_SMALL).collect()] for name in sorted(MODEL - BOOSTED - {"training_history"})}
    for name in ("linear_regression_metrics", "ann_metrics"):
        assert {r["split"] for r in rows[name]} == {"train", "validation"}
        assert all(0 < r["mae"] <= r["rmse"] for r in rows[name])
    assert len(rows["classifier_history"]) == 101
    assert len(rows["actual_vs_predicted"]) == 1000
    assert sum(r["count"] for r in rows["confusion_matrix"]) == rows["classifier_metrics"][0]["test_rows"]


def test_analytic_queries_run_on_smallest_folder(spark):
    for name, fn in entry.queries().items():
        if name in MODEL:
            continue
        df = fn(spark, SF_SMALL)
        assert df.columns, name
        df.limit(5).collect()
