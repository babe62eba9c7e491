"""Every catalogued query against its DuckDB oracle SQL on the smallest scale."""

import pytest

import __spark_entry__ as entry
from sheaf.plans import catalog
from tests.oracle_harness import compare

KEYS = sorted(catalog.queries())
#: Results of trained models: their steps are compared on given predictions, their properties in ``model_properties``.
TRAINED = {"classifier_evaluation", "confusion_matrix", "predict_categories", "prediction_counts", "fallback_rate",
           "low_confidence_rows", "isolation_forest", "isolation_forest_amount_only", "anomaly_summary", "predicted_anomaly_rows"}


def test_every_sql_query_has_an_oracle():
    sql = entry.oracle_sql()
    assert set(sql) <= set(entry.queries())
    assert set(KEYS) - set(sql) == TRAINED


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_small, key):
    res = compare(spark, sf_small, [key], verbose=False)[key]
    if key in TRAINED:
        assert res.startswith("rows-only") and "(0 rows)" not in res, res
    else:
        assert res.startswith("ok"), res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "health" in df.columns
