"""Plan properties behind the scale claims: no cartesian products or nested-loop joins, pruned scans,
pushed-down null filters, partial top-k limits before shuffles."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

ML_OR_IO = {"read_ledgers", "stream_clean_ledger", "stream_rule_hits", "feature_matrix", "classifier_evaluation",
            "confusion_matrix", "predict_categories", "prediction_counts", "fallback_rate", "isolation_forest",
            "isolation_forest_amount_only", "anomaly_summary", "predicted_anomaly_rows", "low_confidence_rows"}
KEYS = sorted(k for k in entry.queries() if k not in ML_OR_IO)


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_or_nested_loop_join(spark, sf_small, key):
    p = plan(entry.queries()[key](spark, sf_small))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key


def test_summary_scan_is_pruned_and_filtered(spark, sf_small):
    p = plan(entry.queries()["financial_summary"](spark, sf_small))
    schema = [ln for ln in p.splitlines() if ln.startswith("ReadSchema")][0]
    assert "Description" not in schema and "Vendor_Client_Name" not in schema and "Date" not in schema
    assert "PushedFilters: [IsNotNull(Company_ID)]" in p
    assert p.count("HashAggregate") >= 4  # partial + final, twice (compact, then wide)


@pytest.mark.parametrize("key", ["top_outliers", "preview", "top_expense_heads"])
def test_top_k_is_a_partial_window_limit(spark, sf_small, key):
    p = plan(entry.queries()[key](spark, sf_small))
    assert "WindowGroupLimit" in p, key
