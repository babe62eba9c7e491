"""Every operator also runs for the whole table at once (by=[]), and additive results agree
with the per-company results."""

import pytest

from sheaf.ml import anomalies
from sheaf.operators import anomaly, clean, insights, quality, rollups, rules, statements, trends
from sheaf.sources.fixture import ledger, ledger_dirty

OPS = [statements.financial_summary, statements.profit_and_loss, statements.balance_check,
       statements.tax_provision_check, statements.cash_flow, statements.financial_ratios, statements.exec_kpis,
       statements.recommendations, clean.clean_ledger, quality.null_profile, quality.quality_report,
       quality.quality_issues, quality.preview_metrics, quality.gst_consistency, quality.preview,
       rules.rule_violations, rollups.category_totals, rollups.top_expense_heads, rollups.flow_edges,
       rollups.network_nodes, rollups.spend_hierarchy, trends.yoy_comparison, trends.fiscal_year_totals,
       anomaly.statistical_anomalies, anomaly.iqr_outliers, anomaly.top_outliers, insights.compliance_insights,
       insights.health_alerts]


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_global_run(spark, sf_small, op):
    rows = op(ledger_dirty(spark, sf_small), by=[]).collect()
    assert len(rows) > 0


def test_global_totals_equal_sum_of_companies(spark, sf_small):
    led = ledger(spark, sf_small)
    g = statements.financial_summary(led, by=[]).first()
    per = statements.financial_summary(led).collect()
    for f in ("total_income", "total_expense", "gst_on_income", "total_assets", "total_liabilities"):
        assert abs(g[f] - sum(r[f] for r in per)) < 1e-3, f
    v_all = {r["rule_name"]: r["count"] for r in rules.rule_violations(led, by=[]).collect()}
    v_per = {}
    for r in rules.rule_violations(led).collect():
        v_per[r["rule_name"]] = v_per.get(r["rule_name"], 0) + r["count"]
    assert v_all == v_per


def test_global_score_and_anomaly_summary(spark, sf_small):
    led = ledger(spark, sf_small)
    s = insights.compliance_score(insights.compliance_insights(led, by=[]), by=[]).first()
    assert 0 <= s["compliance_score"] <= 100 and s["grade"] in "ABCDF"
    from pyspark.sql import functions as F
    flagged = led.withColumn("Is_Anomaly_Predicted", F.col("Amount") > 1_000_000)
    a = anomalies.anomaly_summary(flagged, by=[]).first()
    assert max(a["statistical_count"], a["ml_count"]) <= a["total_unique"] <= a["statistical_count"] + a["ml_count"]


def test_end_to_end_analysis(spark, sf_small):
    from sheaf.plans.analysis import analyze_ledger
    res = analyze_ledger(spark, ledger_dirty(spark, sf_small))
    assert res["financial_summary"].count() == res["clean_ledger"].select("Company_ID").distinct().count()
    for name, df in res.items():
        assert df.limit(1).count() >= 0, name
    s = res["compliance_score"].collect()
    assert all(0 <= r["compliance_score"] <= 100 for r in s)
