"""End-to-end ledger analysis: the interactive flow of the reference, for every company at once.

read -> clean -> (optional) predict categories -> write the cleaned ledger once to the shared
checkpoint folder -> every statement, check, insight, roll-up and anomaly table from that one table.
The result is a dict of lazy DataFrames; nothing but small scalars reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, Thresholds
from ..operators import anomaly, clean, insights, quality, rollups, rules, statements, trends
from ..session import scratch_path
from ..sources import io


def analyze_ledger(spark: SparkSession, source: str | DataFrame, by: list[str] | None = None,
                   t: Thresholds = DEFAULT, model=None) -> dict[str, DataFrame]:
    """Run the full analysis. ``source`` is a ledger DataFrame or a folder/file of ledger CSVs.

    ``model``: an optional fitted ``CategoryModel``; when given, ``Predicted_Category`` is added and the
    statements use it (``cat_col``), as the reference does after prediction.
    """
    raw = io.read_ledgers(spark, source) if isinstance(source, str) else source
    out: dict[str, DataFrame] = {
        "quality_report": quality.quality_report(raw, by, t=t),
        "quality_issues": quality.quality_issues(raw, by, t=t),
        "null_profile": quality.null_profile(raw, by),
    }
    cleaned = clean.clean_ledger(raw, by, t)
    cat_col = "Category"
    if model is not None:
        from ..ml.classify import predict_categories
        cleaned = predict_categories(model, cleaned, t)
        cat_col = "Predicted_Category"
    path = scratch_path(spark, "clean_ledger")
    io.write_clean_ledger(cleaned, path)  # one written table feeds every branch; lineage is cut here
    led = spark.read.parquet(path)
    out["clean_ledger"] = led
    s = statements
    out.update({
        "financial_summary": s.financial_summary(led, by, cat_col, t),
        "profit_and_loss": s.profit_and_loss(led, by, cat_col),
        "balance_sheet": s.balance_sheet(led, by, cat_col),
        "gst_position": s.gst_position(led, by, cat_col),
        "balance_check": s.balance_check(led, by, cat_col),
        "tax_provision_check": s.tax_provision_check(led, by, cat_col, t),
        "cash_flow": s.cash_flow(led, by, cat_col),
        "financial_ratios": s.financial_ratios(led, by, cat_col),
        "exec_kpis": s.exec_kpis(led, by, cat_col, t),
        "recommendations": s.recommendations(led, by, cat_col),
        "yoy_comparison": trends.yoy_comparison(led, by, "Category"),
        "rule_violations": rules.rule_violations(led, None, by, cat_col),
        "category_totals": rollups.category_totals(led, by, cat_col),
        "top_expense_heads": rollups.top_expense_heads(led, by, cat_col, n=t.top_n_expense),
        "monthly_trend": rollups.monthly_trend(led, by, cat_col),
        "payment_mode_totals": rollups.payment_mode_totals(led, by),
        "gst_slab_totals": rollups.gst_slab_totals(led, by),
        "flow_edges": rollups.flow_edges(led, by, cat_col),
        "spend_hierarchy": rollups.spend_hierarchy(led, by, cat_col),
        "statistical_anomalies": anomaly.statistical_anomalies(led, by, t),
        "top_outliers": anomaly.top_outliers(led, by, t),
        "health_alerts": insights.health_alerts(led, by, cat_col),
    })
    ins = insights.compliance_insights(led, by, cat_col, t)
    out["compliance_insights"] = ins
    out["compliance_score"] = insights.compliance_score(ins, by, t)
    return out
