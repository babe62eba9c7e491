"""The query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (through the fixture views, which are
joins and projections of ``lineitem`` and friends), so its work grows with
them. ``present`` is the output projection shared with the SQL oracle:
decimals leave as DOUBLE and dates as ``yyyy-MM-dd`` text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import anomaly, clean, insights, quality, rollups, rules, statements, trends
from ..sources.fixture import ledger, ledger_dirty, read_table

Query = Callable[[SparkSession, str], DataFrame]


def present(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.date_format(F.col(f"`{f.name}`"), "yyyy-MM-dd").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def _on(view, op, **kw) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(op(view(spark, sf_dir), **kw))
    q.__name__ = getattr(op, "__name__", "query")
    return q


def ledger_text(df: DataFrame) -> DataFrame:
    """Per row: cleaned description, keyword class of the raw text, INR renderings of the amount."""
    return df.select("Company_ID", "Description", "Amount",
                     tx.clean_text("Description").alias("description_clean"),
                     tx.keyword_category("Description", "Amount").alias("keyword_category"),
                     tx.inr_format("Amount").alias("amount_inr"), tx.inr_plain("Amount").alias("amount_inr_plain"))


def ledger_features(df: DataFrame) -> DataFrame:
    """Per row: month (null date -> 1), weekend flag, fiscal year, class index, debit/credit."""
    d = F.col("Date")
    return df.select("Company_ID", "Date", "Category", "Amount",
                     sc.month_or_one(d).alias("month"), sc.is_weekend(d).alias("is_weekend"),
                     sc.fiscal_year_label(d).alias("fiscal_year"), sc.category_index("Category").alias("category_enc"),
                     sc.transaction_type("Category").alias("transaction_type"))


def documents_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean_text over whole document texts (the text-volume input)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", tx.clean_text("text").alias("text_clean"))


def documents_strip_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", tx.strip_emoji("text").alias("text_stripped"))


def _insights(df):
    return insights.compliance_insights(df)


def _tax_insights(df):
    return insights.insights_by_severity(insights.compliance_insights(df))


def _score(df):
    return insights.compliance_score(insights.compliance_insights(df))


def queries() -> dict[str, Query]:
    L, D = ledger, ledger_dirty
    q: dict[str, Query] = {}
    # statements
    for name in ("financial_summary", "summary_kpis", "profit_and_loss", "balance_sheet", "gst_position",
                 "schedule_iii_heads", "balance_check", "tax_provision_check", "cash_flow", "financial_ratios",
                 "exec_kpis", "recommendations"):
        q[name] = _on(L, getattr(statements, name))
    # cleaning and data quality (on the dirty view)
    q["clean_ledger"] = _on(D, clean.clean_ledger)
    q["null_profile"] = _on(D, quality.null_profile)
    q["quality_report"] = _on(D, quality.quality_report)
    q["quality_issues"] = _on(D, quality.quality_issues)
    q["negative_by_category"] = _on(D, quality.negative_by_category)
    q["unknown_categories"] = _on(D, quality.unknown_categories)
    q["preview_metrics"] = _on(D, quality.preview_metrics)
    q["dataset_overview"] = _on(L, quality.dataset_overview)
    q["gst_consistency"] = _on(L, quality.gst_consistency)
    q["preview"] = _on(D, quality.preview)
    # scalar functions
    q["ledger_text"] = _on(L, ledger_text)
    q["ledger_features"] = _on(L, ledger_features)
    q["documents_clean_text"] = documents_clean_text
    q["documents_strip_emoji"] = documents_strip_emoji
    # rule scan
    q["rule_violations"] = _on(L, rules.rule_violations)
    q["rule_hits"] = _on(L, rules.rule_hits)
    # roll-ups
    for name in ("category_totals", "category_distribution", "top_expense_heads", "monthly_trend",
                 "payment_mode_totals", "gst_slab_totals", "flow_edges", "network_nodes", "network_edges",
                 "spend_hierarchy"):
        q[name] = _on(L, getattr(rollups, name))
    # trends
    q["fiscal_year_totals"] = _on(L, trends.fiscal_year_totals)
    q["yoy_comparison"] = _on(L, trends.yoy_comparison)
    # anomalies
    q["statistical_anomalies"] = _on(L, anomaly.statistical_anomalies)
    q["iqr_outliers"] = _on(L, anomaly.iqr_outliers)
    q["top_outliers"] = _on(L, anomaly.top_outliers)
    # insights
    q["compliance_insights"] = _on(L, _insights)
    q["compliance_score"] = _on(L, _score)
    q["health_alerts"] = _on(L, insights.health_alerts)
    q["tax_insights_by_severity"] = _on(L, _tax_insights)
    # sources/sinks, streaming, ML
    from . import ml_queries
    for k, fn in ml_queries.queries().items():
        q[k] = (lambda f: lambda spark, sf_dir: present(f(spark, sf_dir)))(fn)
    from . import checked, source_queries
    return q | checked.queries() | source_queries.queries()
