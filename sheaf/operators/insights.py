"""Compliance insights, the compliance score and the financial health alerts.

Findings come from three one-row-per-key tables joined on the key: the
Schedule III summary, one wide conditional aggregation over the ledger rows
(tax checks), and the IQR outlier statistics. ``explode`` of an array of
``when(cond, struct)`` turns them into one finding row each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.text import inr_format
from .anomaly import iqr_thresholds
from .common import drop_null_keys, dsum, join_small, resolve_by
from .rollups import top_expense_heads
from .statements import summary_aggregate
from .trends import yoy_comparison

# ---- fixed values: blocked-credit sub-categories and TDS patterns -------------
BLOCKED_ITC_SUBCATEGORIES = ("Staff Welfare Expenses", "Food & Beverages", "Vehicle Repair", "Health Insurance")
TDS_PROFESSIONAL_PATTERN = "(?i)Professional|Legal|Audit"
TDS_CONTRACT_PATTERN = "(?i)Contract|Labour"
# -------------------------------------------------------------------------------

FINDING = "struct<seq:int,code:string,level:string,title:string,amount:double,value:double,n:bigint>"


def _f(cond: Column, seq: int, code: str, level: Column | str, title: Column | str, amount=None, value=None,
       n=None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(cond, F.struct(
        F.lit(seq).alias("seq"), F.lit(code).alias("code"), lit(level).alias("level"), lit(title).alias("title"),
        (amount if amount is not None else F.lit(None)).cast("double").alias("amount"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        (n if n is not None else F.lit(None)).cast("bigint").alias("n")))


def tax_check_aggregate(df: DataFrame, by: list[str], cat_col: str = "Category", t: Thresholds = DEFAULT):
    """The row-level tax checks of all keys in one aggregation."""
    src = drop_null_keys(df, by)
    amt = F.col("Amount")
    cash = F.col("Payment_Mode") == "Cash"
    s40 = (F.col(cat_col) == "Expense") & cash & (amt > t.cash_expense_limit)
    s269 = cash & (amt >= t.cash_receipt_limit)
    sub = F.col("Sub_Category")
    aggs = [
        F.count(F.lit(1)).alias("rows_all"),
        F.count_if(s40).alias("s40_n"), dsum(amt, s40).alias("s40_amt"),
        F.count_if(s269).alias("s269_n"), dsum(amt, s269).alias("s269_amt"),
        dsum(amt, F.coalesce(sub.rlike(TDS_PROFESSIONAL_PATTERN), F.lit(False))).alias("prof_total"),
        dsum(amt, F.coalesce(sub.rlike(TDS_CONTRACT_PATTERN), F.lit(False))).alias("contr_total"),
        dsum(F.col("GST_Amount"), sub.isin(*BLOCKED_ITC_SUBCATEGORIES)).alias("blocked_gst"),
    ]
    return src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)


def outlier_stats(df: DataFrame, by: list[str], t: Thresholds = DEFAULT) -> DataFrame:
    thr = iqr_thresholds(df, by, t).select(*by, "threshold", "threshold_paise")
    rows = join_small(drop_null_keys(df, by).select(*by, "Amount"), thr.select(*by, "threshold_paise"), by)
    o = rows.filter((F.col("Amount") * 100).cast("double") > F.col("threshold_paise"))
    aggs = [F.count(F.lit(1)).alias("out_n"), F.max("Amount").alias("out_max")]
    o = o.groupBy(*by).agg(*aggs) if by else o.agg(*aggs)
    return join_small(thr, o, by, "left")


def compliance_insights(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category",
                        t: Thresholds = DEFAULT) -> DataFrame:
    """One finding row per check that fires: (key, seq, code, level, title, amount, value, n)."""
    by = resolve_by(df, by)
    s = summary_aggregate(df, by, cat_col)
    x = tax_check_aggregate(df, by, "Category", t)  # row-level checks and top heads read the booked class
    o = outlier_stats(df, by, t)
    k = join_small(join_small(s, x, by), o, by, "left")

    ti, te, net, pm = F.col("total_income"), F.col("total_expense"), F.col("net_profit_loss"), F.col(
        "profit_margin_pct")
    gp, pbt = F.col("gst_payable"), F.col("profit_before_tax")
    ta, tl = F.col("total_assets"), F.col("total_liabilities")
    exp_ratio = te.cast("double") / ti.cast("double")
    gst_ratio = gp.cast("double") / ti.cast("double")
    prof_ok = F.col("prof_total") >= t.tds_professional_limit
    contr_ok = F.col("contr_total") >= t.tds_contract_limit
    out_n = F.coalesce(F.col("out_n"), F.lit(0))
    lev = tl.cast("double") / ta.cast("double")
    findings = F.array(
        _f(net > 0, 10, "net_result", "info", "Profitable Period", net, pm),
        _f(net <= 0, 10, "net_result", "critical", "Net Loss Recorded", F.abs(net), pm),
        _f(pm >= t.margin_strong, 20, "margin_band", "info", "Strong Profit Margin", None, pm),
        _f((pm < t.margin_strong) & (pm >= t.margin_moderate), 20, "margin_band", "warning",
           "Moderate Profit Margin", None, pm),
        _f((pm < t.margin_moderate) & (pm >= 0), 20, "margin_band", "critical", "Weak Profit Margin", None, pm),
        _f((ti > 0) & (exp_ratio >= t.expense_ratio_high), 30, "expense_ratio", "warning",
           "High Expense-to-Income Ratio", te, exp_ratio * 100),
        _f((ti > 0) & (gst_ratio > t.gst_ratio_high), 50, "gst_liability", "warning", "Elevated GST Liability", gp,
           gst_ratio * 100),
        _f((ti > 0) & ~(gst_ratio > t.gst_ratio_high), 50, "gst_liability", "info", "GST Position", gp,
           gst_ratio * 100),
        _f((F.col("rows_all") > t.min_rows_for_anomaly) & (out_n > 0), 60, "large_txns", "warning",
           "Anomalous Large Transactions Detected", F.col("out_max"), F.col("threshold"), out_n),
        _f(F.col("s40_n") > 0, 70, "s40a3_cash_expense", "critical",
           "[TAX COMPLIANCE] Section 40A(3) — Cash Expenditure Assessment", F.col("s40_amt"), None, F.col("s40_n")),
        _f(F.col("s269_n") > 0, 75, "s269st_cash", "critical",
           "[TAX COMPLIANCE] Section 269ST — Cash Receipts/Payments Exceeding Rs.2 Lakh", F.col("s269_amt"), None,
           F.col("s269_n")),
        _f(ti > t.tax_audit_turnover, 80, "s44ab_audit", "warning",
           "[TAX COMPLIANCE] Tax Audit Threshold — Section 44AB", ti),
        _f(prof_ok | contr_ok, 90, "tds_26q", "warning", "[TAX COMPLIANCE] TDS Obligation Check — Form 26Q",
           F.when(prof_ok, F.col("prof_total")).otherwise(F.lit(0)) + F.when(contr_ok, F.col("contr_total"))
           .otherwise(F.lit(0)), None, prof_ok.cast("int") + contr_ok.cast("int")),
        _f((pbt > t.advance_tax_pbt) & (pbt * 0.25 >= t.advance_tax_min), 100, "s208_advance_tax", "info",
           "[TAX COMPLIANCE] Advance Tax Installments — Section 208", pbt * F.lit(0.25).cast("decimal(3,2)")),
        _f(F.col("blocked_gst") > 0, 110, "s17_5_blocked_itc", "critical",
           "[TAX COMPLIANCE] Restricted Input Tax Credit — Section 17(5) CGST Act", F.col("blocked_gst")),
        _f((tl > 0) & (ta > 0) & (lev > 2.0), 120, "leverage", "warning", "High Financial Leverage", ta - tl, lev),
        _f((tl > 0) & (ta > 0) & ~(lev > 2.0), 120, "leverage", "info", "Balance Sheet Position", ta - tl, lev),
    )
    main = k.select(*by, F.explode(F.array_compact(findings)).alias("f")).select(*by, "f.*")
    heads = top_expense_heads(df, by, "Category", n=t.top_n_expense).select(
        *by, (F.lit(40) + F.col("rank")).cast("int").alias("seq"), F.lit("major_head").alias("code"),
        F.lit("info").alias("level"), F.concat(F.lit("Major Expenditure Head: "), F.col("sub_category")).alias("title"),
        F.col("amount").cast("double").alias("amount"), F.col("pct_of_expense").alias("value"),
        F.lit(None).cast("bigint").alias("n"))
    return main.unionByName(heads)


#: What a finding says, by code (and level where it matters). {amount} and {value_inr} are rupees (the latter whole ones), {value} has one decimal.
MESSAGES = (
    ("net_result", "info", "The period closed with a profit of {amount}, {value} % of income."),
    ("net_result", "critical", "The period closed with a loss of {amount}."),
    ("margin_band", None, "Of every rupee earned, {value} % is left as profit."),
    ("expense_ratio", None, "Expenses of {amount} use up {value} % of income."),
    ("major_head", None, "This head costs {amount}, {value} % of all expenses."),
    ("gst_liability", None, "GST of {amount} is payable, {value} % of income."),
    ("large_txns", None, "{n} transactions exceed {value_inr}; the largest is {amount}."),
    ("s40a3_cash_expense", None, "{n} cash expenses over the limit, {amount} together, may not be deductible."),
    ("s269st_cash", None, "{n} cash transactions reach the limit, {amount} together."),
    ("s44ab_audit", None, "Turnover of {amount} needs an audit of the accounts."),
    ("tds_26q", None, "Tax is to be deducted at source from payments of {amount}."),
    ("s208_advance_tax", None, "An advance tax instalment of about {amount} is due."),
    ("s17_5_blocked_itc", None, "GST credit of {amount} on blocked items cannot be taken."),
    ("leverage", None, "Liabilities stand at {value} times the assets."),
)


def insight_messages(insights: DataFrame) -> DataFrame:
    """Adds ``message``: the finding in one sentence with its amounts in Indian grouping."""
    value = F.round("value", 1).cast("decimal(20,1)").cast("string")
    parts = {"amount": inr_format(F.col("amount")), "value_inr": inr_format(F.floor("value")), "value": value,
             "n": F.col("n").cast("string")}
    out = None
    for code, level, text in MESSAGES:
        names = re.findall(r"\{(\w+)\}", text)
        said = F.format_string(re.sub(r"\{\w+\}", "%s", text.replace("%", "%%")), *[parts[n] for n in names])
        hit = (F.col("code") == code) & (F.lit(True) if level is None else F.col("level") == level)
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return insights.withColumn("message", out)


def compliance_score(insights: DataFrame, by: list[str] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """risk = 5 x critical + 3 x warning; score = max(0, 100 - risk); grade A..F; gauge band."""
    by = resolve_by(insights, by)
    aggs = [F.count_if(F.col("level") == lv).alias(f"{lv}_count") for lv in ("critical", "warning", "info")]
    g = insights.groupBy(*by).agg(*aggs) if by else insights.agg(*aggs)
    risk = F.col("critical_count") * t.critical_weight + F.col("warning_count") * t.warning_weight
    g = g.withColumn("risk_score", risk.cast("int")).withColumn(
        "compliance_score", F.greatest(F.lit(0), F.lit(100) - F.col("risk_score")).cast("int"))
    sc = F.col("compliance_score")
    return g.select(*by, "critical_count", "warning_count", "info_count", "risk_score", "compliance_score",
                    F.when(sc >= 90, "A").when(sc >= 75, "B").when(sc >= 60, "C").when(sc >= 40, "D").otherwise("F")
                    .alias("grade"),
                    F.when(sc >= 75, "green").when(sc >= 50, "amber").otherwise("red").alias("score_band"))


def insights_by_severity(insights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tax findings grouped critical -> warning -> info (sorted output)."""
    rank = F.when(F.col("level") == "critical", 0).when(F.col("level") == "warning", 1).otherwise(2)
    by = resolve_by(insights, by)
    tax = insights.filter(F.col("title").startswith("[TAX COMPLIANCE]")).withColumn("severity_rank", rank)
    return tax.orderBy(*by, "severity_rank", "seq")


def health_alerts(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Cost escalation (YoY, always on Category like the reference), finance-cost burden, cash vs GST."""
    by = resolve_by(df, by)
    s = summary_aggregate(df, by, cat_col)
    y = yoy_comparison(df, by, "Category").select(*by, "available", "revenue_growth_pct", "expense_growth_pct")
    k = join_small(s, y, by, "left")
    rg = F.coalesce(F.col("revenue_growth_pct"), F.lit(0.0))
    eg = F.coalesce(F.col("expense_growth_pct"), F.lit(0.0))
    te = F.col("total_expense")
    fc = F.col("finance_costs").cast("double") / te.cast("double")
    gp, cash = F.col("gst_payable"), F.col("cash_equivalents")
    arr = F.array(
        _f(F.coalesce(F.col("available"), F.lit(False)) & (eg > rg) & (eg > 0), 1, "cost_escalation", "warning",
           "Cost Escalation Risk", None, eg - rg),
        _f((te > 0) & (fc > 0.15), 2, "finance_cost_burden", "warning", "High Finance Cost Burden",
           F.col("finance_costs"), fc * 100),
        _f((gp > 0) & (cash < gp), 3, "cash_vs_gst", "critical", "Cash Crunch vs GST Liability", gp - cash),
    )
    return k.select(*by, F.explode(F.array_compact(arr)).alias("f")).select(*by, "f.*")
