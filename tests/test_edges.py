"""Edge ledgers: empty, one fiscal year, zero income, outlier gates, blocked credit, ties, NaN, text."""

from decimal import Decimal

from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.operators import anomaly, clean, insights, quality, rollups, rules, statements, trends
from tests.helpers import ledger, row


def test_empty_ledger_gives_no_rows_and_no_crash(spark):
    df = ledger(spark, [])
    assert statements.financial_summary(df).count() == 0
    assert insights.compliance_insights(df).count() == 0
    assert quality.quality_report(df).count() == 0


def test_single_fiscal_year_yoy_unavailable(spark):
    df = ledger(spark, [row(date="2023-05-01"), row(date="2024-02-01", cat="Income", sub="Product Sales",
                                                    head="Revenue from Operations")])
    r = trends.yoy_comparison(df).collect()[0]
    assert r["available"] is False and r["curr_fy"] == "FY 2023-24" and r["revenue_growth_pct"] is None


def test_negative_prior_profit_keeps_sign(spark):
    inc = dict(cat="Income", sub="Product Sales", head="Revenue from Operations")
    df = ledger(spark, [row(date="2022-05-01", amount="200.00"), row(date="2022-06-01", amount="100.00", **inc),
                        row(date="2023-05-01", amount="100.00"), row(date="2023-06-01", amount="150.00", **inc)])
    r = trends.yoy_comparison(df).collect()[0]
    # prior profit -100, current +50: (50 - -100) / -100 * 100 = -150 (sign not corrected)
    assert r["profit_growth_pct"] == -150.0 and r["trend"] == "Declining"


def test_zero_income_margin_is_zero_and_loss(spark):
    df = ledger(spark, [row(amount="500.00")])
    s = statements.financial_summary(df).collect()[0]
    assert s["profit_margin_pct"] == 0.0 and s["health"] == "Weak"
    codes = {r["code"]: r["level"] for r in insights.compliance_insights(df).collect()}
    assert codes["net_result"] == "critical" and "expense_ratio" not in codes and "gst_liability" not in codes


def _amount_rows(n):
    return [row(amount=f"{100 + i}.00") for i in range(n - 1)] + [row(amount="100000.00")]


def test_outlier_gates_ten_and_eleven_rows(spark):
    ten, eleven = ledger(spark, _amount_rows(10)), ledger(spark, _amount_rows(11))
    assert anomaly.iqr_outliers(ten, gate="anomaly").count() == 1          # >= 10 non-null
    assert anomaly.iqr_outliers(ten, gate="validation").count() == 0       # > 10 non-null
    assert anomaly.iqr_outliers(eleven, gate="validation").count() == 1
    codes = [r["code"] for r in insights.compliance_insights(ten).collect()]
    assert "large_txns" not in codes                                       # > 10 rows needed
    codes = [r["code"] for r in insights.compliance_insights(eleven).collect()]
    assert "large_txns" in codes


def test_blocked_credit_and_tds_rules_fire(spark):
    df = ledger(spark, [
        row(sub="Food & Beverages", amount="5000.00", gst_pct=18, gst="900.00"),
        row(sub="Contract Labour", amount="150000.00"),
        row(sub="Legal & Professional", amount="40000.00"),
    ])
    v = {r["rule_name"]: r["count"] for r in rules.rule_violations(df).collect()}
    assert v == {"gst_itc_blocked": 1, "tds_contractor": 1, "tds_professional_fees": 1}
    f = {r["code"]: r for r in insights.compliance_insights(df).collect()}
    assert f["s17_5_blocked_itc"]["amount"] == 900.0
    assert f["tds_26q"]["n"] == 2 and f["tds_26q"]["amount"] == 190000.0


def test_rule_null_amount_never_matches(spark):
    df = ledger(spark, [row(amount=None, mode="Cash")])
    assert rules.rule_hits(df).count() == 0


def test_top_n_ties_break_on_name(spark):
    df = ledger(spark, [row(sub="B", amount="10.00"), row(sub="A", amount="10.00"), row(sub="C", amount="5.00")])
    r = [(x["rank"], x["sub_category"]) for x in rollups.top_expense_heads(df, n=2).collect()]
    assert sorted(r) == [(1, "A"), (2, "B")]


def test_clean_order_median_sees_negatives(spark):
    df = ledger(spark, [row(amount="-100.00"), row(amount="10.00"), row(amount="30.00"), row(amount=None),
                        row(amount="10.00")])  # duplicate of the second row
    out = clean.clean_ledger(df).collect()
    amts = sorted(float(r["Amount"]) for r in out)
    # dedupe -> [-100, 10, 30, null]; median of (-100, 10, 30) = 10; negative dropped
    assert amts == [10.0, 10.0, 30.0] and len(out) == 3


def test_quality_score_absolute_and_per_1k(spark):
    df = ledger(spark, [row(desc=None, amount="0.00"), row(cat="Misc"), row(amount="-5.00")])
    r = quality.quality_report(df).collect()[0]
    # penalty = 0.5*1 missing + 0.5*1 negative + 0.2*1 zero + 1*1 unknown = 2.2 -> 100 - 2
    assert r["quality_score"] == 98 and r["duplicates"] == 0 and r["unknown"] == 1


def test_inr_format_examples(spark):
    df = spark.createDataFrame([(Decimal("63385218.98"),), (Decimal("-100000.00"),), (Decimal("99996.13"),),
                                (Decimal("12.50"),), (None,)], "v decimal(18,2)")
    got = [r[0] for r in df.select(tx.inr_format("v")).collect()]
    assert got == ["₹6,33,85,218.98", "₹-1,00,000.00", "₹99,996.13", "₹12.50", None]
    assert df.select(tx.inr_plain("v")).first()[0] == "Rs. 6,33,85,218.98"


def test_text_functions_unicode(spark):
    df = spark.createDataFrame([("  Café — Ünïcode ☕ 漢字 ok ",), (None,)], "t string")
    r = df.select(tx.clean_text("t").alias("c"), tx.strip_emoji("t").alias("s")).collect()
    assert r[0]["c"] == "caf n code ok" and r[1]["c"] == "unknown"
    assert r[0]["s"] == "Café — Ünïcode   ok"


def test_keyword_category_first_match_and_default(spark):
    df = spark.createDataFrame([("Salary for March", 1.0), ("Machinery purchase", 1.0), ("xyz", 600000.0),
                                ("xyz", 10.0), (None, None)], "d string, a double")
    got = [r[0] for r in df.select(tx.keyword_category("d", "a")).collect()]
    assert got == ["Expense", "Expense", "Asset", "Expense", "Expense"]


def test_missing_columns_are_skipped(spark):
    df = ledger(spark, [row()]).drop("Payment_Mode", "GST_Amount")
    s = statements.financial_summary(df).collect()[0]
    assert s["gst_on_income"] == 0.0
    assert rules.rule_hits(df).count() == 0


def test_balance_sheet_balances_after_adjustment(spark):
    df = ledger(spark, [row(cat="Asset", sub="Inventories", head="Inventories", amount="500.00"),
                        row(cat="Liability", sub="Trade Payables", head="Trade Payables", amount="200.00")])
    r = statements.balance_check(df).collect()[0]
    assert r["balanced"] and r["adjustment"] == 300.0


def test_by_empty_equals_sum_over_companies(spark):
    rows = [row(company="C1", amount="10.00"), row(company="C2", amount="32.50")]
    df = ledger(spark, rows)
    total = statements.financial_summary(df, by=[]).collect()[0]["total_expense"]
    per = sum(r["total_expense"] for r in statements.financial_summary(df).collect())
    assert total == per == 42.5


def test_flow_edges_conserve_value(spark, sf_small):
    from sheaf.sources.fixture import ledger_view
    df = ledger_view(spark, sf_small)
    e = rollups.flow_edges(df)
    a = e.filter(F.col("kind") == "category_sub").agg(F.sum("value")).first()[0]
    pos = (df.groupBy("Company_ID", "Category", "Sub_Category").agg(F.sum("Amount").alias("a"))
           .filter("a > 0").agg(F.sum("a")).first()[0])
    assert abs(a - float(pos)) < 1e-3
