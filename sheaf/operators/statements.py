"""Financial statements: Schedule III summary, P&L, balance sheet, GST, checks, cash flow.

``financial_summary`` is one conditional-sum aggregation per key (a single
shuffle of partial aggregates, map-side combined); every other operator in
this module is a projection or ``stack`` over that one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from .common import dsum, drop_null_keys, money, ratio, resolve_by, sql_str

# ---- fixed values: (class, Schedule III head, summary field) ---------------
HEAD_FIELDS = (
    ("Income", "Revenue from Operations", "revenue_from_operations"),
    ("Income", "Other Income", "other_income"),
    ("Expense", "Cost of Material Consumed", "cost_of_materials"),
    ("Expense", "Purchases of Stock-in-Trade", "cost_of_materials"),
    ("Expense", "Employee Benefit Expenses", "employee_benefit_expense"),
    ("Expense", "Finance Costs", "finance_costs"),
    ("Expense", "Depreciation & Amortisation", "depreciation_amortisation"),
    ("Expense", "Other Expenses", "other_expenses"),
    ("Liability", "Share Capital", "share_capital"),
    ("Liability", "Reserves & Surplus", "reserves_surplus_before_adjustment"),
    ("Liability", "Long-term Borrowings", "long_term_borrowings"),
    ("Liability", "Deferred Tax Liabilities (Net)", "deferred_tax_liability"),
    ("Liability", "Other Long-term Liabilities", "other_lt_liabilities"),
    ("Liability", "Long-term Provisions", "lt_provisions"),
    ("Liability", "Short-term Borrowings", "short_term_borrowings"),
    ("Liability", "Trade Payables", "trade_payables"),
    ("Liability", "Other Current Liabilities", "other_current_liabilities"),
    ("Liability", "Short-term Provisions", "short_term_provisions"),
    ("Asset", "Tangible Fixed Assets", "tangible_assets"),
    ("Asset", "Intangible Fixed Assets", "intangible_assets"),
    ("Asset", "Capital Work-in-Progress", "cwip"),
    ("Asset", "Non-current Investments", "non_current_investments"),
    ("Asset", "Deferred Tax Assets (Net)", "deferred_tax_asset"),
    ("Asset", "Long-term Loans & Advances", "lt_loans_advances"),
    ("Asset", "Inventories", "inventories"),
    ("Asset", "Trade Receivables", "trade_receivables"),
    ("Asset", "Cash & Cash Equivalents", "cash_equivalents"),
    ("Asset", "Short-term Loans & Advances", "short_term_loans"),
    ("Asset", "Other Current Assets", "other_current_assets"),
)
NON_CURRENT_LIABILITIES = ("long_term_borrowings", "deferred_tax_liability", "other_lt_liabilities", "lt_provisions")
CURRENT_LIABILITIES = ("short_term_borrowings", "trade_payables", "other_current_liabilities", "short_term_provisions")
NON_CURRENT_ASSETS = ("tangible_assets", "intangible_assets", "cwip", "non_current_investments",
                      "deferred_tax_asset", "lt_loans_advances")
CURRENT_ASSETS = ("inventories", "trade_receivables", "cash_equivalents", "short_term_loans", "other_current_assets")
# ---------------------------------------------------------------------------

HEAD_FIELD_NAMES = tuple(dict.fromkeys(f for _, _, f in HEAD_FIELDS))
CLASS_TOTALS = (("Income", "total_income"), ("Expense", "total_expense"),
                ("Asset", "asset_rows_total"), ("Liability", "total_liabilities"))

# Decimal fields of the summary row (money), in output order.
SUMMARY_MONEY = (
    ("revenue_from_operations", "other_income", "total_income", "cost_of_materials", "employee_benefit_expense",
     "finance_costs", "depreciation_amortisation", "other_expenses", "total_expense", "profit_before_tax",
     "short_term_provisions", "net_profit_loss", "gst_on_income", "gst_on_expense", "gst_payable",
     "share_capital", "reserves_surplus", "shareholders_funds", "long_term_borrowings", "deferred_tax_liability",
     "other_lt_liabilities", "lt_provisions", "non_current_liabilities", "short_term_borrowings",
     "trade_payables", "other_current_liabilities", "current_liabilities", "tangible_assets",
     "intangible_assets", "cwip", "non_current_investments", "deferred_tax_asset", "lt_loans_advances",
     "non_current_assets", "inventories", "trade_receivables", "cash_equivalents", "short_term_loans",
     "other_current_assets", "current_assets", "total_assets", "total_liabilities",
     "balance_sheet_adjustment", "total_equity_and_liabilities",
     "unmapped_income", "unmapped_expense", "unmapped_asset", "unmapped_liability")
)


def _sum_cols(names) -> Column:
    out = None
    for n in names:
        out = F.col(n) if out is None else out + F.col(n)
    return out


def _q(name: str) -> str:
    return "`" + name + "`"


def summary_aggregate(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """One row per key with every Schedule III field as DECIMAL (exact).

    Two steps: (1) sum Amount/GST per (key, class, head) - a hash aggregate
    with map-side combine, so even a company holding a third of all rows
    leaves each map task as at most one row per class and head; (2) spread
    that small table into the wide summary with conditional sums. Expressions
    are SQL text so the plan is built with a handful of JVM calls.
    """
    by = resolve_by(df, by)
    src = drop_null_keys(df, by)
    gst = "GST_Amount" if "GST_Amount" in df.columns else "CAST(0 AS DECIMAL(18,2))"
    keys = [_q(b) for b in by]
    compact = src.selectExpr(*keys, f"{_q(cat_col)} AS _cat",
                             "coalesce(Schedule_III_Head, Sub_Category) AS _head", "Amount AS _amt",
                             f"{gst} AS _gst")
    compact = compact.groupBy(*by, "_cat", "_head").agg(
        F.expr("sum(_amt) AS _amt"), F.expr("sum(_gst) AS _gst"), F.expr("count(1) AS _n"))

    zero = "CAST(0 AS DECIMAL(18,2))"
    aggs = [f"coalesce(sum(CASE WHEN _cat = '{cls}' THEN _amt END), {zero}) AS {name}" for cls, name in CLASS_TOTALS]
    for field in HEAD_FIELD_NAMES:
        cond = " OR ".join(f"(_cat = '{cls}' AND _head = '{h}')" for cls, h, f in HEAD_FIELDS if f == field)
        aggs.append(f"coalesce(sum(CASE WHEN {cond} THEN _amt END), {zero}) AS {field}")
    aggs += [
        f"coalesce(sum(CASE WHEN _cat = 'Income' THEN _gst END), {zero}) AS gst_on_income",
        f"coalesce(sum(CASE WHEN _cat = 'Expense' THEN _gst END), {zero}) AS gst_on_expense",
        "CAST(coalesce(sum(CASE WHEN _cat = 'Income' THEN _n END), 0) AS BIGINT) AS income_txns",
        "CAST(coalesce(sum(_n), 0) AS BIGINT) AS n_rows",
    ]
    aggs = [F.expr(a) for a in aggs]
    g = compact.groupBy(*by).agg(*aggs) if by else compact.agg(*aggs)

    nl, cl = " + ".join(NON_CURRENT_LIABILITIES), " + ".join(CURRENT_LIABILITIES)
    na, ca = " + ".join(NON_CURRENT_ASSETS), " + ".join(CURRENT_ASSETS)
    g = g.selectExpr(
        "*", "total_income - total_expense AS profit_before_tax",
        "total_income - total_expense - short_term_provisions AS net_profit_loss",
        "gst_on_income - gst_on_expense AS gst_payable",
        f"{nl} AS non_current_liabilities", f"{cl} AS current_liabilities",
        f"{na} AS non_current_assets", f"{ca} AS current_assets", f"{na} + {ca} AS total_assets")
    g = g.selectExpr(
        "*", "total_assets - (share_capital + reserves_surplus_before_adjustment + non_current_liabilities"
             " + current_liabilities) AS balance_sheet_adjustment")
    return g.selectExpr(
        "*", "reserves_surplus_before_adjustment + balance_sheet_adjustment AS reserves_surplus",
        "share_capital + reserves_surplus_before_adjustment + balance_sheet_adjustment AS shareholders_funds",
        "share_capital + reserves_surplus_before_adjustment + balance_sheet_adjustment + non_current_liabilities"
        " + current_liabilities AS total_equity_and_liabilities",
        "total_income - revenue_from_operations - other_income AS unmapped_income",
        "total_expense - (cost_of_materials + employee_benefit_expense + finance_costs + depreciation_amortisation"
        " + other_expenses) AS unmapped_expense",
        "asset_rows_total - total_assets AS unmapped_asset",
        "total_liabilities - share_capital - reserves_surplus_before_adjustment - non_current_liabilities"
        " - current_liabilities AS unmapped_liability",
        "coalesce(CASE WHEN total_income <> 0 THEN CAST(net_profit_loss AS DOUBLE) / CAST(total_income AS DOUBLE)"
        " END * 100, 0D) AS profit_margin_pct")


def health_class(margin: Column, t: Thresholds = DEFAULT) -> Column:
    return (F.when(margin >= t.margin_strong, "Strong").when(margin >= t.margin_moderate, "Moderate")
            .when(margin >= t.margin_weak, "Weak").otherwise("Loss-Making"))


def health_colour(margin: Column, t: Thresholds = DEFAULT) -> Column:
    return (F.when(margin >= t.margin_strong, "green").when(margin >= t.margin_moderate, "amber")
            .otherwise("red"))


def financial_summary(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category",
                      t: Thresholds = DEFAULT) -> DataFrame:
    """The summary row per key: money as DOUBLE, plus margin, health class and colour."""
    by = resolve_by(df, by)
    g = summary_aggregate(df, by, cat_col)
    return g.select(
        *by, *[money(c).alias(c) for c in SUMMARY_MONEY],
        F.col("profit_margin_pct"), F.col("income_txns"), F.col("n_rows"),
        health_class(F.col("profit_margin_pct"), t).alias("health"),
        health_colour(F.col("profit_margin_pct"), t).alias("health_colour"),
    )


def summary_kpis(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    by = resolve_by(df, by)
    g = summary_aggregate(df, by, cat_col)
    return g.select(
        *by,
        money("total_income").alias("total_income"), money("total_expense").alias("total_expense"),
        money("net_profit_loss").alias("net_profit_loss"), F.col("profit_margin_pct"),
        money("gst_on_income").alias("gst_collected_output"), money("gst_on_expense").alias("gst_paid_input_credit"),
        money("gst_payable").alias("net_gst_payable"), money("total_assets").alias("total_assets"),
        money("total_liabilities").alias("total_liabilities"), money("shareholders_funds").alias("shareholders_funds"),
    )


def _stack(g: DataFrame, by: list[str], lines: list[tuple[str, str]]) -> DataFrame:
    """Turn summary fields into ordered statement lines (line_no, line, amount)."""
    items = ", ".join(f"{i + 1}, {sql_str(label)}, CAST({field} AS DOUBLE)" for i, (label, field) in enumerate(lines))
    return g.selectExpr(*[f"`{b}`" for b in by], f"stack({len(lines)}, {items}) AS (line_no, line, amount)")


# ---- fixed values: statement line labels -----------------------------------
PNL_LINES = [
    ("Revenue from Operations", "revenue_from_operations"), ("Other Income", "other_income"),
    ("Total Income", "total_income"), ("Cost of Materials Consumed", "cost_of_materials"),
    ("Employee Benefit Expense", "employee_benefit_expense"), ("Finance Costs", "finance_costs"),
    ("Depreciation & Amortisation", "depreciation_amortisation"), ("Other Expenses", "other_expenses"),
    ("Total Expenses", "total_expense"), ("Profit Before Tax", "profit_before_tax"),
    ("Tax Expense", "short_term_provisions"), ("Net Profit / (Loss)", "net_profit_loss"),
]
BALANCE_SHEET_LINES = [
    ("Share Capital", "share_capital"), ("Reserves & Surplus", "reserves_surplus"),
    ("Shareholders' Funds", "shareholders_funds"), ("Long-term Borrowings", "long_term_borrowings"),
    ("Deferred Tax Liabilities (Net)", "deferred_tax_liability"),
    ("Other Long-term Liabilities", "other_lt_liabilities"), ("Long-term Provisions", "lt_provisions"),
    ("Non-current Liabilities", "non_current_liabilities"), ("Short-term Borrowings", "short_term_borrowings"),
    ("Trade Payables", "trade_payables"), ("Other Current Liabilities", "other_current_liabilities"),
    ("Short-term Provisions", "short_term_provisions"), ("Current Liabilities", "current_liabilities"),
    ("Total Equity & Liabilities", "total_equity_and_liabilities"), ("Tangible Assets", "tangible_assets"),
    ("Intangible Assets", "intangible_assets"), ("Capital Work-in-Progress", "cwip"),
    ("Non-current Investments", "non_current_investments"), ("Deferred Tax Assets (Net)", "deferred_tax_asset"),
    ("Long-term Loans & Advances", "lt_loans_advances"), ("Non-current Assets", "non_current_assets"),
    ("Inventories", "inventories"), ("Trade Receivables", "trade_receivables"),
    ("Cash & Cash Equivalents", "cash_equivalents"), ("Short-term Loans & Advances", "short_term_loans"),
    ("Other Current Assets", "other_current_assets"), ("Current Assets", "current_assets"),
    ("Total Assets", "total_assets"),
]
GST_LINES = [("Output GST (Collected)", "gst_on_income"), ("Input GST Credit (Paid)", "gst_on_expense"),
             ("Net GST Payable", "gst_payable")]
# ---------------------------------------------------------------------------


def profit_and_loss(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    by = resolve_by(df, by)
    return _stack(summary_aggregate(df, by, cat_col), by, PNL_LINES)


def balance_sheet(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    by = resolve_by(df, by)
    return _stack(summary_aggregate(df, by, cat_col), by, BALANCE_SHEET_LINES)


def gst_position(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    by = resolve_by(df, by)
    return _stack(summary_aggregate(df, by, cat_col), by, GST_LINES)


def schedule_iii_heads(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Total per (class, Schedule III head); a missing head falls back to the sub-category."""
    by = resolve_by(df, by)
    head = F.coalesce(F.col("Schedule_III_Head"), F.col("Sub_Category"))
    src = drop_null_keys(df.withColumn("_head", head), by + [cat_col, "_head"])
    return (src.groupBy(*by, F.col(cat_col).alias("category"), F.col("_head").alias("head"))
            .agg(money(dsum(F.col("Amount"))).alias("amount"), F.count(F.lit(1)).alias("n")))


def balance_check(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Assets versus equity + liabilities (2 dp); balanced when the gap is under 1."""
    by = resolve_by(df, by)
    g = summary_aggregate(df, by, cat_col)
    gap = F.round(F.col("total_assets") - F.col("total_equity_and_liabilities"), 2)
    return g.select(
        *by,
        money(F.round("total_assets", 2)).alias("assets"),
        money(F.round("total_equity_and_liabilities", 2)).alias("equity_liab"),
        money(gap).alias("gap"),
        (F.abs(gap) < 1).alias("balanced"),
        money("balance_sheet_adjustment").alias("adjustment"),
        ((F.abs(gap) < 1) & (F.abs(F.col("balance_sheet_adjustment")) > 1)).alias("adjustment_posted"),
    )


def tax_provision_check(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category",
                        t: Thresholds = DEFAULT) -> DataFrame:
    """Provision versus PBT. Order of tests: n/a, no provision, low, above 35 %, high, ok."""
    by = resolve_by(df, by)
    g = summary_aggregate(df, by, cat_col)
    pbt, tax = F.col("profit_before_tax"), F.col("short_term_provisions")
    rate = tax.cast("double") / pbt.cast("double")
    eff = F.round(rate * 100, 2)
    status = (F.when(pbt <= 0, "n/a").when(tax == 0, "warning").when(rate < t.tax_rate_low, "warning")
              .when(eff > t.tax_rate_unrealistic_pct, "critical").when(rate > t.tax_rate_high, "warning")
              .otherwise("ok"))
    reason = (F.when(pbt <= 0, "no_taxable_profit").when(tax == 0, "no_provision")
              .when(rate < t.tax_rate_low, "under_stated").when(eff > t.tax_rate_unrealistic_pct, "unrealistic")
              .when(rate > t.tax_rate_high, "over_stated").otherwise("reasonable"))
    return g.select(*by, status.alias("status"), reason.alias("reason"), money(pbt).alias("pbt"),
                    money(tax).alias("tax"),
                    F.when((pbt <= 0) | (tax == 0), F.lit(0.0)).otherwise(eff).alias("effective_rate_pct"))


def cash_flow(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Indirect-method estimate with the liquidity class."""
    by = resolve_by(df, by)
    g = summary_aggregate(df, by, cat_col)
    wc = F.col("trade_receivables") + F.col("inventories") - F.col("trade_payables")
    op = F.col("net_profit_loss") + F.col("depreciation_amortisation") + F.col("finance_costs") - wc
    inv = -(F.col("tangible_assets") + F.col("intangible_assets") + F.col("cwip"))
    fin = F.col("long_term_borrowings") + F.col("short_term_borrowings") + F.col("share_capital")
    g = g.select(*by, F.col("net_profit_loss"), F.col("depreciation_amortisation"), F.col("finance_costs"),
                 wc.alias("wc_change"), op.alias("operating_cf"), inv.alias("investing_cf"), fin.alias("financing_cf"),
                 F.col("cash_equivalents"), F.col("current_liabilities"))
    liquidity = (F.when((F.col("cash_equivalents") > F.col("current_liabilities") * 0.5) & (F.col("operating_cf") > 0),
                        "Strong").when(F.col("operating_cf") > 0, "Moderate").otherwise("Weak"))
    return g.select(
        *by, money("net_profit_loss").alias("net_profit"), money("depreciation_amortisation").alias("depreciation"),
        money("finance_costs").alias("finance_cost"), money("wc_change").alias("wc_change"),
        money("operating_cf").alias("operating_cf"), money("investing_cf").alias("investing_cf"),
        money("financing_cf").alias("financing_cf"),
        money(F.col("operating_cf") + F.col("investing_cf") + F.col("financing_cf")).alias("net_cf"),
        money("cash_equivalents").alias("cash_on_hand"), liquidity.alias("liquidity"),
    )


def _ratios(g: DataFrame) -> DataFrame:
    """Ratios of the printed report; denominators floored at 1 like the report."""
    ti = F.col("total_income").cast("double")
    return g.withColumn("expense_ratio", F.col("total_expense").cast("double") / F.greatest(ti, F.lit(1.0))) \
        .withColumn("debt_to_equity", (F.col("short_term_borrowings") + F.col("long_term_borrowings")).cast("double")
                    / F.greatest(F.col("shareholders_funds").cast("double"), F.lit(1.0))) \
        .withColumn("current_ratio", F.col("current_assets").cast("double")
                    / F.greatest(F.col("current_liabilities").cast("double"), F.lit(1.0))) \
        .withColumn("asset_cover", F.col("total_assets").cast("double")
                    / F.greatest(F.col("total_liabilities").cast("double"), F.lit(1.0)))


def financial_ratios(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Four ratios with their status bands, one row per ratio, plus the risk level per key."""
    by = resolve_by(df, by)
    g = _ratios(summary_aggregate(df, by, cat_col))
    pm, er, de, cr = (F.col("profit_margin_pct"), F.col("expense_ratio"), F.col("debt_to_equity"),
                      F.col("current_ratio"))
    g = g.select(
        *by, pm, er, de, cr,
        (F.when(pm >= 15, "Strong").when(pm >= 5, "Moderate").when(pm >= 0, "Weak").otherwise("Loss")).alias("pm_s"),
        (F.when(er * 100 > 90, "High").when(er * 100 > 80, "Elevated").otherwise("Efficient")).alias("er_s"),
        (F.when(de > 2, "High Leverage").when(de > 1, "Moderate").otherwise("Low Leverage")).alias("de_s"),
        (F.when(cr < 1, "Liquidity Concern").when(cr >= 1.5, "Healthy").otherwise("Borderline")).alias("cr_s"),
        risk_level(pm, cr).alias("risk_level"),
    )
    return g.selectExpr(
        *[f"`{b}`" for b in by],
        "stack(4, 'Profit Margin', profit_margin_pct, pm_s, 'Expense Ratio', expense_ratio, er_s, "
        "'Debt-to-Equity', debt_to_equity, de_s, 'Current Ratio', current_ratio, cr_s) AS (ratio, value, status)",
        "risk_level",
    )


def risk_level(margin: Column, current_ratio: Column) -> Column:
    return F.when((margin < 5) | (current_ratio < 1), "High").when(margin < 15, "Moderate").otherwise("Low")


def exec_kpis(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category",
              t: Thresholds = DEFAULT) -> DataFrame:
    """Executive KPI row: figures, health, key risk and key strength."""
    by = resolve_by(df, by)
    g = _ratios(summary_aggregate(df, by, cat_col))
    cover, pm = F.col("asset_cover"), F.col("profit_margin_pct")
    key_risk = (F.when(cover < 1, "Insufficient cash cover against current liabilities")
                .when(pm < 5, "Critically low profit margin — profitability at risk")
                .when(pm < 15, "Moderate margin leaves limited downside buffer")
                .otherwise("No material financial risk identified at this time"))
    key_strength = (F.when(cover > 1.5, "Strong asset cover ratio")
                    .when(pm > 0, "Positive operating profitability maintained")
                    .otherwise("Revenue base is established — focus required on cost management"))
    return g.select(
        *by, money("total_income").alias("total_revenue"), money("total_expense").alias("total_expenses"),
        money(F.abs(F.col("net_profit_loss"))).alias("net_result_abs"),
        F.when(F.col("net_profit_loss") >= 0, "Profit").otherwise("Loss").alias("net_result_kind"),
        pm.alias("profit_margin_pct"), (F.col("expense_ratio") * 100).alias("expense_ratio_pct"),
        health_class(pm, t).alias("health"), money("gst_payable").alias("net_gst_payable"),
        cover.alias("asset_cover"), key_risk.alias("key_risk"), key_strength.alias("key_strength"),
    )


def recommendations(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Numbered recommendation list per key (conditional items plus three standing ones)."""
    by = resolve_by(df, by)
    g = _ratios(summary_aggregate(df, by, cat_col))
    pm, er, cr = F.col("profit_margin_pct"), F.col("expense_ratio"), F.col("current_ratio")
    items = [
        (pm < 5, "Profit Margin Improvement"),
        (er > 0.85, "Expense Rationalisation"),
        (cr < 1.2, "Working Capital Management"),
        (F.col("total_income") > 10_000_000, "Statutory Tax Audit"),
        (F.lit(True), "GST Compliance"),
        (F.lit(True), "Cash Payment Controls"),
        (F.lit(True), "TDS & Advance Tax"),
        (F.col("long_term_borrowings") > F.col("shareholders_funds") * 2, "Debt Restructuring"),
    ]
    arr = F.array(*[F.when(c, F.lit(title)) for c, title in items])
    g = g.select(*by, F.array_compact(arr).alias("_r"))
    return g.select(*by, F.posexplode("_r").alias("pos", "title")).select(
        *by, (F.col("pos") + 1).alias("rec_no"), "title")
