"""DuckDB-runnable SQL for each catalogued query (the correctness oracle).

Each text is independent SQL over the driver's base tables; the fixture
views come in as CTEs (``with_ledger``). Money is summed as DECIMAL and
converted to DOUBLE once at the end, exactly as the Spark operators do.
"""

from __future__ import annotations

from ..operators.statements import (BALANCE_SHEET_LINES, CURRENT_ASSETS, CURRENT_LIABILITIES, GST_LINES,
                                    HEAD_FIELD_NAMES, HEAD_FIELDS, NON_CURRENT_ASSETS, NON_CURRENT_LIABILITIES,
                                    PNL_LINES, SUMMARY_MONEY)
from .fixture_sql import with_ledger


def _plus(names) -> str:
    return " + ".join(names)


def summary_ctes(src: str = "ledger", cat: str = "Category") -> str:
    """CTEs ``s0`` (aggregate) and ``summary`` (derived fields), one row per company."""
    cols = [
        f"COALESCE(SUM(CASE WHEN {cat} = 'Income' THEN Amount END), 0) AS total_income",
        f"COALESCE(SUM(CASE WHEN {cat} = 'Expense' THEN Amount END), 0) AS total_expense",
        f"COALESCE(SUM(CASE WHEN {cat} = 'Asset' THEN Amount END), 0) AS asset_rows_total",
        f"COALESCE(SUM(CASE WHEN {cat} = 'Liability' THEN Amount END), 0) AS total_liabilities",
    ]
    for field in HEAD_FIELD_NAMES:
        conds = " OR ".join(
            f"({cat} = '{c}' AND COALESCE(Schedule_III_Head, Sub_Category) = '{h}')"
            for c, h, f in HEAD_FIELDS if f == field)
        cols.append(f"COALESCE(SUM(CASE WHEN {conds} THEN Amount END), 0) AS {field}")
    cols += [
        f"COALESCE(SUM(CASE WHEN {cat} = 'Income' THEN GST_Amount END), 0) AS gst_on_income",
        f"COALESCE(SUM(CASE WHEN {cat} = 'Expense' THEN GST_Amount END), 0) AS gst_on_expense",
        f"COUNT(CASE WHEN {cat} = 'Income' THEN 1 END) AS income_txns",
        "COUNT(*) AS n_rows",
    ]
    return f"""
s0 AS (SELECT Company_ID, {", ".join(cols)} FROM {src} WHERE Company_ID IS NOT NULL GROUP BY Company_ID),
s1 AS (SELECT *, total_income - total_expense AS profit_before_tax,
              total_income - total_expense - short_term_provisions AS net_profit_loss,
              gst_on_income - gst_on_expense AS gst_payable,
              {_plus(NON_CURRENT_LIABILITIES)} AS non_current_liabilities,
              {_plus(CURRENT_LIABILITIES)} AS current_liabilities,
              {_plus(NON_CURRENT_ASSETS)} AS non_current_assets,
              {_plus(CURRENT_ASSETS)} AS current_assets,
              {_plus(NON_CURRENT_ASSETS)} + {_plus(CURRENT_ASSETS)} AS total_assets
       FROM s0),
s2 AS (SELECT *, total_assets - (share_capital + reserves_surplus_before_adjustment + non_current_liabilities
                                 + current_liabilities) AS balance_sheet_adjustment FROM s1),
summary AS (SELECT *, reserves_surplus_before_adjustment + balance_sheet_adjustment AS reserves_surplus,
              share_capital + reserves_surplus_before_adjustment + balance_sheet_adjustment AS shareholders_funds,
              share_capital + reserves_surplus_before_adjustment + balance_sheet_adjustment
                + non_current_liabilities + current_liabilities AS total_equity_and_liabilities,
              total_income - revenue_from_operations - other_income AS unmapped_income,
              total_expense - (cost_of_materials + employee_benefit_expense + finance_costs
                               + depreciation_amortisation + other_expenses) AS unmapped_expense,
              asset_rows_total - total_assets AS unmapped_asset,
              total_liabilities - share_capital - reserves_surplus_before_adjustment - non_current_liabilities
                - current_liabilities AS unmapped_liability,
              COALESCE(CASE WHEN total_income <> 0 THEN CAST(total_income - total_expense - short_term_provisions AS DOUBLE)
                                 / CAST(total_income AS DOUBLE) END * 100, 0.0) AS profit_margin_pct
       FROM s2),
ratios AS (SELECT *, CAST(total_expense AS DOUBLE) / GREATEST(CAST(total_income AS DOUBLE), 1.0) AS expense_ratio,
              CAST(short_term_borrowings + long_term_borrowings AS DOUBLE)
                / GREATEST(CAST(shareholders_funds AS DOUBLE), 1.0) AS debt_to_equity,
              CAST(current_assets AS DOUBLE) / GREATEST(CAST(current_liabilities AS DOUBLE), 1.0) AS current_ratio,
              CAST(total_assets AS DOUBLE) / GREATEST(CAST(total_liabilities AS DOUBLE), 1.0) AS asset_cover
       FROM summary)"""


HEALTH_SQL = ("CASE WHEN profit_margin_pct >= 15 THEN 'Strong' WHEN profit_margin_pct >= 5 THEN 'Moderate' "
              "WHEN profit_margin_pct >= 0 THEN 'Weak' ELSE 'Loss-Making' END")


def _with_summary(body: str, src: str = "ledger", dirty: bool = False, cat: str = "Category") -> str:
    return with_ledger("WITH " + summary_ctes(src, cat) + "\n" + body, dirty=dirty)


def _stack_sql(lines) -> str:
    parts = [f"SELECT Company_ID, {i + 1} AS line_no, '{label.replace("'", "''")}' AS line, CAST({field} AS DOUBLE) AS amount FROM summary"
             for i, (label, field) in enumerate(lines)]
    return "\nUNION ALL\n".join(parts)


def statement_sql() -> dict[str, str]:
    money = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SUMMARY_MONEY)
    q = {}
    q["financial_summary"] = _with_summary(
        f"SELECT Company_ID, {money}, profit_margin_pct, income_txns, n_rows, {HEALTH_SQL} AS health, "
        "CASE WHEN profit_margin_pct >= 15 THEN 'green' WHEN profit_margin_pct >= 5 THEN 'amber' ELSE 'red' END "
        "AS health_colour FROM summary")
    q["summary_kpis"] = _with_summary(
        "SELECT Company_ID, CAST(total_income AS DOUBLE) AS total_income, CAST(total_expense AS DOUBLE) AS total_expense,"
        " CAST(net_profit_loss AS DOUBLE) AS net_profit_loss, profit_margin_pct,"
        " CAST(gst_on_income AS DOUBLE) AS gst_collected_output, CAST(gst_on_expense AS DOUBLE) AS gst_paid_input_credit,"
        " CAST(gst_payable AS DOUBLE) AS net_gst_payable, CAST(total_assets AS DOUBLE) AS total_assets,"
        " CAST(total_liabilities AS DOUBLE) AS total_liabilities,"
        " CAST(shareholders_funds AS DOUBLE) AS shareholders_funds FROM summary")
    q["profit_and_loss"] = _with_summary(_stack_sql(PNL_LINES))
    q["balance_sheet"] = _with_summary(_stack_sql(BALANCE_SHEET_LINES))
    q["gst_position"] = _with_summary(_stack_sql(GST_LINES))
    q["schedule_iii_heads"] = with_ledger(
        "SELECT Company_ID, Category AS category, COALESCE(Schedule_III_Head, Sub_Category) AS head,"
        " CAST(COALESCE(SUM(Amount), 0) AS DOUBLE) AS amount, COUNT(*) AS n FROM ledger"
        " WHERE Company_ID IS NOT NULL AND Category IS NOT NULL AND COALESCE(Schedule_III_Head, Sub_Category) IS NOT NULL"
        " GROUP BY 1, 2, 3")
    q["balance_check"] = _with_summary(
        "SELECT Company_ID, CAST(ROUND(total_assets, 2) AS DOUBLE) AS assets,"
        " CAST(ROUND(total_equity_and_liabilities, 2) AS DOUBLE) AS equity_liab,"
        " CAST(ROUND(total_assets - total_equity_and_liabilities, 2) AS DOUBLE) AS gap,"
        " ABS(ROUND(total_assets - total_equity_and_liabilities, 2)) < 1 AS balanced,"
        " CAST(balance_sheet_adjustment AS DOUBLE) AS adjustment,"
        " ABS(ROUND(total_assets - total_equity_and_liabilities, 2)) < 1 AND ABS(balance_sheet_adjustment) > 1"
        " AS adjustment_posted FROM summary")
    rate = "(CAST(short_term_provisions AS DOUBLE) / CAST(profit_before_tax AS DOUBLE))"
    eff = f"ROUND({rate} * 100, 2)"
    q["tax_provision_check"] = _with_summary(
        f"SELECT Company_ID,"
        f" CASE WHEN profit_before_tax <= 0 THEN 'n/a' WHEN short_term_provisions = 0 THEN 'warning'"
        f" WHEN {rate} < 0.2 THEN 'warning' WHEN {eff} > 35 THEN 'critical' WHEN {rate} > 0.3 THEN 'warning'"
        f" ELSE 'ok' END AS status,"
        f" CASE WHEN profit_before_tax <= 0 THEN 'no_taxable_profit' WHEN short_term_provisions = 0 THEN 'no_provision'"
        f" WHEN {rate} < 0.2 THEN 'under_stated' WHEN {eff} > 35 THEN 'unrealistic' WHEN {rate} > 0.3 THEN 'over_stated'"
        f" ELSE 'reasonable' END AS reason,"
        f" CAST(profit_before_tax AS DOUBLE) AS pbt, CAST(short_term_provisions AS DOUBLE) AS tax,"
        f" CASE WHEN profit_before_tax <= 0 OR short_term_provisions = 0 THEN 0.0 ELSE {eff} END AS effective_rate_pct"
        f" FROM summary")
    q["cash_flow"] = _with_summary(
        "SELECT Company_ID, CAST(net_profit_loss AS DOUBLE) AS net_profit,"
        " CAST(depreciation_amortisation AS DOUBLE) AS depreciation, CAST(finance_costs AS DOUBLE) AS finance_cost,"
        " CAST(wc AS DOUBLE) AS wc_change, CAST(op AS DOUBLE) AS operating_cf, CAST(inv AS DOUBLE) AS investing_cf,"
        " CAST(fin AS DOUBLE) AS financing_cf, CAST(op + inv + fin AS DOUBLE) AS net_cf,"
        " CAST(cash_equivalents AS DOUBLE) AS cash_on_hand,"
        " CASE WHEN cash_equivalents > current_liabilities * 0.5 AND op > 0 THEN 'Strong'"
        " WHEN op > 0 THEN 'Moderate' ELSE 'Weak' END AS liquidity FROM ("
        " SELECT *, trade_receivables + inventories - trade_payables AS wc,"
        " net_profit_loss + depreciation_amortisation + finance_costs - (trade_receivables + inventories - trade_payables) AS op,"
        " -(tangible_assets + intangible_assets + cwip) AS inv,"
        " long_term_borrowings + short_term_borrowings + share_capital AS fin FROM summary) x")
    q["financial_ratios"] = _with_summary(
        "SELECT Company_ID, ratio, value, status, risk_level FROM ("
        " SELECT Company_ID, 1 AS o, 'Profit Margin' AS ratio, profit_margin_pct AS value,"
        " CASE WHEN profit_margin_pct >= 15 THEN 'Strong' WHEN profit_margin_pct >= 5 THEN 'Moderate'"
        " WHEN profit_margin_pct >= 0 THEN 'Weak' ELSE 'Loss' END AS status, profit_margin_pct AS pm, current_ratio AS cr FROM ratios"
        " UNION ALL SELECT Company_ID, 2, 'Expense Ratio', expense_ratio,"
        " CASE WHEN expense_ratio * 100 > 90 THEN 'High' WHEN expense_ratio * 100 > 80 THEN 'Elevated' ELSE 'Efficient' END,"
        " profit_margin_pct, current_ratio FROM ratios"
        " UNION ALL SELECT Company_ID, 3, 'Debt-to-Equity', debt_to_equity,"
        " CASE WHEN debt_to_equity > 2 THEN 'High Leverage' WHEN debt_to_equity > 1 THEN 'Moderate' ELSE 'Low Leverage' END,"
        " profit_margin_pct, current_ratio FROM ratios"
        " UNION ALL SELECT Company_ID, 4, 'Current Ratio', current_ratio,"
        " CASE WHEN current_ratio < 1 THEN 'Liquidity Concern' WHEN current_ratio >= 1.5 THEN 'Healthy' ELSE 'Borderline' END,"
        " profit_margin_pct, current_ratio FROM ratios) r"
        " CROSS JOIN LATERAL (SELECT CASE WHEN pm < 5 OR cr < 1 THEN 'High' WHEN pm < 15 THEN 'Moderate' ELSE 'Low' END"
        " AS risk_level) k")
    q["exec_kpis"] = _with_summary(
        "SELECT Company_ID, CAST(total_income AS DOUBLE) AS total_revenue, CAST(total_expense AS DOUBLE) AS total_expenses,"
        " CAST(ABS(net_profit_loss) AS DOUBLE) AS net_result_abs,"
        " CASE WHEN net_profit_loss >= 0 THEN 'Profit' ELSE 'Loss' END AS net_result_kind,"
        " profit_margin_pct, expense_ratio * 100 AS expense_ratio_pct, "
        f"{HEALTH_SQL} AS health, CAST(gst_payable AS DOUBLE) AS net_gst_payable, asset_cover,"
        " CASE WHEN asset_cover < 1 THEN 'Insufficient cash cover against current liabilities'"
        " WHEN profit_margin_pct < 5 THEN 'Critically low profit margin — profitability at risk'"
        " WHEN profit_margin_pct < 15 THEN 'Moderate margin leaves limited downside buffer'"
        " ELSE 'No material financial risk identified at this time' END AS key_risk,"
        " CASE WHEN asset_cover > 1.5 THEN 'Strong asset cover ratio'"
        " WHEN profit_margin_pct > 0 THEN 'Positive operating profitability maintained'"
        " ELSE 'Revenue base is established — focus required on cost management' END AS key_strength FROM ratios")
    recs = [("profit_margin_pct < 5", "Profit Margin Improvement"), ("expense_ratio > 0.85", "Expense Rationalisation"),
            ("current_ratio < 1.2", "Working Capital Management"), ("total_income > 10000000", "Statutory Tax Audit"),
            ("TRUE", "GST Compliance"), ("TRUE", "Cash Payment Controls"), ("TRUE", "TDS & Advance Tax"),
            ("long_term_borrowings > shareholders_funds * 2", "Debt Restructuring")]
    union = " UNION ALL ".join(f"SELECT Company_ID, {i} AS o, '{t}' AS title FROM ratios WHERE {c}"
                               for i, (c, t) in enumerate(recs))
    q["recommendations"] = _with_summary(
        f"SELECT Company_ID, CAST(ROW_NUMBER() OVER (PARTITION BY Company_ID ORDER BY o) AS INTEGER) AS rec_no, title"
        f" FROM ({union}) r")
    return q


# --------------------------------------------------------------------------------------------
# cleaning / quality (ledger_dirty)
# --------------------------------------------------------------------------------------------
from ..schema import LEDGER_COLUMNS  # noqa: E402

VALID = "('Expense', 'Income', 'Asset', 'Liability')"
PRESENT_COLS = ("Company_ID, strftime(Date, '%Y-%m-%d') AS Date, Description, CAST(Amount AS DOUBLE) AS Amount, "
                "Transaction_Type, Category, Sub_Category, Schedule_III_Head, GST_Percentage, "
                "CAST(GST_Amount AS DOUBLE) AS GST_Amount, Payment_Mode, Vendor_Client_Name")


def _iqr_cte(src: str) -> str:
    return (f"thr AS (SELECT Company_ID, q1p, q3p, q3p + 3.0 * (q3p - q1p) AS tp, n_nonnull, n_rows FROM ("
            f" SELECT Company_ID, quantile_cont(CAST(Amount * 100 AS DOUBLE), 0.25) AS q1p,"
            f" quantile_cont(CAST(Amount * 100 AS DOUBLE), 0.75) AS q3p, COUNT(Amount) AS n_nonnull,"
            f" COUNT(*) AS n_rows FROM {src} WHERE Company_ID IS NOT NULL GROUP BY Company_ID) q)")


def quality_sql() -> dict[str, str]:
    q = {}
    q["clean_ledger"] = with_ledger(f"""
WITH dd AS (SELECT DISTINCT * FROM ledger_dirty),
med AS (SELECT Company_ID, CAST(CAST(CAST(FLOOR(quantile_cont(CAST(Amount * 100 AS DOUBLE), 0.5) + 0.5) AS BIGINT)
          AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS m FROM dd GROUP BY Company_ID),
f AS (SELECT dd.*, COALESCE(dd.Amount, med.m) AS amt FROM dd LEFT JOIN med ON dd.Company_ID = med.Company_ID)
SELECT Company_ID, strftime(Date, '%Y-%m-%d') AS Date, COALESCE(Description, 'unknown transaction') AS Description,
       CAST(amt AS DOUBLE) AS Amount, Transaction_Type, Category, Sub_Category, Schedule_III_Head, GST_Percentage,
       CAST(GST_Amount AS DOUBLE) AS GST_Amount, COALESCE(Payment_Mode, 'Bank Transfer') AS Payment_Mode,
       COALESCE(Vendor_Client_Name, 'unknown') AS Vendor_Client_Name
FROM f WHERE NOT COALESCE(amt < 0, FALSE)""", dirty=True)
    parts = [f"SELECT Company_ID, '{c}' AS column_name, COUNT_IF({c} IS NULL) AS null_count, COUNT(*) AS rows "
             f"FROM ledger_dirty WHERE Company_ID IS NOT NULL GROUP BY Company_ID" for c in LEDGER_COLUMNS]
    q["null_profile"] = with_ledger(
        "SELECT Company_ID, column_name, null_count, rows, 100.0 - CAST(null_count AS DOUBLE) / CAST(rows AS DOUBLE)"
        " * 100.0 AS completeness_pct FROM (" + " UNION ALL ".join(parts) + ") p", dirty=True)
    nulls = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in LEDGER_COLUMNS)
    ncols = len(LEDGER_COLUMNS)
    checks = f"""
src AS (SELECT * FROM ledger_dirty WHERE Company_ID IS NOT NULL),
chk AS (SELECT Company_ID, COUNT(*) AS rows, CAST(SUM({nulls}) AS BIGINT) AS missing_cells,
          COUNT_IF(Amount < 0) AS negatives, COUNT_IF(Amount = 0) AS zeros, COUNT(Amount) AS amounts,
          COUNT_IF(NOT COALESCE(Category IN {VALID}, FALSE)) AS unknown,
          MIN(Date) AS min_date, MAX(Date) AS max_date
        FROM src GROUP BY Company_ID),
dup AS (SELECT Company_ID, CAST(SUM(c - 1) AS BIGINT) AS duplicates
        FROM (SELECT Company_ID, COUNT(*) AS c FROM src GROUP BY {", ".join(LEDGER_COLUMNS)}) g GROUP BY Company_ID),
r AS (SELECT chk.*, COALESCE(dup.duplicates, 0) AS dups,
        ((((CAST(missing_cells AS DOUBLE) * 0.5) + CAST(COALESCE(dup.duplicates, 0) AS DOUBLE) * 1.0)
          + CAST(negatives AS DOUBLE) * 0.5) + CAST(zeros AS DOUBLE) * 0.2) + CAST(unknown AS DOUBLE) * 1.0 AS penalty
      FROM chk LEFT JOIN dup ON chk.Company_ID = dup.Company_ID)"""
    score = "GREATEST(0, 100 - CAST(FLOOR(penalty) AS BIGINT))"
    q["quality_report"] = with_ledger(f"""WITH {checks}
SELECT Company_ID, rows, {ncols} AS columns, missing_cells,
       ROUND(CAST(missing_cells AS DOUBLE) / CAST(rows * {ncols} AS DOUBLE) * 100.0, 2) AS missing_pct,
       100.0 - CAST(missing_cells AS DOUBLE) / CAST(rows * {ncols} AS DOUBLE) * 100.0 AS completeness_pct,
       CAST(dups AS BIGINT) AS duplicates, negatives, zeros, unknown,
       CAST({score} AS INTEGER) AS quality_score,
       CAST(GREATEST(0, 100 - CAST(FLOOR(penalty * 1000.0 / CAST(rows AS DOUBLE)) AS BIGINT)) AS INTEGER) AS score_per_1k,
       CASE WHEN {score} >= 80 THEN 'high' WHEN {score} >= 60 THEN 'moderate' ELSE 'poor' END AS quality_band
FROM r""", dirty=True)
    q["quality_issues"] = with_ledger(f"""WITH {checks},
{_iqr_cte("src")},
outl AS (SELECT s.Company_ID, COUNT(*) AS outliers FROM src s JOIN thr ON s.Company_ID = thr.Company_ID
         WHERE thr.n_nonnull > 10 AND CAST(s.Amount * 100 AS DOUBLE) > thr.tp GROUP BY s.Company_ID),
k AS (SELECT r.*, COALESCE(outl.outliers, 0) AS outs FROM r LEFT JOIN outl ON r.Company_ID = outl.Company_ID),
iss AS (
  SELECT Company_ID, 1 AS o, 'Missing Values' AS issue_type, 'warning' AS severity, missing_cells AS n FROM k WHERE missing_cells > 0
  UNION ALL SELECT Company_ID, 2, 'Duplicate Entries', 'critical', dups FROM k WHERE dups > 0
  UNION ALL SELECT Company_ID, 3, 'Negative Transaction Amounts', 'warning', negatives FROM k WHERE negatives > 0
  UNION ALL SELECT Company_ID, 4, 'Zero-Value Transactions', 'info', zeros FROM k WHERE zeros > 0
  UNION ALL SELECT Company_ID, 5, 'Statistical Outliers (Large Transactions)', 'warning', outs FROM k WHERE outs > 0
  UNION ALL SELECT Company_ID, 6, 'Unrecognised Category Values', 'critical', unknown FROM k WHERE unknown > 0
  UNION ALL SELECT Company_ID, 7, 'No Issues Detected', 'info', 0 FROM k
    WHERE missing_cells = 0 AND dups = 0 AND negatives = 0 AND zeros = 0 AND outs = 0 AND unknown = 0)
SELECT Company_ID, CAST(ROW_NUMBER() OVER (PARTITION BY Company_ID ORDER BY o) - 1 AS INTEGER) AS seq,
       issue_type, severity, CAST(n AS BIGINT) AS n FROM iss""", dirty=True)
    q["negative_by_category"] = with_ledger(
        "SELECT Company_ID, Category AS category, COUNT(*) AS n FROM ledger_dirty WHERE Amount < 0"
        " AND Company_ID IS NOT NULL AND Category IS NOT NULL GROUP BY 1, 2", dirty=True)
    q["unknown_categories"] = with_ledger(
        f"SELECT Company_ID, Category AS category, COUNT(*) AS n FROM ledger_dirty"
        f" WHERE NOT COALESCE(Category IN {VALID}, FALSE) AND Company_ID IS NOT NULL GROUP BY 1, 2", dirty=True)
    q["preview_metrics"] = with_ledger(f"""WITH {checks}
SELECT Company_ID, rows, {ncols} AS columns, strftime(min_date, '%Y-%m-%d') AS min_date,
       strftime(max_date, '%Y-%m-%d') AS max_date, missing_cells AS total_nulls FROM chk""", dirty=True)
    q["dataset_overview"] = with_ledger(
        f"SELECT Company_ID, COUNT(*) AS rows, {ncols} AS columns, COUNT_IF(Category = 'Expense') AS n_expense,"
        " COUNT_IF(Category = 'Income') AS n_income, COUNT_IF(Category = 'Asset') AS n_asset,"
        " COUNT_IF(Category = 'Liability') AS n_liability FROM ledger WHERE Company_ID IS NOT NULL GROUP BY 1")
    return q


# --------------------------------------------------------------------------------------------
# scalar text functions
# --------------------------------------------------------------------------------------------
def _inr_sql(x: str) -> str:
    v = f"CAST({x} AS DECIMAL(20,2))"
    txt = f"CAST(ABS({v}) AS VARCHAR)"
    ip = f"split_part({txt}, '.', 1)"
    dp = f"split_part({txt}, '.', 2)"
    head = f"substr({ip}, 1, length({ip}) - 3)"
    grouped = f"reverse(regexp_replace(regexp_replace(reverse({head}), '(\\d{{2}})', '\\1,', 'g'), ',$', ''))"
    body = f"CASE WHEN length({ip}) > 3 THEN {grouped} || ',' || right({ip}, 3) ELSE {ip} END"
    return (f"CASE WHEN {v} IS NOT NULL THEN '₹' || CASE WHEN {v} < 0 THEN '-' ELSE '' END || {body} || '.' || {dp}"
            f" END")


def text_sql() -> dict[str, str]:
    from ..functions.text import EDGE_SPACE_PATTERN, EMOJI_PATTERN, KEYWORD_RULES
    q = {}
    kw = " ".join(f"WHEN regexp_matches(COALESCE(Description, ''), '(?i){p}') THEN '{c}'" for p, c in KEYWORD_RULES)
    inr = _inr_sql("Amount")
    q["ledger_text"] = with_ledger(
        "SELECT Company_ID, Description, CAST(Amount AS DOUBLE) AS Amount,"
        " COALESCE(TRIM(regexp_replace(lower(Description), '[^a-z0-9]+', ' ', 'g')), 'unknown') AS description_clean,"
        f" CASE {kw} ELSE CASE WHEN Amount > 500000 THEN 'Asset' ELSE 'Expense' END END AS keyword_category,"
        f" {inr} AS amount_inr, replace({inr}, '₹', 'Rs. ') AS amount_inr_plain FROM ledger")
    q["ledger_features"] = with_ledger(
        "SELECT Company_ID, strftime(Date, '%Y-%m-%d') AS Date, Category, CAST(Amount AS DOUBLE) AS Amount,"
        " CAST(COALESCE(month(Date), 1) AS INTEGER) AS month,"
        " CAST(COALESCE(isodow(Date) IN (6, 7), FALSE) AS INTEGER) AS is_weekend,"
        " 'FY ' || CAST(fy AS VARCHAR) || '-' || right(CAST(fy + 1 AS VARCHAR), 2) AS fiscal_year,"
        " CASE Category WHEN 'Expense' THEN 0 WHEN 'Income' THEN 1 WHEN 'Asset' THEN 2 WHEN 'Liability' THEN 3 END"
        " AS category_enc,"
        " CASE WHEN Category IN ('Expense', 'Asset') THEN 'Debit' ELSE 'Credit' END AS transaction_type"
        " FROM (SELECT *, CAST(CASE WHEN month(Date) >= 4 THEN year(Date) ELSE year(Date) - 1 END AS INTEGER) AS fy"
        " FROM ledger) l")
    q["documents_clean_text"] = (
        "SELECT doc_id, COALESCE(TRIM(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 'unknown') AS text_clean"
        " FROM documents")
    q["documents_strip_emoji"] = (
        f"SELECT doc_id, regexp_replace(regexp_replace(text, '{EMOJI_PATTERN}', '', 'g'), '{EDGE_SPACE_PATTERN}', '',"
        f" 'g') AS text_stripped FROM documents")
    return q


# --------------------------------------------------------------------------------------------
# rules
# --------------------------------------------------------------------------------------------
def _esc(s: str) -> str:
    return s.replace("'", "''")


def rules_sql() -> dict[str, str]:
    from ..sources.rules import load_rules
    rules = load_rules()
    parts = [f"SELECT Company_ID, {i} AS rule_order, '{_esc(r.rule_name)}' AS rule_name, '{_esc(r.severity)}' AS severity,"
             f" '{_esc(r.section)}' AS section, '{_esc(r.message)}' AS message,"
             f" COUNT_IF(COALESCE({r.condition}, FALSE)) AS count,"
             f" CAST(SUM(CASE WHEN COALESCE({r.condition}, FALSE) THEN Amount END) AS DOUBLE) AS total_amount"
             f" FROM ledger WHERE Company_ID IS NOT NULL GROUP BY Company_ID"
             f" HAVING COUNT_IF(COALESCE({r.condition}, FALSE)) > 0" for i, r in enumerate(rules)]
    hits = [f"SELECT Company_ID, strftime(Date, '%Y-%m-%d') AS Date, Description, CAST(Amount AS DOUBLE) AS Amount,"
            f" Payment_Mode, Category, Sub_Category, '{_esc(r.rule_name)}' AS rule_name,"
            f" '{_esc(r.severity)}' AS severity, '{_esc(r.section)}' AS section"
            f" FROM ledger WHERE COALESCE({r.condition}, FALSE)" for r in rules]
    return {"rule_violations": with_ledger(" UNION ALL ".join(parts)),
            "rule_hits": with_ledger(" UNION ALL ".join(hits))}


# --------------------------------------------------------------------------------------------
# roll-ups
# --------------------------------------------------------------------------------------------
def rollup_sql() -> dict[str, str]:
    from ..operators.rollups import RANK_NOTES
    q = {}
    base = "FROM ledger WHERE Company_ID IS NOT NULL"
    q["category_totals"] = with_ledger(
        "SELECT Company_ID, category, CAST(a AS DOUBLE) AS amount,"
        " CAST(a AS DOUBLE) / CAST(SUM(a) OVER (PARTITION BY Company_ID) AS DOUBLE) * 100 AS share_pct FROM ("
        f" SELECT Company_ID, Category AS category, COALESCE(SUM(Amount), 0) AS a {base} AND Category IS NOT NULL"
        " GROUP BY 1, 2) g")
    q["category_distribution"] = with_ledger(
        "SELECT Company_ID, category, n,"
        " CAST(n AS DOUBLE) / CAST(SUM(n) OVER (PARTITION BY Company_ID) AS DOUBLE) * 100 AS pct FROM ("
        f" SELECT Company_ID, Category AS category, COUNT(*) AS n {base} AND Category IS NOT NULL GROUP BY 1, 2) g")
    notes = " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(RANK_NOTES))
    q["top_expense_heads"] = with_ledger(f"""
WITH e AS (SELECT * {base} AND Category = 'Expense'),
te AS (SELECT Company_ID, COALESCE(SUM(Amount), 0) AS te FROM e GROUP BY 1),
g AS (SELECT Company_ID, Sub_Category, COALESCE(SUM(Amount), 0) AS a FROM e WHERE Sub_Category IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Company_ID ORDER BY a DESC, Sub_Category ASC) AS rk FROM g)
SELECT r.Company_ID, CAST(rk AS INTEGER) AS rank, Sub_Category AS sub_category, CAST(a AS DOUBLE) AS amount,
       CASE WHEN te > 0 THEN CAST(a AS DOUBLE) / CAST(te AS DOUBLE) * 100 ELSE 0.0 END AS pct_of_expense,
       CASE rk {notes} END AS note
FROM r JOIN te ON r.Company_ID = te.Company_ID WHERE rk <= 3""")
    q["monthly_trend"] = with_ledger(
        "SELECT Company_ID, strftime(Date, '%Y-%m') AS month, Category AS category,"
        f" CAST(COALESCE(SUM(Amount), 0) AS DOUBLE) AS amount {base} AND Date IS NOT NULL"
        " AND Category IN ('Income', 'Expense') GROUP BY 1, 2, 3")
    q["payment_mode_totals"] = with_ledger(
        "SELECT Company_ID, Payment_Mode AS payment_mode, CAST(COALESCE(SUM(Amount), 0) AS DOUBLE) AS amount,"
        f" COUNT(*) AS n {base} AND Payment_Mode IS NOT NULL GROUP BY 1, 2")
    q["gst_slab_totals"] = with_ledger(
        "SELECT Company_ID, GST_Percentage AS slab, CAST(COALESCE(SUM(GST_Amount), 0) AS DOUBLE) AS gst_amount,"
        f" COUNT(*) AS n {base} AND GST_Percentage > 0 GROUP BY 1, 2")
    q["flow_edges"] = with_ledger(f"""
WITH cs AS (SELECT Company_ID, Category AS source, Sub_Category AS target, COALESCE(SUM(Amount), 0) AS v {base}
            AND Category IS NOT NULL AND Sub_Category IS NOT NULL GROUP BY 1, 2, 3),
sub AS (SELECT Company_ID, Sub_Category AS source, COALESCE(SUM(Amount), 0) AS a, COALESCE(SUM(GST_Amount), 0) AS g
        {base} AND Sub_Category IS NOT NULL GROUP BY 1, 2)
SELECT Company_ID, 'category_sub' AS kind, source, target, CAST(v AS DOUBLE) AS value FROM cs WHERE v > 0
UNION ALL SELECT Company_ID, 'sub_gst', source, 'GST Total', CAST(g AS DOUBLE) FROM sub WHERE g > 0
UNION ALL SELECT Company_ID, 'sub_net', source, 'Net Total', CAST(GREATEST(0, a - g) AS DOUBLE) FROM sub
  WHERE GREATEST(0, a - g) > 0""")
    nodes = []
    for kind, col, lo, hi in (("category", "Category", 12, 55), ("sub_category", "Sub_Category", 8, 36),
                              ("payment_mode", "Payment_Mode", 8, 30)):
        nodes.append(f"""SELECT Company_ID, '{kind}' AS kind, node, CAST(a AS DOUBLE) AS amount,
  CASE WHEN mx = mn THEN CAST({(lo + hi) / 2} AS DOUBLE)
       ELSE CAST({lo} AS DOUBLE) + CAST({hi - lo} AS DOUBLE) * (CAST(a AS DOUBLE) - mn) / (mx - mn) END AS size
FROM (SELECT *, CAST(MIN(a) OVER (PARTITION BY Company_ID) AS DOUBLE) AS mn,
             CAST(MAX(a) OVER (PARTITION BY Company_ID) AS DOUBLE) AS mx
      FROM (SELECT Company_ID, {col} AS node, COALESCE(SUM(Amount), 0) AS a {base} AND {col} IS NOT NULL
            GROUP BY 1, 2) g) w""")
    q["network_nodes"] = with_ledger(" UNION ALL ".join(nodes))
    q["network_edges"] = with_ledger(
        "SELECT Company_ID, Category AS source, Sub_Category AS target,"
        f" CAST(COALESCE(SUM(Amount), 0) AS DOUBLE) AS amount, 'category_sub' AS kind {base}"
        " AND Category IS NOT NULL AND Sub_Category IS NOT NULL GROUP BY 1, 2, 3"
        " UNION ALL SELECT Company_ID, Sub_Category, Payment_Mode, CAST(COALESCE(SUM(Amount), 0) AS DOUBLE),"
        f" 'sub_mode' {base} AND Sub_Category IS NOT NULL AND Payment_Mode IS NOT NULL GROUP BY 1, 2, 3")
    q["spend_hierarchy"] = with_ledger(f"""
WITH lv AS (SELECT Company_ID, Category AS cat, Sub_Category AS sub, Payment_Mode AS mode,
                   COALESCE(SUM(Amount), 0) AS a, COALESCE(SUM(GST_Amount), 0) AS g {base}
            AND Category IS NOT NULL AND Sub_Category IS NOT NULL AND Payment_Mode IS NOT NULL GROUP BY 1, 2, 3, 4),
l AS (SELECT * FROM lv WHERE a > 0),
tot AS (SELECT Company_ID, SUM(a) AS t FROM l GROUP BY 1),
u AS (
  SELECT Company_ID, 1 AS level, cat AS id, '' AS parent, cat AS label, SUM(a) AS a, SUM(g) AS g FROM l GROUP BY 1, cat
  UNION ALL SELECT Company_ID, 2, cat || '|' || sub, cat, sub, SUM(a), SUM(g) FROM l GROUP BY 1, cat, sub
  UNION ALL SELECT Company_ID, 3, cat || '|' || sub || '|' || mode, cat || '|' || sub, mode, a, g FROM l)
SELECT u.Company_ID, level, id, parent, label, CAST(a AS DOUBLE) AS amount, CAST(g AS DOUBLE) AS gst_amount,
  CASE WHEN level = 3 THEN LEAST(1.0, GREATEST(0.0, CASE WHEN a <> 0 THEN CAST(g AS DOUBLE) / CAST(a AS DOUBLE) ELSE 0.0 END))
       ELSE CASE WHEN a <> 0 THEN CAST(g AS DOUBLE) / CAST(a AS DOUBLE) ELSE 0.0 END END AS gst_ratio,
  CASE WHEN level = 3 THEN ROUND(CAST(a AS DOUBLE) / CAST(t AS DOUBLE) * 100, 2) END AS pct
FROM u JOIN tot ON u.Company_ID = tot.Company_ID""")
    return q


# --------------------------------------------------------------------------------------------
# trends and anomalies
# --------------------------------------------------------------------------------------------
FY_SUMS = """fy AS (SELECT Company_ID, fy_start, COALESCE(SUM(CASE WHEN Category = 'Income' THEN Amount END), 0) AS revenue,
              COALESCE(SUM(CASE WHEN Category = 'Expense' THEN Amount END), 0) AS expense, COUNT(*) AS rows,
              COALESCE(SUM(Amount), 0) AS amount
       FROM (SELECT *, CAST(CASE WHEN month(Date) >= 4 THEN year(Date) ELSE year(Date) - 1 END AS INTEGER) AS fy_start
             FROM ledger WHERE Date IS NOT NULL AND Company_ID IS NOT NULL) d GROUP BY 1, 2)"""


def _fyl(c: str) -> str:
    return f"'FY ' || CAST({c} AS VARCHAR) || '-' || right(CAST({c} + 1 AS VARCHAR), 2)"


def _growth_sql(c: str, p: str) -> str:
    return f"CASE WHEN ({p}) <> 0 THEN ROUND(CAST(({c}) - ({p}) AS DOUBLE) / CAST(({p}) AS DOUBLE) * 100, 2) END"


YOY = f"""yoy AS (SELECT Company_ID, n_fy >= 2 AS available, {_fyl("fy_start")} AS curr_fy,
   CASE WHEN n_fy >= 2 THEN {_fyl("prev_start")} END AS prev_fy,
   CASE WHEN n_fy >= 2 THEN CAST(revenue AS DOUBLE) END AS current_revenue,
   CASE WHEN n_fy >= 2 THEN CAST(prev_revenue AS DOUBLE) END AS previous_revenue,
   CASE WHEN n_fy >= 2 THEN {_growth_sql("revenue", "prev_revenue")} END AS revenue_growth_pct,
   CASE WHEN n_fy >= 2 THEN CAST(expense AS DOUBLE) END AS current_expense,
   CASE WHEN n_fy >= 2 THEN CAST(prev_expense AS DOUBLE) END AS previous_expense,
   CASE WHEN n_fy >= 2 THEN {_growth_sql("expense", "prev_expense")} END AS expense_growth_pct,
   CASE WHEN n_fy >= 2 THEN CAST(revenue - expense AS DOUBLE) END AS current_profit,
   CASE WHEN n_fy >= 2 THEN CAST(prev_revenue - prev_expense AS DOUBLE) END AS previous_profit,
   CASE WHEN n_fy >= 2 THEN {_growth_sql("revenue - expense", "prev_revenue - prev_expense")} END AS profit_growth_pct,
   CASE WHEN n_fy >= 2 THEN CASE WHEN {_growth_sql("revenue - expense", "prev_revenue - prev_expense")} > 5 THEN 'Improving'
        WHEN {_growth_sql("revenue - expense", "prev_revenue - prev_expense")} < -5 THEN 'Declining' ELSE 'Stable' END END
     AS trend
 FROM (SELECT *, LAG(fy_start) OVER w AS prev_start, LAG(revenue) OVER w AS prev_revenue,
              LAG(expense) OVER w AS prev_expense,
              ROW_NUMBER() OVER (PARTITION BY Company_ID ORDER BY fy_start DESC) AS rn,
              COUNT(*) OVER (PARTITION BY Company_ID) AS n_fy
       FROM fy WINDOW w AS (PARTITION BY Company_ID ORDER BY fy_start)) x WHERE rn = 1)"""


def trend_sql() -> dict[str, str]:
    q = {}
    q["fiscal_year_totals"] = with_ledger(
        f"WITH {FY_SUMS} SELECT Company_ID, {_fyl('fy_start')} AS fiscal_year, fy_start, rows,"
        " CAST(amount AS DOUBLE) AS amount, CAST(revenue AS DOUBLE) AS revenue, CAST(expense AS DOUBLE) AS expense"
        " FROM fy")
    q["yoy_comparison"] = with_ledger(f"WITH {FY_SUMS},\n{YOY}\nSELECT * FROM yoy")
    q["statistical_anomalies"] = with_ledger(f"""WITH {_iqr_cte("ledger")},
o AS (SELECT l.Company_ID, COUNT(*) AS cnt, SUM(l.Amount) AS tot, MAX(l.Amount) AS mx FROM ledger l
      JOIN thr ON l.Company_ID = thr.Company_ID WHERE CAST(l.Amount * 100 AS DOUBLE) > thr.tp GROUP BY 1)
SELECT thr.Company_ID, n_nonnull >= 10 AS available,
  CASE WHEN n_nonnull >= 10 THEN q1p / 100.0 END AS q1, CASE WHEN n_nonnull >= 10 THEN q3p / 100.0 END AS q3,
  CASE WHEN n_nonnull >= 10 THEN (q3p - q1p) / 100.0 END AS iqr,
  CASE WHEN n_nonnull >= 10 THEN tp / 100.0 END AS threshold,
  CAST(CASE WHEN n_nonnull >= 10 THEN COALESCE(cnt, 0) ELSE 0 END AS BIGINT) AS count,
  CAST(CASE WHEN n_nonnull >= 10 THEN COALESCE(tot, 0) ELSE 0 END AS DOUBLE) AS total_amount,
  CAST(CASE WHEN n_nonnull >= 10 THEN mx END AS DOUBLE) AS max_amount, n_nonnull
FROM thr LEFT JOIN o ON thr.Company_ID = o.Company_ID""")
    q["iqr_outliers"] = with_ledger(f"""WITH {_iqr_cte("ledger")}
SELECT l.Company_ID, strftime(Date, '%Y-%m-%d') AS Date, Description, CAST(Amount AS DOUBLE) AS Amount,
  Transaction_Type, Category, Sub_Category, Schedule_III_Head, GST_Percentage, CAST(GST_Amount AS DOUBLE) AS GST_Amount,
  Payment_Mode, Vendor_Client_Name, thr.tp / 100.0 AS threshold
FROM ledger l JOIN thr ON l.Company_ID = thr.Company_ID
WHERE thr.n_nonnull >= 10 AND CAST(l.Amount * 100 AS DOUBLE) > thr.tp""")
    q["top_outliers"] = with_ledger(f"""WITH {_iqr_cte("ledger")},
o AS (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l.Company_ID ORDER BY Amount DESC, Date ASC NULLS LAST,
        Description ASC NULLS LAST, Category ASC NULLS LAST, Payment_Mode ASC NULLS LAST) AS rk
      FROM ledger l JOIN thr ON l.Company_ID = thr.Company_ID
      WHERE thr.n_rows > 10 AND CAST(l.Amount * 100 AS DOUBLE) > thr.tp)
SELECT Company_ID, CAST(rk AS INTEGER) AS rank, strftime(Date, '%Y-%m-%d') AS Date, substr(Description, 1, 40) AS Description,
  CAST(Amount AS DOUBLE) AS Amount, substr(Category, 1, 40) AS Category, substr(Payment_Mode, 1, 40) AS Payment_Mode
FROM o WHERE rk <= 10""")
    return q


# --------------------------------------------------------------------------------------------
# insights
# --------------------------------------------------------------------------------------------
def insight_sql() -> dict[str, str]:
    from ..operators.insights import BLOCKED_ITC_SUBCATEGORIES
    blocked = ", ".join(f"'{b}'" for b in BLOCKED_ITC_SUBCATEGORIES)
    ctes = summary_ctes() + f""",
x AS (SELECT Company_ID, COUNT(*) AS n_rows,
        COUNT_IF(Category = 'Expense' AND Payment_Mode = 'Cash' AND Amount > 10000) AS s40_n,
        COALESCE(SUM(CASE WHEN Category = 'Expense' AND Payment_Mode = 'Cash' AND Amount > 10000 THEN Amount END), 0) AS s40_amt,
        COUNT_IF(Payment_Mode = 'Cash' AND Amount >= 200000) AS s269_n,
        COALESCE(SUM(CASE WHEN Payment_Mode = 'Cash' AND Amount >= 200000 THEN Amount END), 0) AS s269_amt,
        COALESCE(SUM(CASE WHEN COALESCE(regexp_matches(Sub_Category, '(?i)Professional|Legal|Audit'), FALSE) THEN Amount END), 0) AS prof_total,
        COALESCE(SUM(CASE WHEN COALESCE(regexp_matches(Sub_Category, '(?i)Contract|Labour'), FALSE) THEN Amount END), 0) AS contr_total,
        COALESCE(SUM(CASE WHEN Sub_Category IN ({blocked}) THEN GST_Amount END), 0) AS blocked_gst
      FROM ledger WHERE Company_ID IS NOT NULL GROUP BY 1),
{_iqr_cte("ledger")},
o AS (SELECT l.Company_ID, COUNT(*) AS out_n, MAX(l.Amount) AS out_max FROM ledger l JOIN thr ON l.Company_ID = thr.Company_ID
      WHERE CAST(l.Amount * 100 AS DOUBLE) > thr.tp GROUP BY 1),
k AS (SELECT summary.*, x.n_rows AS rows_all, x.s40_n, x.s40_amt, x.s269_n, x.s269_amt, x.prof_total, x.contr_total,
             x.blocked_gst, thr.tp / 100.0 AS threshold, COALESCE(o.out_n, 0) AS out_n, o.out_max,
             CAST(total_expense AS DOUBLE) / CAST(total_income AS DOUBLE) AS exp_ratio,
             CAST(gst_payable AS DOUBLE) / CAST(total_income AS DOUBLE) AS gst_ratio,
             CAST(total_liabilities AS DOUBLE) / CAST(total_assets AS DOUBLE) AS lev
      FROM summary JOIN x ON summary.Company_ID = x.Company_ID JOIN thr ON summary.Company_ID = thr.Company_ID
      LEFT JOIN o ON summary.Company_ID = o.Company_ID),
e AS (SELECT * FROM ledger WHERE Company_ID IS NOT NULL AND Category = 'Expense'),
te AS (SELECT Company_ID, COALESCE(SUM(Amount), 0) AS te FROM e GROUP BY 1),
hg AS (SELECT Company_ID, Sub_Category, COALESCE(SUM(Amount), 0) AS a FROM e WHERE Sub_Category IS NOT NULL GROUP BY 1, 2),
hr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Company_ID ORDER BY a DESC, Sub_Category ASC) AS rk FROM hg),
ins AS (
  SELECT Company_ID, 10 AS seq, 'net_result' AS code, 'info' AS level, 'Profitable Period' AS title,
         CAST(net_profit_loss AS DOUBLE) AS amount, profit_margin_pct AS value, CAST(NULL AS BIGINT) AS n
    FROM k WHERE net_profit_loss > 0
  UNION ALL SELECT Company_ID, 10, 'net_result', 'critical', 'Net Loss Recorded', CAST(ABS(net_profit_loss) AS DOUBLE),
         profit_margin_pct, NULL FROM k WHERE net_profit_loss <= 0
  UNION ALL SELECT Company_ID, 20, 'margin_band', 'info', 'Strong Profit Margin', NULL, profit_margin_pct, NULL
    FROM k WHERE profit_margin_pct >= 15
  UNION ALL SELECT Company_ID, 20, 'margin_band', 'warning', 'Moderate Profit Margin', NULL, profit_margin_pct, NULL
    FROM k WHERE profit_margin_pct < 15 AND profit_margin_pct >= 5
  UNION ALL SELECT Company_ID, 20, 'margin_band', 'critical', 'Weak Profit Margin', NULL, profit_margin_pct, NULL
    FROM k WHERE profit_margin_pct < 5 AND profit_margin_pct >= 0
  UNION ALL SELECT Company_ID, 30, 'expense_ratio', 'warning', 'High Expense-to-Income Ratio', CAST(total_expense AS DOUBLE),
         exp_ratio * 100, NULL FROM k WHERE total_income > 0 AND exp_ratio >= 0.8
  UNION ALL SELECT Company_ID, 50, 'gst_liability', 'warning', 'Elevated GST Liability', CAST(gst_payable AS DOUBLE),
         gst_ratio * 100, NULL FROM k WHERE total_income > 0 AND gst_ratio > 0.15
  UNION ALL SELECT Company_ID, 50, 'gst_liability', 'info', 'GST Position', CAST(gst_payable AS DOUBLE),
         gst_ratio * 100, NULL FROM k WHERE total_income > 0 AND NOT gst_ratio > 0.15
  UNION ALL SELECT Company_ID, 60, 'large_txns', 'warning', 'Anomalous Large Transactions Detected',
         CAST(out_max AS DOUBLE), threshold, out_n FROM k WHERE rows_all > 10 AND out_n > 0
  UNION ALL SELECT Company_ID, 70, 's40a3_cash_expense', 'critical',
         '[TAX COMPLIANCE] Section 40A(3) — Cash Expenditure Assessment', CAST(s40_amt AS DOUBLE), NULL, s40_n
    FROM k WHERE s40_n > 0
  UNION ALL SELECT Company_ID, 75, 's269st_cash', 'critical',
         '[TAX COMPLIANCE] Section 269ST — Cash Receipts/Payments Exceeding Rs.2 Lakh', CAST(s269_amt AS DOUBLE), NULL,
         s269_n FROM k WHERE s269_n > 0
  UNION ALL SELECT Company_ID, 80, 's44ab_audit', 'warning', '[TAX COMPLIANCE] Tax Audit Threshold — Section 44AB',
         CAST(total_income AS DOUBLE), NULL, NULL FROM k WHERE total_income > 10000000
  UNION ALL SELECT Company_ID, 90, 'tds_26q', 'warning', '[TAX COMPLIANCE] TDS Obligation Check — Form 26Q',
         CAST(CASE WHEN prof_total >= 30000 THEN prof_total ELSE 0 END
              + CASE WHEN contr_total >= 100000 THEN contr_total ELSE 0 END AS DOUBLE), NULL,
         CAST(CAST(prof_total >= 30000 AS INTEGER) + CAST(contr_total >= 100000 AS INTEGER) AS BIGINT)
    FROM k WHERE prof_total >= 30000 OR contr_total >= 100000
  UNION ALL SELECT Company_ID, 100, 's208_advance_tax', 'info', '[TAX COMPLIANCE] Advance Tax Installments — Section 208',
         CAST(profit_before_tax * 0.25 AS DOUBLE), NULL, NULL FROM k
    WHERE profit_before_tax > 40000 AND CAST(profit_before_tax AS DOUBLE) * 0.25 >= 10000
  UNION ALL SELECT Company_ID, 110, 's17_5_blocked_itc', 'critical',
         '[TAX COMPLIANCE] Restricted Input Tax Credit — Section 17(5) CGST Act', CAST(blocked_gst AS DOUBLE), NULL, NULL
    FROM k WHERE blocked_gst > 0
  UNION ALL SELECT Company_ID, 120, 'leverage', 'warning', 'High Financial Leverage',
         CAST(total_assets - total_liabilities AS DOUBLE), lev, NULL FROM k
    WHERE total_liabilities > 0 AND total_assets > 0 AND lev > 2.0
  UNION ALL SELECT Company_ID, 120, 'leverage', 'info', 'Balance Sheet Position',
         CAST(total_assets - total_liabilities AS DOUBLE), lev, NULL FROM k
    WHERE total_liabilities > 0 AND total_assets > 0 AND NOT lev > 2.0
  UNION ALL SELECT hr.Company_ID, CAST(40 + rk AS INTEGER), 'major_head', 'info', 'Major Expenditure Head: ' || Sub_Category,
         CAST(a AS DOUBLE), CASE WHEN te > 0 THEN CAST(a AS DOUBLE) / CAST(te AS DOUBLE) * 100 ELSE 0.0 END, NULL
    FROM hr JOIN te ON hr.Company_ID = te.Company_ID WHERE rk <= 3)"""
    q = {}
    q["compliance_insights"] = with_ledger(f"WITH {ctes}\nSELECT * FROM ins")
    q["compliance_score"] = with_ledger(f"""WITH {ctes},
sc AS (SELECT Company_ID, COUNT_IF(level = 'critical') AS critical_count, COUNT_IF(level = 'warning') AS warning_count,
              COUNT_IF(level = 'info') AS info_count FROM ins GROUP BY 1),
s2c AS (SELECT *, CAST(critical_count * 5 + warning_count * 3 AS INTEGER) AS risk_score FROM sc),
s3c AS (SELECT *, CAST(GREATEST(0, 100 - risk_score) AS INTEGER) AS compliance_score FROM s2c)
SELECT *, CASE WHEN compliance_score >= 90 THEN 'A' WHEN compliance_score >= 75 THEN 'B' WHEN compliance_score >= 60
  THEN 'C' WHEN compliance_score >= 40 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN compliance_score >= 75 THEN 'green' WHEN compliance_score >= 50 THEN 'amber' ELSE 'red' END AS score_band
FROM s3c""")
    q["health_alerts"] = with_ledger(f"""WITH {summary_ctes()},
{FY_SUMS},
{YOY},
k AS (SELECT summary.*, yoy.available, COALESCE(yoy.revenue_growth_pct, 0.0) AS rg,
             COALESCE(yoy.expense_growth_pct, 0.0) AS eg,
             CAST(finance_costs AS DOUBLE) / CAST(total_expense AS DOUBLE) AS fc
      FROM summary LEFT JOIN yoy ON summary.Company_ID = yoy.Company_ID)
SELECT Company_ID, 1 AS seq, 'cost_escalation' AS code, 'warning' AS level, 'Cost Escalation Risk' AS title,
       CAST(NULL AS DOUBLE) AS amount, eg - rg AS value, CAST(NULL AS BIGINT) AS n
  FROM k WHERE COALESCE(available, FALSE) AND eg > rg AND eg > 0
UNION ALL SELECT Company_ID, 2, 'finance_cost_burden', 'warning', 'High Finance Cost Burden',
       CAST(finance_costs AS DOUBLE), fc * 100, NULL FROM k WHERE total_expense > 0 AND fc > 0.15
UNION ALL SELECT Company_ID, 3, 'cash_vs_gst', 'critical', 'Cash Crunch vs GST Liability',
       CAST(gst_payable - cash_equivalents AS DOUBLE), NULL, NULL FROM k
  WHERE gst_payable > 0 AND cash_equivalents < gst_payable""")
    return q


def ml_io_sql() -> dict[str, str]:
    """Oracles for the round-trip / streaming queries (they must equal the batch results) and the
    deterministic feature tables."""
    q = {}
    q["read_ledgers"] = with_ledger(f"SELECT {PRESENT_COLS} FROM ledger")
    q["stream_clean_ledger"] = quality_sql()["clean_ledger"]
    q["stream_rule_hits"] = rules_sql()["rule_hits"]
    q["term_document_frequency"] = with_ledger("""
WITH d AS (SELECT COALESCE(TRIM(regexp_replace(lower(COALESCE(Description, 'unknown transaction')), '[^a-z0-9]+', ' ',
             'g')), 'unknown') AS c FROM ledger),
t AS (SELECT list_filter(string_split(c, ' '), lambda w: length(w) >= 2) AS toks FROM d),
tm AS (SELECT list_concat(toks, CASE WHEN len(toks) >= 2 THEN
         list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END) AS terms FROM t),
tf AS (SELECT term, COUNT(*) AS tf FROM (SELECT unnest(terms) AS term FROM tm) x GROUP BY term),
dq AS (SELECT term, COUNT(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM tm) x GROUP BY term),
n AS (SELECT COUNT(*) AS n_docs FROM ledger),
j AS (SELECT tf.term, tf, df, n_docs FROM tf JOIN dq ON tf.term = dq.term CROSS JOIN n WHERE df >= 2),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY tf DESC, term ASC) AS rk FROM j)
SELECT term, tf, df, n_docs, ROUND(LN(CAST(n_docs + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + 1.0, 9) AS idf,
       CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 500""")
    q["tfidf_weights"] = with_ledger("""
WITH d AS (SELECT Company_ID, Description, COALESCE(TRIM(regexp_replace(lower(COALESCE(Description, 'unknown transaction')),
             '[^a-z0-9]+', ' ', 'g')), 'unknown') AS c, COUNT(*) AS n FROM ledger GROUP BY ALL),
t AS (SELECT *, list_filter(string_split(c, ' '), lambda w: length(w) >= 2) AS toks FROM d),
tm AS (SELECT *, list_concat(toks, CASE WHEN len(toks) >= 2 THEN
         list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END) AS terms FROM t),
u AS (SELECT Company_ID, Description, n, unnest(terms) AS term FROM tm),
k AS (SELECT Company_ID, Description, n, term, COUNT(*) AS tf FROM u GROUP BY ALL),
v AS (SELECT term, SUM(tf * n) AS tf, SUM(n) AS df FROM k GROUP BY term),
r AS (SELECT term, ROUND(LN(CAST((SELECT SUM(n) FROM d) + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + 1.0, 9) AS idf,
             ROW_NUMBER() OVER (ORDER BY tf DESC, term ASC) AS rk FROM v WHERE df >= 2),
w AS (SELECT Company_ID, Description, n, k.term, tf * idf AS w FROM k JOIN r ON k.term = r.term WHERE rk <= 500)
SELECT Company_ID, Description, n, term,
       ROUND(w / SQRT(SUM(w * w) OVER (PARTITION BY Company_ID, Description)), 9) AS weight FROM w""")
    q["feature_matrix"] = with_ledger(f"""
WITH d AS (SELECT COALESCE(TRIM(regexp_replace(lower(COALESCE(Description, 'unknown transaction')), '[^a-z0-9]+', ' ',
             'g')), 'unknown') AS c FROM ledger),
t AS (SELECT list_filter(string_split(c, ' '), lambda w: length(w) >= 2) AS toks FROM d),
tm AS (SELECT list_concat(toks, CASE WHEN len(toks) >= 2 THEN
         list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END) AS terms FROM t),
tf AS (SELECT term, COUNT(*) AS tf FROM (SELECT unnest(terms) AS term FROM tm) x GROUP BY term),
dq AS (SELECT term, COUNT(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM tm) x GROUP BY term),
r AS (SELECT tf.term, ROW_NUMBER() OVER (ORDER BY tf DESC, tf.term ASC) AS rk FROM tf JOIN dq ON tf.term = dq.term
      WHERE df >= 2),
vocab AS (SELECT list(term) AS v FROM r WHERE rk <= 500),
modes AS (SELECT payment_mode, ROW_NUMBER() OVER (ORDER BY payment_mode) - 1 AS mode_index FROM
          (SELECT DISTINCT COALESCE(Payment_Mode, 'Bank Transfer') AS payment_mode FROM ledger) m),
st AS (SELECT AVG(LN(1 + CAST(COALESCE(Amount, 0) AS DOUBLE))) AS mean,
              STDDEV_POP(LN(1 + CAST(COALESCE(Amount, 0) AS DOUBLE))) AS std FROM ledger),
rows_ AS (SELECT l.*, list_concat(toks, CASE WHEN len(toks) >= 2 THEN
            list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END) AS terms
          FROM (SELECT *, list_filter(string_split(COALESCE(TRIM(regexp_replace(lower(COALESCE(Description,
                  'unknown transaction')), '[^a-z0-9]+', ' ', 'g')), 'unknown'), ' '), lambda w: length(w) >= 2) AS toks
                FROM ledger) l)
SELECT Company_ID, Category,
       CAST(len(list_intersect(list_distinct(terms), (SELECT v FROM vocab))) AS INTEGER) AS nonzero,
       ROUND((LN(1 + CAST(COALESCE(Amount, 0) AS DOUBLE)) - st.mean) / st.std, 6) AS amount_scaled,
       CAST(modes.mode_index AS DOUBLE) AS mode_index,
       CAST(COALESCE(month(Date), 1) AS DOUBLE) AS month,
       CAST(COALESCE(isodow(Date) IN (6, 7), FALSE) AS DOUBLE) AS is_weekend
FROM rows_ CROSS JOIN st JOIN modes ON COALESCE(rows_.Payment_Mode, 'Bank Transfer') = modes.payment_mode""")
    q["payment_mode_index"] = with_ledger(
        "SELECT payment_mode, CAST(ROW_NUMBER() OVER (ORDER BY payment_mode) - 1 AS INTEGER) AS mode_index FROM"
        " (SELECT DISTINCT COALESCE(Payment_Mode, 'Bank Transfer') AS payment_mode FROM ledger) m")
    q["amount_scaling"] = with_ledger(
        "SELECT ROUND(AVG(LN(1 + CAST(COALESCE(Amount, 0) AS DOUBLE))), 6) AS mean,"
        " ROUND(STDDEV_POP(LN(1 + CAST(COALESCE(Amount, 0) AS DOUBLE))), 6) AS std, COUNT(*) AS n FROM ledger")
    return q


def extra_sql() -> dict[str, str]:
    from ..sources.coa import coa_rows
    vals = ", ".join("('%s', %d)" % (sub.replace("'", "''"), ex) for _, _, sub, _, ex in coa_rows())
    q = {}
    q["gst_consistency"] = with_ledger(f"""
WITH coa2 AS (SELECT * FROM (VALUES {vals}) AS t(sub, exempt)),
x AS (SELECT l.*, CASE WHEN COALESCE(c.exempt, 0) = 1 THEN CAST(0 AS DECIMAL(18,2))
                       WHEN GST_Percentage = 0 THEN CAST(0 AS DECIMAL(18,2))
                       ELSE CAST(ROUND(Amount * CAST(GST_Percentage AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2)), 2)
                                 AS DECIMAL(18,2)) END AS exp
      FROM ledger l LEFT JOIN coa2 c ON l.Sub_Category = c.sub WHERE l.Company_ID IS NOT NULL)
SELECT Company_ID, GST_Percentage AS slab, COUNT(*) AS rows,
       COUNT_IF(NOT COALESCE(exp = GST_Amount, FALSE)) AS mismatches,
       CAST(SUM(exp) AS DOUBLE) AS gst_expected, CAST(SUM(GST_Amount) AS DOUBLE) AS gst_stored
FROM x GROUP BY 1, 2""")
    order = ", ".join(f"{c} ASC NULLS LAST" for c in LEDGER_COLUMNS if c != "Company_ID")
    q["preview"] = with_ledger(
        f"SELECT {PRESENT_COLS}, CAST(rn AS INTEGER) AS row_no FROM (SELECT *, ROW_NUMBER() OVER"
        f" (PARTITION BY Company_ID ORDER BY {order}) AS rn FROM ledger_dirty) p WHERE rn <= 500", dirty=True)
    ins = insight_sql()["compliance_insights"]
    q["tax_insights_by_severity"] = (
        "SELECT *, CASE level WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank FROM ("
        + ins + ") i WHERE title LIKE '[TAX COMPLIANCE]%'")
    return q


def all_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    for part in (statement_sql, quality_sql, text_sql, rules_sql, rollup_sql, trend_sql, insight_sql, ml_io_sql, extra_sql):
        q.update(part())
    from . import checked, source_queries
    q |= checked.oracle_sql()
    return q | source_queries.oracle_sql(q)
