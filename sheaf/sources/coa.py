"""Chart of accounts: sub-category -> class, Schedule III head, GST exemption.

A 70-row dimension table with a fixed size, so joins against it are
broadcast joins (the size bound is the literal below, not a guess).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: (class, sub-category, Schedule III head, GST exempt) ----
# Order inside each class is the sub-category index used by the fixture view.
CHART_OF_ACCOUNTS = (
    ("Expense", "Raw Material Consumed", "Cost of Material Consumed", 0),
    ("Expense", "Packing Material Consumed", "Cost of Material Consumed", 0),
    ("Expense", "Purchases of Stock-in-Trade", "Purchases of Stock-in-Trade", 0),
    ("Expense", "Salary & Wages", "Employee Benefit Expenses", 1),
    ("Expense", "Bonus & Incentives", "Employee Benefit Expenses", 1),
    ("Expense", "Gratuity Expense", "Employee Benefit Expenses", 1),
    ("Expense", "Staff Welfare", "Employee Benefit Expenses", 1),
    ("Expense", "Bank Interest", "Finance Costs", 1),
    ("Expense", "Loan Interest", "Finance Costs", 1),
    ("Expense", "Bank Charges & Commission", "Finance Costs", 0),
    ("Expense", "Depreciation", "Depreciation & Amortisation", 1),
    ("Expense", "Amortisation of Intangibles", "Depreciation & Amortisation", 1),
    ("Expense", "Rent", "Other Expenses", 0),
    ("Expense", "Power & Fuel", "Other Expenses", 0),
    ("Expense", "Insurance Premium", "Other Expenses", 0),
    ("Expense", "Advertising & Marketing", "Other Expenses", 0),
    ("Expense", "Travel & Conveyance", "Other Expenses", 0),
    ("Expense", "Repairs & Maintenance", "Other Expenses", 0),
    ("Expense", "Legal & Professional Fees", "Other Expenses", 0),
    ("Expense", "Audit Fees", "Other Expenses", 0),
    ("Expense", "Telephone & Internet", "Other Expenses", 0),
    ("Expense", "Printing & Stationery", "Other Expenses", 0),
    ("Expense", "Miscellaneous Expense", "Other Expenses", 0),
    ("Income", "Product Sales", "Revenue from Operations", 0),
    ("Income", "Service Revenue", "Revenue from Operations", 0),
    ("Income", "Export Revenue", "Revenue from Operations", 0),
    ("Income", "Interest Income", "Other Income", 1),
    ("Income", "Dividend Income", "Other Income", 1),
    ("Income", "Rental Income", "Other Income", 0),
    ("Income", "Commission Income", "Other Income", 0),
    ("Income", "Gain on Sale of Asset", "Other Income", 1),
    ("Income", "Foreign Exchange Gain", "Other Income", 1),
    ("Asset", "PPE - Land & Building", "Tangible Fixed Assets", 1),
    ("Asset", "PPE - Plant & Machinery", "Tangible Fixed Assets", 0),
    ("Asset", "PPE - Furniture & Fixtures", "Tangible Fixed Assets", 0),
    ("Asset", "PPE - Vehicles", "Tangible Fixed Assets", 0),
    ("Asset", "PPE - Office Equipment", "Tangible Fixed Assets", 0),
    ("Asset", "Intangible - Goodwill", "Intangible Fixed Assets", 0),
    ("Asset", "Intangible - Patents & Trademarks", "Intangible Fixed Assets", 0),
    ("Asset", "Intangible - Computer Software", "Intangible Fixed Assets", 0),
    ("Asset", "Capital Work-in-Progress", "Capital Work-in-Progress", 1),
    ("Asset", "Non-current Investments", "Non-current Investments", 1),
    ("Asset", "Deferred Tax Asset", "Deferred Tax Assets (Net)", 1),
    ("Asset", "Long-term Loans & Advances", "Long-term Loans & Advances", 0),
    ("Asset", "Inventories", "Inventories", 1),
    ("Asset", "Trade Receivables", "Trade Receivables", 1),
    ("Asset", "Cash & Cash Equivalents", "Cash & Cash Equivalents", 1),
    ("Asset", "Short-term Loans & Advances", "Short-term Loans & Advances", 0),
    ("Asset", "Prepaid Expenses", "Other Current Assets", 0),
    ("Asset", "Advance Tax & TDS Receivable", "Other Current Assets", 0),
    ("Liability", "Share Capital", "Share Capital", 1),
    ("Liability", "General Reserve", "Reserves & Surplus", 1),
    ("Liability", "Securities Premium", "Reserves & Surplus", 1),
    ("Liability", "Retained Earnings / Surplus", "Reserves & Surplus", 1),
    ("Liability", "Long-term Borrowings - Term Loan", "Long-term Borrowings", 1),
    ("Liability", "Debentures", "Long-term Borrowings", 1),
    ("Liability", "Deferred Tax Liability", "Deferred Tax Liabilities (Net)", 1),
    ("Liability", "Lease Obligation - Long-term", "Other Long-term Liabilities", 0),
    ("Liability", "Security Deposit Received", "Other Long-term Liabilities", 0),
    ("Liability", "Provision for Gratuity", "Long-term Provisions", 0),
    ("Liability", "Leave Encashment Provision", "Long-term Provisions", 0),
    ("Liability", "Bank Overdraft", "Short-term Borrowings", 1),
    ("Liability", "Cash Credit Limit", "Short-term Borrowings", 1),
    ("Liability", "Trade Payables", "Trade Payables", 0),
    ("Liability", "Advance Received from Customers", "Other Current Liabilities", 0),
    ("Liability", "Unearned Revenue", "Other Current Liabilities", 0),
    ("Liability", "Salary & Wages Payable", "Other Current Liabilities", 0),
    ("Liability", "Provision for Income Tax", "Short-term Provisions", 1),
    ("Liability", "Proposed Dividend", "Short-term Provisions", 1),
    ("Liability", "Other Current Liabilities", "Other Current Liabilities", 0),
)
# --------------------------------------------------------------------------

COA_SCHEMA = T.StructType(
    [
        T.StructField("coa_category", T.StringType(), False),
        T.StructField("coa_idx", T.IntegerType(), False),
        T.StructField("coa_sub_category", T.StringType(), False),
        T.StructField("coa_head", T.StringType(), False),
        T.StructField("coa_gst_exempt", T.IntegerType(), False),
    ]
)


def coa_rows():
    """Rows with the per-class index added."""
    seen: dict[str, int] = {}
    for cat, sub, head, exempt in CHART_OF_ACCOUNTS:
        i = seen.get(cat, 0)
        seen[cat] = i + 1
        yield (cat, i, sub, head, exempt)


def literal_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small literal table; Arrow turns it into a local relation (LocalTableScan)."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(list(rows), columns=schema.fieldNames()), schema)


def coa_df(spark: SparkSession) -> DataFrame:
    """The chart of accounts as a broadcast-marked DataFrame (70 rows)."""
    return F.broadcast(literal_table(spark, list(coa_rows()), COA_SCHEMA))
