"""Tiny hand-built ledgers for edge cases."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from sheaf.schema import LEDGER_SCHEMA


def row(company="C1", date="2023-05-10", desc="Salary paid", amount="1000.00", cat="Expense",
        sub="Salary & Wages", head="Employee Benefit Expenses", gst_pct=0, gst="0.00", mode="Bank Transfer",
        vendor="V"):
    d = dt.date.fromisoformat(date) if isinstance(date, str) else date
    a = Decimal(amount) if amount is not None else None
    g = Decimal(gst) if gst is not None else None
    ttype = "Debit" if cat in ("Expense", "Asset") else "Credit"
    return (company, d, desc, a, ttype, cat, sub, head, gst_pct, g, mode, vendor)


def ledger(spark, rows):
    return spark.createDataFrame(rows, LEDGER_SCHEMA)
