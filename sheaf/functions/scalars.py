"""Scalar helpers on ledger columns: dates, fiscal year, class index, transaction type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LABELS


#: Date formats in the order they are tried: ISO first, then day before month, then month names.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy",
                "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd", "M/d/yyyy")


def parse_date(c: Column | str) -> Column:
    """Text or date to DATE by the first format that fits; text that fits none becomes null (ANSI-safe)."""
    col = F.col(c) if isinstance(c, str) else c
    text = F.trim(col.cast("string"))
    return F.coalesce(*[F.try_to_date(text, f) for f in DATE_FORMATS], F.try_to_date(text))


def month_or_one(d: Column) -> Column:
    return F.coalesce(F.month(d), F.lit(1))


def is_weekend(d: Column) -> Column:
    """1 on Saturday/Sunday (``weekday``: Monday=0), 0 otherwise or when the date is null."""
    return F.coalesce(F.weekday(d).isin(5, 6).cast("int"), F.lit(0))


def fiscal_year_start(d: Column) -> Column:
    """Indian fiscal year (April-March) start year."""
    return F.when(F.month(d) >= 4, F.year(d)).otherwise(F.year(d) - 1)


def fiscal_year_label(d: Column) -> Column:
    """``FY 2023-24`` for any date from 2023-04-01 to 2024-03-31."""
    s = fiscal_year_start(d)
    return F.concat(F.lit("FY "), s.cast("string"), F.lit("-"), F.substring((s + 1).cast("string"), -2, 2))


def category_index(c: Column | str) -> Column:
    """Expense 0, Income 1, Asset 2, Liability 3; anything else null."""
    col = F.col(c) if isinstance(c, str) else c
    out = None
    for i, lab in enumerate(LABELS):
        out = F.when(col == lab, F.lit(i)) if out is None else out.when(col == lab, F.lit(i))
    return out


def transaction_type(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isin("Expense", "Asset"), F.lit("Debit")).otherwise(F.lit("Credit"))


def valid_category(c: Column | str) -> Column:
    """True for the four classes; null counts as not valid (like pandas ``isin``)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.isin(*LABELS), F.lit(False))


def gst_amount(amount: Column | str, pct: Column | str, exempt: Column | str) -> Column:
    """GST on an amount: 0 for an exempt sub-category or a 0 % slab, else round(amount * pct / 100, 2)."""
    a = F.col(amount) if isinstance(amount, str) else amount
    p = F.col(pct) if isinstance(pct, str) else pct
    e = F.col(exempt) if isinstance(exempt, str) else exempt
    g = F.round(a * p.cast("decimal(4,0)") * F.lit(0.01).cast("decimal(3,2)"), 2).cast("decimal(18,2)")
    return F.when(F.coalesce(e, F.lit(0)) == 1, F.lit(0).cast("decimal(18,2)")).when(p == 0, F.lit(0).cast(
        "decimal(18,2)")).otherwise(g)
