"""Fiscal-year totals and the year-on-year comparison of the last two fiscal years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fiscal_year_start
from .common import drop_null_keys, dsum, money, resolve_by


def fiscal_year_sums(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Per (key, fiscal year): income and expense sums (DECIMAL) and rows; undated rows left out."""
    by = resolve_by(df, by)
    src = drop_null_keys(df.filter(F.col("Date").isNotNull()), by)
    src = src.withColumn("fy_start", fiscal_year_start(F.col("Date")))
    return src.groupBy(*by, "fy_start").agg(
        dsum(F.col("Amount"), F.col(cat_col) == "Income").alias("revenue"),
        dsum(F.col("Amount"), F.col(cat_col) == "Expense").alias("expense"),
        F.count(F.lit(1)).alias("rows"), dsum(F.col("Amount")).alias("amount"))


def _fy_label(start):
    return F.concat(F.lit("FY "), start.cast("string"), F.lit("-"), F.substring((start + 1).cast("string"), -2, 2))


def fiscal_year_totals(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    by = resolve_by(df, by)
    g = fiscal_year_sums(df, by, cat_col)
    return g.select(*by, _fy_label(F.col("fy_start")).alias("fiscal_year"), "fy_start", "rows",
                    money("amount").alias("amount"), money("revenue").alias("revenue"),
                    money("expense").alias("expense"))


def _growth(c, p):
    return F.when(p != 0, F.round((c - p).cast("double") / p.cast("double") * 100, 2))


def yoy_comparison(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Last fiscal year versus the one before it (by start year), growth % and trend per key.

    Growth is null when the prior value is 0; the sign is not corrected for a
    negative prior value; a null profit growth reads as 'Stable'.
    """
    by = resolve_by(df, by)
    g = fiscal_year_sums(df, by, cat_col)
    w = Window.partitionBy(*by).orderBy("fy_start") if by else Window.orderBy("fy_start")
    wd = Window.partitionBy(*by).orderBy(F.col("fy_start").desc()) if by else Window.orderBy(
        F.col("fy_start").desc())
    wall = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    g = g.select(*by, "fy_start", "revenue", "expense",
                 F.lag("fy_start").over(w).alias("prev_start"), F.lag("revenue").over(w).alias("prev_revenue"),
                 F.lag("expense").over(w).alias("prev_expense"), F.row_number().over(wd).alias("rn"),
                 F.count(F.lit(1)).over(wall).alias("n_fy"))
    g = g.filter(F.col("rn") == 1)
    avail = F.col("n_fy") >= 2
    cp = F.col("revenue") - F.col("expense")
    pp = F.col("prev_revenue") - F.col("prev_expense")
    pg = _growth(cp, pp)
    trend = F.when(pg > 5, "Improving").when(pg < -5, "Declining").otherwise("Stable")
    a = lambda c: F.when(avail, c)
    return g.select(
        *by, avail.alias("available"), _fy_label(F.col("fy_start")).alias("curr_fy"),
        a(_fy_label(F.col("prev_start"))).alias("prev_fy"),
        a(money("revenue")).alias("current_revenue"), a(money("prev_revenue")).alias("previous_revenue"),
        a(_growth(F.col("revenue"), F.col("prev_revenue"))).alias("revenue_growth_pct"),
        a(money("expense")).alias("current_expense"), a(money("prev_expense")).alias("previous_expense"),
        a(_growth(F.col("expense"), F.col("prev_expense"))).alias("expense_growth_pct"),
        a(money(cp)).alias("current_profit"), a(money(pp)).alias("previous_profit"),
        a(pg).alias("profit_growth_pct"), a(trend).alias("trend"),
    )
