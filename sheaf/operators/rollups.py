"""Roll-ups behind the dashboard charts: class, sub-category, month, mode, slab, flows, hierarchy.

All are hash aggregates with map-side combine; windows run only over the
already-aggregated rows (a handful per key), never over ledger rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_null_keys, dsum, money, resolve_by


def _w(by):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def category_totals(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Sum Amount per class with its share of the key's total (%)."""
    by = resolve_by(df, by)
    g = drop_null_keys(df, by + [cat_col]).groupBy(*by, F.col(cat_col).alias("category")).agg(
        dsum(F.col("Amount")).alias("_a"))
    return g.select(*by, "category", money("_a").alias("amount"),
                    (F.try_divide(F.col("_a").cast("double"), F.sum(F.col("_a")).over(_w(by)).cast("double")) * 100)
                    .alias("share_pct"))


def category_distribution(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Row count and % per class."""
    by = resolve_by(df, by)
    g = drop_null_keys(df, by + [cat_col]).groupBy(*by, F.col(cat_col).alias("category")).agg(
        F.count(F.lit(1)).alias("n"))
    return g.select(*by, "category", "n",
                    (F.col("n").cast("double") / F.sum("n").over(_w(by)).cast("double") * 100).alias("pct"))


# ---- fixed values: observation text for expense ranks 1, 2, 3 ----------------
RANK_NOTES = ("Primary cost driver — monitor closely", "Major outflow — review for efficiency",
              "Significant — assess budget alignment")
# -------------------------------------------------------------------------------


def top_expense_heads(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category",
                      n: int = 3) -> DataFrame:
    """Top-n expense sub-categories per key by amount (ties by name), % of total expense, rank note."""
    by = resolve_by(df, by)
    exp = drop_null_keys(df.filter(F.col(cat_col) == "Expense"), by)
    # one aggregate: the total is the sum of the heads' sums (rows without a head count in it, but are not listed)
    g = exp.groupBy(*by, "Sub_Category").agg(dsum(F.col("Amount")).alias("_a"))
    g = drop_null_keys(g.withColumn("_te", F.sum("_a").over(_w(by))), ["Sub_Category"])
    w = _w(by).orderBy(F.col("_a").desc(), F.col("Sub_Category").asc())
    g = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    note = F.element_at(F.array(*[F.lit(x) for x in RANK_NOTES]), F.col("rank"))
    return g.select(*by, "rank", F.col("Sub_Category").alias("sub_category"), money("_a").alias("amount"),
                    F.when(F.col("_te") > 0, F.col("_a").cast("double") / F.col("_te").cast("double") * 100)
                    .otherwise(F.lit(0.0)).alias("pct_of_expense"),
                    F.when(F.col("rank") <= len(RANK_NOTES), note).alias("note"))


def monthly_trend(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Income and Expense per calendar month ``yyyy-MM``; rows without a date are left out."""
    by = resolve_by(df, by)
    src = drop_null_keys(df.filter(F.col("Date").isNotNull() & F.col(cat_col).isin("Income", "Expense")), by)
    return src.groupBy(*by, F.date_format("Date", "yyyy-MM").alias("month"), F.col(cat_col).alias("category")).agg(
        money(dsum(F.col("Amount"))).alias("amount"))


def payment_mode_totals(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = resolve_by(df, by)
    src = drop_null_keys(df, by + ["Payment_Mode"])
    return src.groupBy(*by, F.col("Payment_Mode").alias("payment_mode")).agg(
        money(dsum(F.col("Amount"))).alias("amount"), F.count(F.lit(1)).alias("n"))


def gst_slab_totals(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """GST amount per positive slab."""
    by = resolve_by(df, by)
    src = drop_null_keys(df.filter(F.col("GST_Percentage") > 0), by)
    return src.groupBy(*by, F.col("GST_Percentage").alias("slab")).agg(
        money(dsum(F.col("GST_Amount"))).alias("gst_amount"), F.count(F.lit(1)).alias("n"))


def flow_edges(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Sankey edges: class -> sub-category (amount > 0); sub-category -> 'GST Total' (GST > 0) and
    -> 'Net Total' (max(0, amount - GST) > 0). Sub-category sums run across classes."""
    by = resolve_by(df, by)
    src = drop_null_keys(df, by)
    cs = drop_null_keys(src, [cat_col, "Sub_Category"]).groupBy(*by, F.col(cat_col).alias("source"),
                                                               F.col("Sub_Category").alias("target")).agg(
        dsum(F.col("Amount")).alias("v"))
    cs = cs.filter(F.col("v") > 0).select(*by, F.lit("category_sub").alias("kind"), "source", "target",
                                          money("v").alias("value"))
    sub = drop_null_keys(src, ["Sub_Category"]).groupBy(*by, F.col("Sub_Category").alias("source")).agg(
        dsum(F.col("Amount")).alias("a"), dsum(F.col("GST_Amount")).alias("g"))
    sg = sub.selectExpr(*[f"`{b}`" for b in by], "source",
                        "stack(2, 'sub_gst', 'GST Total', CAST(g AS DECIMAL(38,2)), 'sub_net', 'Net Total', "
                        "CAST(greatest(CAST(0 AS DECIMAL(18,2)), a - g) AS DECIMAL(38,2))) AS (kind, target, v)")
    sg = sg.filter(F.col("v") > 0).select(*by, "kind", "source", "target", money("v").alias("value"))
    return cs.unionByName(sg)


def network_nodes(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Node totals per class / sub-category / payment mode with a min-max scaled size."""
    by = resolve_by(df, by)
    src = drop_null_keys(df, by)
    kinds = (("category", cat_col, 12, 55), ("sub_category", "Sub_Category", 8, 36), ("payment_mode", "Payment_Mode", 8, 30))
    # one scan: sums per (class, sub-category, mode), whose few rows then count once for each of their three nodes
    small = src.groupBy(*by, *[F.col(c).alias(k) for k, c, _, _ in kinds]).agg(dsum(F.col("Amount")).alias("a"))
    node = F.explode_outer(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("node")) for k, _, _, _ in kinds]))
    g = small.select(*by, "a", node.alias("x")).select(*by, "x.kind", "x.node", "a").filter(F.col("node").isNotNull())
    g = g.groupBy(*by, "kind", "node").agg(dsum(F.col("a")).alias("a"))
    w = Window.partitionBy(*by, "kind")
    mn, mx = F.min("a").over(w).cast("double"), F.max("a").over(w).cast("double")
    lo = F.when(F.col("kind") == "category", 12.0).otherwise(8.0)
    hi = F.when(F.col("kind") == "category", 55.0).when(F.col("kind") == "sub_category", 36.0).otherwise(30.0)
    size = F.when(mx == mn, (lo + hi) / 2).otherwise(lo + (hi - lo) * (F.col("a").cast("double") - mn) / (mx - mn))
    return g.select(*by, "kind", "node", money("a").alias("amount"), size.alias("size"))


def network_edges(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Edge volumes (class, sub-category) and (sub-category, payment mode)."""
    by = resolve_by(df, by)
    src = drop_null_keys(df, by)
    a = drop_null_keys(src, [cat_col, "Sub_Category"]).groupBy(
        *by, F.col(cat_col).alias("source"), F.col("Sub_Category").alias("target")).agg(
        money(dsum(F.col("Amount"))).alias("amount")).withColumn("kind", F.lit("category_sub"))
    b = drop_null_keys(src, ["Sub_Category", "Payment_Mode"]).groupBy(
        *by, F.col("Sub_Category").alias("source"), F.col("Payment_Mode").alias("target")).agg(
        money(dsum(F.col("Amount"))).alias("amount")).withColumn("kind", F.lit("sub_mode"))
    return a.unionByName(b)


def spend_hierarchy(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Sunburst table: class -> sub-category -> payment mode.

    Leaves with Amount <= 0 are removed before rolling up; gst_ratio = GST /
    Amount (0 when Amount = 0), clipped to [0, 1] on leaves only; leaf pct is
    the share of all kept leaves (2 dp). Parents come from ``rollup`` over the
    kept leaves (``grouping_id`` gives the level).
    """
    by = resolve_by(df, by)
    leaves = drop_null_keys(df, by + [cat_col, "Sub_Category", "Payment_Mode"]).groupBy(
        *by, F.col(cat_col).alias("cat"), F.col("Sub_Category").alias("sub"), F.col("Payment_Mode").alias("mode")).agg(
        dsum(F.col("Amount")).alias("a"), dsum(F.col("GST_Amount")).alias("g"))
    leaves = leaves.filter(F.col("a") > 0)
    keys = [F.col(b) for b in by]
    r = leaves.rollup(*keys, "cat", "sub", "mode").agg(
        F.sum("a").alias("a"), F.sum("g").alias("g"),
        (F.grouping("cat") * 4 + F.grouping("sub") * 2 + F.grouping("mode")).alias("gid"))
    # keep the three levels under the keys: gid 0 = leaf, 1 = sub-category, 3 = class
    r = r.filter(F.col("gid").isin(0, 1, 3))
    level = F.when(F.col("gid") == 0, 3).when(F.col("gid") == 1, 2).otherwise(1)
    ratio = F.when(F.col("a") != 0, F.col("g").cast("double") / F.col("a").cast("double")).otherwise(F.lit(0.0))
    total = F.sum(F.when(F.col("gid") == 0, F.col("a"))).over(_w(by))
    r = r.select(*by, level.alias("level"), "cat", "sub", "mode", "a", "g", ratio.alias("ratio"),
                 total.alias("_tot"))
    ident = F.when(F.col("level") == 1, F.col("cat")).when(
        F.col("level") == 2, F.concat_ws("|", "cat", "sub")).otherwise(F.concat_ws("|", "cat", "sub", "mode"))
    parent = F.when(F.col("level") == 1, F.lit("")).when(F.col("level") == 2, F.col("cat")).otherwise(
        F.concat_ws("|", "cat", "sub"))
    label = F.when(F.col("level") == 1, F.col("cat")).when(F.col("level") == 2, F.col("sub")).otherwise(F.col("mode"))
    return r.select(
        *by, "level", ident.alias("id"), parent.alias("parent"), label.alias("label"), money("a").alias("amount"),
        money("g").alias("gst_amount"),
        F.when(F.col("level") == 3, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ratio"))))
        .otherwise(F.col("ratio")).alias("gst_ratio"),
        F.when(F.col("level") == 3, F.round(F.col("a").cast("double") / F.col("_tot").cast("double") * 100, 2))
        .alias("pct"),
    )
