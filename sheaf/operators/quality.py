"""Data-quality profile: nulls, duplicates, negatives, zeros, unknown classes, outliers, score.

Row-level checks share one aggregation per key; the full-row duplicate count
adds one shuffle of row digests (see ``dedupe``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.scalars import valid_category
from ..session import written
from .anomaly import iqr_thresholds
from .common import drop_null_keys, join_small, resolve_by
from .dedupe import duplicate_counts


def _q(c: str) -> str:
    return "`" + c + "`"


def null_profile(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Null count of every column per key (long form), with rows and completeness %."""
    by = resolve_by(df, by)
    src = df  # a missing key is a finding here: rows with a null key are their own group
    cols = list(df.columns)
    aggs = [F.expr(f"count_if({_q(c)} IS NULL) AS `n__{i}`") for i, c in enumerate(cols)]
    aggs.append(F.expr("count(1) AS rows"))
    g = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    items = ", ".join(f"'{c}', `n__{i}`" for i, c in enumerate(cols))
    long = g.selectExpr(*[_q(b) for b in by], "rows", f"stack({len(cols)}, {items}) AS (column_name, null_count)")
    return long.selectExpr(*[_q(b) for b in by], "column_name", "null_count", "rows",
                           "100.0D - coalesce(try_divide(CAST(null_count AS DOUBLE), CAST(rows AS DOUBLE)), 0.0D) * 100.0D "
                           "AS completeness_pct")


def _row_checks(df: DataFrame, by: list[str], cat_col: str = "Category") -> DataFrame:
    """One pass: rows, nulls (all cells), negatives, zeros, unknown classes, non-null amounts, dates."""
    cols = list(df.columns)
    nulls = " + ".join(f"CAST({_q(c)} IS NULL AS INT)" for c in cols)
    has_amt = "Amount" in cols
    has_cat = cat_col in cols
    aggs = [
        "count(1) AS rows",
        f"CAST(sum({nulls}) AS BIGINT) AS missing_cells",
        "count_if(Amount < 0) AS negatives" if has_amt else "CAST(0 AS BIGINT) AS negatives",
        "count_if(Amount = 0) AS zeros" if has_amt else "CAST(0 AS BIGINT) AS zeros",
        "count(Amount) AS amounts" if has_amt else "CAST(0 AS BIGINT) AS amounts",
        "count_if(Amount < 0 AND " + _q(cat_col) + " IS NOT NULL) AS negatives_with_class"
        if has_amt and has_cat else "CAST(0 AS BIGINT) AS negatives_with_class",
    ]
    aggs = [F.expr(a) for a in aggs]
    aggs.append((F.count_if(~valid_category(cat_col)) if has_cat else F.lit(0).cast("bigint")).alias("unknown"))
    if "Date" in cols:
        aggs += [F.min("Date").alias("min_date"), F.max("Date").alias("max_date")]
    src = drop_null_keys(df, by)
    return src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)


def quality_report(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category",
                   t: Thresholds = DEFAULT) -> DataFrame:
    """Per key: rows, columns, missing cells and %, duplicates, negatives, zeros, unknown, score, band.

    ``quality_score`` keeps the reference's absolute penalty (it saturates to 0
    on large tables); ``score_per_1k`` charges the same penalty per 1 000 rows.
    """
    by = resolve_by(df, by)
    checks = _row_checks(df, by, cat_col)
    dups = duplicate_counts(df, by)
    r = join_small(checks, dups, by, how="left")
    ncols = len(df.columns)
    penalty = ("((((CAST(missing_cells AS DOUBLE) * 0.5D) + CAST(coalesce(duplicates, 0) AS DOUBLE) * 1.0D)"
               " + CAST(negatives AS DOUBLE) * 0.5D) + CAST(zeros AS DOUBLE) * 0.2D) + CAST(unknown AS DOUBLE) * 1.0D")
    r = r.selectExpr("*", f"{penalty} AS penalty")
    return r.selectExpr(
        *[_q(b) for b in by], "rows", f"{ncols} AS columns", "missing_cells",
        f"round(CAST(missing_cells AS DOUBLE) / CAST(rows * {ncols} AS DOUBLE) * 100.0D, 2) AS missing_pct",
        f"100.0D - CAST(missing_cells AS DOUBLE) / CAST(rows * {ncols} AS DOUBLE) * 100.0D AS completeness_pct",
        "CAST(coalesce(duplicates, 0) AS BIGINT) AS duplicates", "negatives", "zeros", "unknown",
        # the absolute penalty grows with the table: keep it BIGINT (an INT cast would overflow under ANSI)
        "CAST(greatest(0, 100 - CAST(floor(penalty) AS BIGINT)) AS INT) AS quality_score",
        "CAST(greatest(0, 100 - CAST(floor(penalty * 1000.0D / CAST(rows AS DOUBLE)) AS BIGINT)) AS INT) AS score_per_1k",
        "CASE WHEN greatest(0, 100 - CAST(floor(penalty) AS BIGINT)) >= 80 THEN 'high'"
        " WHEN greatest(0, 100 - CAST(floor(penalty) AS BIGINT)) >= 60 THEN 'moderate' ELSE 'poor' END AS quality_band",
    )


def preview_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = resolve_by(df, by)
    c = _row_checks(df, by)
    return c.select(*by, "rows", F.lit(len(df.columns)).alias("columns"), "min_date", "max_date",
                    F.col("missing_cells").alias("total_nulls"))


def negative_by_category(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    by = resolve_by(df, by)
    src = drop_null_keys(df.filter(F.col("Amount") < 0), by + [cat_col])
    return src.groupBy(*by, F.col(cat_col).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def unknown_categories(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Rows outside the four classes per value; a null class is its own row (value null)."""
    by = resolve_by(df, by)
    src = drop_null_keys(df.filter(~valid_category(cat_col)), by)
    return src.groupBy(*by, F.col(cat_col).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def quality_issues(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category",
                   t: Thresholds = DEFAULT) -> DataFrame:
    """The issue list per key (6 possible types) or one 'No Issues Detected' row."""
    by = resolve_by(df, by)
    checks = _row_checks(df, by, cat_col)
    dups = duplicate_counts(df, by)
    thr = iqr_thresholds(df, by, t).select(*by, "threshold_paise", "n_nonnull")
    src = drop_null_keys(df, by)
    with_thr = join_small(src.select(*by, "Amount"), thr, by)
    outl = with_thr.filter((F.col("n_nonnull") > t.min_rows_for_anomaly)
                           & ((F.col("Amount") * 100).cast("double") > F.col("threshold_paise")))
    outl = outl.groupBy(*by).agg(F.count(F.lit(1)).alias("outliers")) if by else outl.agg(
        F.count(F.lit(1)).alias("outliers"))
    r = join_small(join_small(checks, dups, by, "left"), outl, by, "left")
    issue = lambda cond, typ, sev, n: F.when(cond, F.struct(F.lit(typ).alias("issue_type"),
                                                             F.lit(sev).alias("severity"),
                                                             n.cast("bigint").alias("n")))
    dup_n = F.coalesce(F.col("duplicates"), F.lit(0))
    out_n = F.coalesce(F.col("outliers"), F.lit(0))
    arr = F.array(
        issue(F.col("missing_cells") > 0, "Missing Values", "warning", F.col("missing_cells")),
        issue(dup_n > 0, "Duplicate Entries", "critical", dup_n),
        issue(F.col("negatives") > 0, "Negative Transaction Amounts", "warning", F.col("negatives")),
        issue(F.col("zeros") > 0, "Zero-Value Transactions", "info", F.col("zeros")),
        issue(out_n > 0, "Statistical Outliers (Large Transactions)", "warning", out_n),
        issue(F.col("unknown") > 0, "Unrecognised Category Values", "critical", F.col("unknown")),
    )
    found = F.array_compact(arr)
    none = F.array(F.struct(F.lit("No Issues Detected").alias("issue_type"), F.lit("info").alias("severity"),
                            F.lit(0).cast("bigint").alias("n")))
    r = r.select(*by, F.when(F.size(found) > 0, found).otherwise(none).alias("_i"))
    return r.select(*by, F.posexplode("_i").alias("seq", "_s")).select(*by, "seq", "_s.*")


def dataset_overview(df: DataFrame, by: list[str] | None = None, cat_col: str = "Category") -> DataFrame:
    """Per key: rows, columns and row count per class (pivot over the four fixed classes)."""
    by = resolve_by(df, by)
    src = drop_null_keys(df, by)
    aggs = [F.count(F.lit(1)).alias("rows")] + [
        F.count_if(F.col(cat_col) == lab).alias(f"n_{lab.lower()}") for lab in ("Expense", "Income", "Asset",
                                                                                  "Liability")]
    g = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    return g.select(*by, "rows", F.lit(len(df.columns)).alias("columns"), *[c for c in g.columns if c.startswith("n_")])


def gst_consistency(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recompute GST from Amount, slab and the chart of accounts' exemption (broadcast 70-row dimension)
    and count rows whose stored GST_Amount differs, per key and slab."""
    from ..functions.scalars import gst_amount
    from ..sources.coa import coa_df

    by = resolve_by(df, by)
    coa = coa_df(df.sparkSession).select(F.col("coa_sub_category").alias("Sub_Category"),
                                         F.col("coa_gst_exempt").alias("_exempt"))
    j = drop_null_keys(df, by).join(coa, on="Sub_Category", how="left")
    exp = gst_amount("Amount", "GST_Percentage", "_exempt")
    j = j.withColumn("_exp", exp)
    return j.groupBy(*by, F.col("GST_Percentage").alias("slab")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(F.col("_exp") == F.col("GST_Amount"), F.lit(False))).alias("mismatches"),
        F.sum("_exp").cast("double").alias("gst_expected"), F.sum("GST_Amount").cast("double").alias("gst_stored"))


def preview(df: DataFrame, by: list[str] | None = None, n: int = 500,
            drop: tuple[str, ...] = ("Description_clean", "Month", "Is_Weekend", "Payment_Mode_enc",
                                     "Category_enc", "Log_Amount", "Amount_scaled", "features")) -> DataFrame:
    """First n rows per key in (date, then all columns) order, feature columns removed.

    The row cap is the operator itself (a preview). Rows are first counted by key and value of the first order column: where
    the running count reaches n, later values cannot be among the first n rows, so only rows up to there are sorted in full.
    """
    from pyspark.sql import Window

    by = resolve_by(df, by)
    keep = [c for c in df.columns if c not in drop]
    rest = [c for c in keep if c not in by]
    order = [F.col(c).asc_nulls_last() for c in rest]
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    rows = df.select(*keep)
    if by and rest:
        keys = [f"__by{i}" for i in range(len(by))]
        counts = rows.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(rest[0]).alias("__value")).agg(
            F.count(F.lit(1)).alias("__n"))
        values = Window.partitionBy(*keys).orderBy(F.col("__value").asc_nulls_last())
        counts = counts.withColumn("__no", F.row_number().over(values)).filter(F.col("__no") <= n)  # n values hold n rows
        before = F.coalesce(F.sum("__n").over(values.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        needed = counts.withColumn("__before", before).filter(F.col("__before") < n).select(*keys, "__value")
        needed = written(df.sparkSession, needed, "preview-values")
        same = F.col(rest[0]).eqNullSafe(F.col("__value"))
        for b, k in zip(by, keys):
            same = same & F.col(b).eqNullSafe(F.col(k))
        rows = rows.join(needed, same, "left_semi")
    return rows.withColumn("row_no", F.row_number().over(w.orderBy(*order))).filter(F.col("row_no") <= n)
