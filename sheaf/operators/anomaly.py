"""IQR outliers: per-key quartiles (two-phase: quartiles, then a join back to rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from .common import drop_null_keys, join_small, resolve_by
from .quantiles import group_quantiles_paise


def iqr_thresholds(df: DataFrame, by: list[str] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """Per key: q1, q3, iqr, threshold (rupees, DOUBLE) and ``threshold_paise`` for exact comparison.

    Quartiles are taken on paise (exact integers), so linear interpolation is
    exact and the comparison ``Amount*100 > threshold_paise`` is exact too.
    """
    by = resolve_by(df, by)
    g = group_quantiles_paise(df, by, (0.25, 0.75), ("q1p", "q3p"), t.quantile_method, t.approx_accuracy)
    g = g.selectExpr("*", f"q3p + {t.iqr_factor}D * (q3p - q1p) AS threshold_paise")
    return g.selectExpr(*[f"`{b}`" for b in by], "q1p / 100.0D AS q1", "q3p / 100.0D AS q3",
                        "(q3p - q1p) / 100.0D AS iqr", "threshold_paise / 100.0D AS threshold", "threshold_paise",
                        "n_nonnull", "n_rows")


def iqr_outliers(df: DataFrame, by: list[str] | None = None, t: Thresholds = DEFAULT,
                 gate: str = "anomaly") -> DataFrame:
    """Rows above Q3 + 3*IQR of their key.

    ``gate``: 'anomaly' needs >=10 non-null amounts, 'validation' >10 non-null,
    'report' >10 rows - each caller of the reference keeps its own gate.
    """
    by = resolve_by(df, by)
    thr = iqr_thresholds(df, by, t)
    ok = {"anomaly": F.col("n_nonnull") >= t.min_rows_for_anomaly,
          "validation": F.col("n_nonnull") > t.min_rows_for_anomaly,
          "report": F.col("n_rows") > t.min_rows_for_anomaly}[gate]
    thr = thr.filter(ok).select(*by, "threshold_paise", "threshold")
    rows = join_small(drop_null_keys(df, by), thr, by)
    return rows.filter((F.col("Amount") * 100).cast("double") > F.col("threshold_paise")).drop("threshold_paise")


def statistical_anomalies(df: DataFrame, by: list[str] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """Per key: available flag, quartiles, threshold, outlier count / total / max."""
    by = resolve_by(df, by)
    thr = iqr_thresholds(df, by, t)
    rows = join_small(drop_null_keys(df, by).select(*by, "Amount"), thr.select(*by, "threshold_paise"), by)
    o = rows.filter((F.col("Amount") * 100).cast("double") > F.col("threshold_paise"))
    aggs = [F.count(F.lit(1)).alias("count"), F.sum("Amount").alias("_tot"), F.max("Amount").alias("_max")]
    o = o.groupBy(*by).agg(*aggs) if by else o.agg(*aggs)
    r = join_small(thr, o, by, "left")
    avail = F.col("n_nonnull") >= t.min_rows_for_anomaly
    return r.select(
        *by, avail.alias("available"), F.when(avail, F.col("q1")).alias("q1"), F.when(avail, F.col("q3")).alias("q3"),
        F.when(avail, F.col("iqr")).alias("iqr"), F.when(avail, F.col("threshold")).alias("threshold"),
        F.when(avail, F.coalesce(F.col("count"), F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("count"),
        F.when(avail, F.coalesce(F.col("_tot"), F.lit(0))).otherwise(F.lit(0)).cast("double").alias("total_amount"),
        F.when(avail, F.col("_max")).cast("double").alias("max_amount"), "n_nonnull",
    )


def top_outliers(df: DataFrame, by: list[str] | None = None, t: Thresholds = DEFAULT, n: int = 10) -> DataFrame:
    """The n largest report outliers per key with five display columns (text cut to 40 chars)."""
    from pyspark.sql import Window
    by = resolve_by(df, by)
    o = iqr_outliers(df, by, t, gate="report")
    w = Window.partitionBy(*by).orderBy(F.col("Amount").desc(), F.col("Date").asc_nulls_last(),
                                         F.col("Description").asc_nulls_last(), F.col("Category").asc_nulls_last(),
                                         F.col("Payment_Mode").asc_nulls_last())
    o = o.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return o.select(*by, "rank", F.date_format("Date", "yyyy-MM-dd").alias("Date"),
                    F.substring("Description", 1, 40).alias("Description"), F.col("Amount").cast("double").alias("Amount"),
                    F.substring("Category", 1, 40).alias("Category"),
                    F.substring("Payment_Mode", 1, 40).alias("Payment_Mode"))
