"""Anomaly summary: IQR flag and isolation-forest flag per row, counted per key in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..operators.anomaly import iqr_thresholds
from ..operators.common import join_small, resolve_by


def anomaly_summary(scored: DataFrame, by: list[str] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """``scored`` carries ``Amount`` and ``Is_Anomaly_Predicted``; statistical flag needs >= 10 amounts."""
    by = resolve_by(scored, by)
    thr = iqr_thresholds(scored, by, t).filter(F.col("n_nonnull") >= t.min_rows_for_anomaly).select(
        *by, "threshold_paise")
    rows = join_small(scored, thr, by, "left")
    stat = F.coalesce((F.col("Amount") * 100).cast("double") > F.col("threshold_paise"), F.lit(False))
    ml = F.coalesce(F.col("Is_Anomaly_Predicted"), F.lit(False))
    aggs = [F.count_if(stat).alias("statistical_count"), F.count_if(ml).alias("ml_count"),
            F.count_if(stat | ml).alias("total_unique"), F.count(F.lit(1)).alias("rows")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def predicted_anomaly_rows(scored: DataFrame, by: list[str] | None = None, n: int = 100) -> DataFrame:
    """The first n forest-flagged rows per key, most anomalous first (a report list; the cap is the feature)."""
    from pyspark.sql import Window

    by = resolve_by(scored, by)
    flagged = scored.filter(F.col("Is_Anomaly_Predicted"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(
        F.col("Anomaly_Score").asc(), F.col("Amount").desc(), F.col("Date").asc_nulls_last(),
        F.col("Description").asc_nulls_last())
    return flagged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
