"""Written intermediates and size-checked broadcasts shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A side is broadcast when its written table has at most this many rows (a few tens of MB of ids).
BROADCAST_ROWS = 1_000_000


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts the lineage, survives executor loss."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(df: DataFrame) -> DataFrame:
    """Hand whole texts to Python in batches of at most 1,000 rows (Spark's default is 10,000): bounds a worker's memory.

    Leaves a setting the user has made.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a written table of at most ``max_rows`` rows; a larger one joins by shuffle, with equal results."""
    return F.broadcast(df) if df.count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
