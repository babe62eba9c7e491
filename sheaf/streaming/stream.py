"""Streaming ledger cleaning and rule hits over arriving files.

``stream_clean_ledger``: a file source feeds ``foreachBatch``; each
micro-batch is cleaned on its own (its own dedupe and per-company median,
like the reference's chunked cleaner) and written to ``out/batch_id=N`` with
overwrite, so a replayed batch after a failure rewrites the same folder
(exactly-once output). A batch is parsed once, into a written table; that and
all other intermediates are deleted with the batch. ``stream_rule_hits`` is
stateless (append mode).
Both use a checkpoint folder, and ``Trigger.AvailableNow`` processes what is
there and stops.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import clean_ledger
from ..operators.rules import rule_hits
from ..schema import LEDGER_CSV_SCHEMA, LEDGER_SCHEMA
from ..session import scratch_scope, setting, shuffles_freed, written
from ..sources.io import _normalise

#: Stored bytes that a task reads of compressed files and of the tables written from them: about a million rows.
COMPRESSED_TASK_BYTES = 16 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"


def stream_clean_ledger(spark: SparkSession, in_path: str, out_path: str, checkpoint: str,
                        max_files_per_trigger: int | None = None, by: list[str] | None = None, files: str = "*.csv",
                        task_bytes: int | None = None):
    """Clean the files of names like ``files`` batch by batch; ``task_bytes`` bounds what a task reads (None: the session's)."""
    reader = spark.readStream.schema(LEDGER_CSV_SCHEMA).option("header", True).option("pathGlobFilter", files)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = _normalise(reader.csv(in_path))

    def clean_batch(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        with shuffles_freed(own), scratch_scope(own):
            rows = written(own, batch, "arrived")
            clean_ledger(rows, by=by).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    sink = src.writeStream.foreachBatch(clean_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with setting(spark, _SPLIT, str(task_bytes)) if task_bytes else nullcontext():
        q = sink.start()  # the stream keeps the settings that it starts with
    q.awaitTermination()
    return q


def stream_rule_hits(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, fmt: str = "parquet",
                     rules=None, max_files_per_trigger: int | None = None):
    reader = spark.readStream.schema(LEDGER_SCHEMA if fmt == "parquet" else LEDGER_CSV_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.format(fmt).load(in_path) if fmt == "parquet" else _normalise(reader.option("header", True).csv(in_path))
    q = (rule_hits(src, rules).writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
