"""Ledger files: CSV/Parquet readers and writers, model and metrics persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_date
from ..schema import LEDGER_COLUMNS, LEDGER_CSV_SCHEMA, LEDGER_SCHEMA, MONEY
from ..session import shuffles_freed, written

CHUNK_ROWS = 10_000  # fixed value: the application's chunk of a large file
FILE_ROWS = 5_000_000
#: Rows that a writer in slices shuffles at a time.
SLICE_ROWS = 50_000_000


def _normalise(df: DataFrame) -> DataFrame:
    """Typed ledger columns in the standard order; dates and numbers that cannot be read are null."""
    cols = []
    for f in LEDGER_SCHEMA.fields:
        if f.name not in df.columns:
            continue
        if f.name == "Date":
            cols.append(parse_date("Date").alias("Date"))
        elif isinstance(f.dataType, type(MONEY)):
            cols.append(F.expr(f"try_cast(`{f.name}` AS DECIMAL(18,2))").alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in LEDGER_COLUMNS and not c.startswith("_")]
    return df.select(*cols, *extra)


def _ledger_scan(spark: SparkSession, path: str, exclude: str) -> DataFrame:
    df = (spark.read.schema(LEDGER_CSV_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
          .option("pathGlobFilter", "*.csv").csv(path))
    if exclude:
        # a file named *clean*, or a Spark dataset folder named *clean* (its part files), is skipped;
        # the folder given as ``path`` itself is never tested
        root = path.rstrip("/").split("/")[-1]
        parent = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        skip = F.col("_metadata.file_name").contains(exclude) | (parent.contains(exclude) & (parent != F.lit(root)))
        df = df.filter(~skip)
    return df


def read_ledgers(spark: SparkSession, path: str, exclude: str = "clean", keep_file: str | None = None) -> DataFrame:
    """Every ledger CSV under ``path`` (a file or a folder, company sub-folders allowed), except
    files whose name contains ``exclude``; all files are read in one scan and concatenated."""
    df = _ledger_scan(spark, path, exclude)
    if keep_file:
        file = df.select("*", F.col("_metadata.file_path").alias("file_path__"))
        return _normalise(file).withColumnRenamed("file_path__", keep_file)
    return _normalise(df)


def numbered_ledgers(spark: SparkSession, path: str, exclude: str = "clean") -> DataFrame:
    """The ledgers of ``read_ledgers`` with ``_file`` and ``_row``, a row's number (from 1) in its file; written once."""
    from .lines import FILE, numbered, split_columns
    rows = _ledger_scan(spark, path, exclude)
    rows = numbered(written(spark, rows.select("*", *split_columns()), "ledger-rows"), "row__")
    rows = _normalise(rows.withColumnRenamed(FILE, "file__"))
    return rows.withColumnRenamed("file__", "_file").withColumnRenamed("row__", "_row")


def clean_ledger_chunks(df: DataFrame, chunk: str = "_chunk", by: list[str] | None = None) -> DataFrame:
    """Clean each chunk by itself, all chunks in parallel: its own duplicates and its own medians.

    ``chunk`` names a column that says which chunk a row belongs to; it stays in the result.
    """
    from ..operators.clean import clean_ledger
    from ..operators.common import resolve_by
    return clean_ledger(df, by=[chunk, *resolve_by(df, by)])


def read_ledger_chunks(spark: SparkSession, path: str, exclude: str = "clean", rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Ledger CSVs cleaned chunk by chunk, all chunks in parallel; ``_chunk`` is the file's path, ``#`` and the chunk's number.

    A chunk is ``rows`` consecutive rows of a file (the last one may be shorter); None takes a whole file as one chunk.
    """
    if rows is None:
        return clean_ledger_chunks(read_ledgers(spark, path, exclude, keep_file="_chunk"))
    if rows < 1:
        raise ValueError("a chunk has at least one row")
    df = numbered_ledgers(spark, path, exclude)
    number = F.floor((F.col("_row") - 1) / rows).cast("string")
    return clean_ledger_chunks(df.withColumn("_chunk", F.concat("_file", F.lit("#"), number)).drop("_file", "_row"))


def read_upload_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a user CSV with any subset of the ledger columns; dates and numbers that cannot be read are null.

    Lines that are not rows (too many or too few fields, an open quote) are left out: ``lines.read_upload`` returns them.
    """
    from .lines import read_upload
    return read_upload(spark, path, keep_bad_numbers=True)[0]


def write_clean_ledger(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One consolidated output (many part files, one dataset)."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def _company_slices(df: DataFrame, slice_rows: int) -> list[tuple[Column, float]]:
    """Runs of whole companies, in order, of about ``slice_rows`` rows (a larger company is one run): condition, share of rows."""
    company, runs = F.col("Company_ID"), []
    counts = [(r[0], r[1]) for r in df.groupBy("Company_ID").count().orderBy("Company_ID").collect()]  # a folder each
    for c, n in counts:
        if runs and runs[-1][2] + n <= slice_rows:
            runs[-1] = (runs[-1][0], c, runs[-1][2] + n)
        else:
            runs.append((c, c, n))
    total = sum(n for _, n in counts)
    out = []
    for first, last, n in runs:
        # the null company is first in order
        some = company.isNull() if last is None else company.between(first, last) if first is not None else (
            company.isNull() | (company <= last))
        out.append((some, n / total))
    return out


def write_by_company(df: DataFrame, path: str, fmt: str = "csv", partitions: int | None = None, replace: bool = True,
                     rows_per_file: int = FILE_ROWS, compression: str | None = None, slice_rows: int | None = None) -> None:
    """One folder per company (``Company_ID=...``), in files of at most ``rows_per_file`` rows.

    Range partitioning on (company, date) samples the keys, so a company that holds a third of all rows is spread over
    several tasks (several files in its folder) instead of landing in one task. With ``replace=False`` only the folders of
    the companies in ``df`` are replaced, each when its new files are complete; all other folders stay untouched.
    ``compression`` is a codec of the format (``gzip`` writes ``.csv.gz`` files, which one task reads each). ``slice_rows``
    is for stored tables of many rows: companies are written one slice of about so many rows after the other, each read
    from ``df`` again, so the disks hold the shuffle of one slice.
    """
    n = int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = _company_slices(df, slice_rows) if slice_rows else []
    with shuffles_freed(df.sparkSession):
        for i, (some, share) in enumerate(slices if len(slices) > 1 else [(None, 1.0)]):
            rows = df if some is None else df.filter(some)
            out = rows.repartitionByRange(max(1, round(n * share)), "Company_ID", "Date")
            out = out.sortWithinPartitions("Company_ID", "Date")
            w = out.write.mode("append" if i and replace else "overwrite").partitionBy("Company_ID")
            w = w.option("partitionOverwriteMode", "static" if replace else "dynamic").option("maxRecordsPerFile", rows_per_file)
            w = w.option("compression", compression) if compression else w
            (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def company_files(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The manifest of ``write_by_company``: Company_ID, file, rows and the sum of Amount, read back from the files."""
    read = spark.read.schema(LEDGER_CSV_SCHEMA if fmt == "csv" else LEDGER_SCHEMA)
    rows = (read.option("header", True).csv(path) if fmt == "csv" else read.format(fmt).load(path))
    rows = rows.select("Company_ID", "Amount", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("Company_ID", "file").agg(F.count(F.lit(1)).alias("rows"), F.sum("Amount").alias("total"))


def save_model(model, path: str) -> None:
    """Persist a fitted ``PipelineModel`` (or any MLWritable)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a ``PipelineModel``; None when there is no such folder. A damaged model raises."""
    from pyspark.ml import PipelineModel
    spark = SparkSession.active()
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/metadata")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return PipelineModel.load(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics table as JSON (single small file: metrics are a handful of rows)."""
    df.coalesce(1).write.mode("overwrite").json(path)
