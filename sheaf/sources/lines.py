"""Row and line numbers of files without a global order or a single task, and uploads with their rejected lines.

A file is read in splits, and a split's rows by one task in their order. Every row gets an id that rises inside its split
(two phases): the splits' first ids and sizes are counted, their running sum over each file gives every split an offset,
and a row's number is its split's offset plus its place. Only the table of splits (a row for each 128 MB) is ordered; rows
are never shuffled. They are written once with their ids, so a lost task cannot number them anew.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LEDGER_SCHEMA
from ..session import written

FILE, BLOCK, ID, CORRUPT = "__file", "__block", "__id", "__corrupt"
#: A written table of splits up to this many rows is broadcast to the rows.
BROADCAST_SPLITS = 1_000_000
#: Different header lines that one upload may have.
HEADERS = 1_000


def split_columns() -> list[Column]:
    """File, split and rising id of each row of a file scan; to be selected directly from the scan."""
    return [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
            F.monotonically_increasing_id().alias(ID)]


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """A written ``rows`` with the number (from 1) of each row in its file as ``name``; needs ``split_columns``, keeps FILE."""
    splits = rows.groupBy(FILE, BLOCK).agg(F.min(ID).alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(FILE, BLOCK, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    splits = written(rows.sparkSession, splits, "file-splits")
    few = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    out = rows.join(few, [FILE, BLOCK]).withColumn(name, F.col(ID) + F.col("__shift") + 1)
    return out.drop(BLOCK, ID, "__shift")


def text_lines(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Every line of the files at ``path``: FILE, line (from 1) and value."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    return numbered(written(spark, lines.select("value", *split_columns()), "file-lines"), "line")


def _names(header: str) -> list[str]:
    """Column names of a header line; empty and repeated ones are made different."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([header.lstrip("﻿")]), [])):
        name = name.strip() or f"column_{i + 1}"
        while name.lower() in {x.lower() for x in out}:
            name += "_2"
        out.append(name)
    return out


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DecimalType, T.IntegerType, T.LongType, T.DoubleType))


def _reasons(names: list[str], numbers: bool) -> Column:
    """Why a line is refused (an array; empty for a good one); ``numbers``: an unreadable number is a reason."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    commas = F.length(F.regexp_replace(F.regexp_replace(value, r'"[^"]*"', ""), r"[^,]", ""))
    shape = F.when(quotes % 2 == 1, "open quote").when(F.col(CORRUPT).isNull(), F.lit(None).cast("string")).when(
        commas >= len(names), "extra fields").when(commas < len(names) - 1, "missing fields").otherwise("malformed")
    bad = [shape]
    for f in LEDGER_SCHEMA.fields:
        if numbers and f.name in names and _is_number(f.dataType):
            raw = F.trim(F.col(f"`{f.name}`"))
            fits = F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})").isNotNull()
            bad.append(F.when(shape.isNull() & (raw != "") & ~fits, f"bad number in {f.name}"))
    return F.array_compact(F.array(*bad))


def read_upload(spark: SparkSession, path: str, pattern: str = "*.csv", keep_bad_numbers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of user CSV files with any subset of the ledger columns and any others.

    The first line of a file that is not blank names its columns. A line is rejected, whole, if it has more or fewer fields,
    an open quote, or text where the ledger has a number; rejects are (file, line, text, reason). An unreadable date is no
    reason: it becomes null, and so does an unreadable number with ``keep_bad_numbers``. Blank lines are skipped. Good rows hold the ledger columns found, typed, and then the others:
    long or double where every value of the column is one, else text. A quote inside a quoted field is doubled; a field
    holds no line break. Both results are written tables.
    """
    lines = text_lines(spark, path, pattern)
    lines = written(spark, lines.filter(F.trim("value") != "").select(FILE, "line", "value"), "upload-lines")
    first = lines.groupBy(FILE).agg(F.min(F.struct("line", "value")).alias("h"))
    first = written(spark, first.select(FILE, F.col("h.line").alias("__head"), F.col("h.value").alias("__header")), "upload-headers")
    headers = sorted(r[0] for r in first.select("__header").distinct().limit(HEADERS + 1).collect())
    if len(headers) > HEADERS:
        raise ValueError(f"more than {HEADERS} different header lines below {path}")
    body = lines.join(first, FILE).filter(F.col("line") > F.col("__head"))
    parsed = None
    for header in headers:
        names = _names(header)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
        fields = F.from_csv("value", schema.toDDL(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'})
        rows = body.filter(F.col("__header") == header).select(FILE, "line", "value", fields.alias("__row"))
        rows = rows.select(FILE, "line", "value", "__row.*").withColumn("__reason", F.array_join(_reasons(names, not keep_bad_numbers), "; ")).drop(CORRUPT)
        parsed = rows if parsed is None else parsed.unionByName(rows, allowMissingColumns=True)
    if parsed is None:
        empty = spark.createDataFrame([], LEDGER_SCHEMA)
        return empty, spark.createDataFrame([], "file string, line long, text string, reason string")
    parsed = written(spark, parsed, "upload-parsed")
    rejects = parsed.filter("__reason != ''").select(F.col(FILE).alias("file"), "line", F.col("value").alias("text"),
                                                   F.col("__reason").alias("reason"))
    good = parsed.filter("__reason = ''").drop(FILE, "line", "value", "__reason")
    from .io import _normalise
    known = {f.name for f in LEDGER_SCHEMA.fields}
    trimmed = [F.trim(F.col(f"`{f.name}`")).alias(f.name) if f.name in known and _is_number(LEDGER_SCHEMA[f.name].dataType)
               else F.col(f"`{f.name}`") for f in good.schema.fields]
    good = _typed_extras(good.select(*trimmed), [c for c in good.columns if c not in known])
    return written(spark, _normalise(good), "upload-good"), written(spark, rejects, "upload-rejects")


def _typed_extras(df: DataFrame, extra: list[str]) -> DataFrame:
    """Extra text columns as long or double where every value fits (one aggregate over all of them)."""
    if not extra:
        return df
    aggs = []
    for i, c in enumerate(extra):
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"n{i}"))
        aggs += [F.expr(f"count(try_cast(`{c}` AS {k}))").alias(f"{k}{i}") for k in ("bigint", "double")]
    seen = df.agg(*aggs).first()
    kind = {}
    for i, c in enumerate(extra):
        if seen[f"n{i}"]:
            kind[c] = next((k for k in ("bigint", "double") if seen[f"{k}{i}"] == seen[f"n{i}"]), "string")
    return df.select(*[F.col(f"`{c}`").cast(kind.get(c, "string")).alias(c) if c in extra else F.col(f"`{c}`") for c in df.columns])
