"""Exact full-row duplicates, digest first: whole rows are shuffled only where a 16-byte digest repeats.

A first scan shuffles one digest a row (combined map-side, so a row repeated a billion times is one record a task). Rows
whose digest is alone cannot have a duplicate: they never move. The others are compared in full, so two different rows
with one digest stay two rows. The table of repeated digests is written, and joined by broadcast only while it is small.
A larger one is broadcast as a bitmap of bounded size, which may send rows that are alone to the comparison but none past it;
when a large part of the table repeats, all rows are compared, with the same result. Rows are compared in slices by digest,
so the shuffle of one slice, not of the table, is what the disks hold at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_freed, written
from .common import drop_null_keys, join_small, resolve_by

#: A table of repeated digests up to this many rows (16 bytes each) is broadcast.
BROADCAST_DIGESTS = 1_000_000
#: Rows that are shuffled in full at a time.
SLICE_ROWS = 50_000_000
#: Up to this many repeated digests a word of 64 bits, the bitmap still holds back most rows that are alone.
DIGESTS_A_WORD = 32
_H1, _H2 = "__digest_1", "__digest_2"


def _cols(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns: equal rows (null equals null, 0.0 equals -0.0) have equal digests."""
    cols = _cols(df)
    known = [c.isNull() for c in cols]  # a null leaves a hash unchanged: which columns are null is hashed too
    return [F.xxhash64(F.lit(1), *cols, *known).alias(_H1), F.xxhash64(F.lit(2), *known, *reversed(cols)).alias(_H2)]


def _with_digest(df: DataFrame) -> DataFrame:
    return df.select("*", *row_digest(df))


def _repeated(df: DataFrame) -> DataFrame:
    """Written table of the digests that occur more than once, with their rows."""
    each = df.select(*row_digest(df)).groupBy(_H1, _H2).count()
    return written(df.sparkSession, each.filter("count > 1"), "repeated-digests")


def _split(df: DataFrame, repeated: DataFrame, n: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose digest is alone, rows to compare), both with digests; ``n`` > 0 digests are repeated."""
    rows = _with_digest(df)
    if n <= broadcast_rows:
        few = F.broadcast(repeated.select(_H1, _H2))
        return rows.join(few, [_H1, _H2], "left_anti"), rows.join(few, [_H1, _H2], "left_semi")
    word = F.expr(f"pmod({_H1}, {broadcast_rows}L)").alias("__word")
    bit = F.expr(f"shiftleft(1L, cast({_H2} & 63 AS INT))")
    bits = repeated.groupBy(word).agg(F.bit_or(bit).alias("__bits"))
    marked = rows.select("*", word).join(F.broadcast(bits), "__word", "left")
    found = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.filter(~found), marked.filter(found)


def drop_duplicates(df: DataFrame, broadcast_rows: int = BROADCAST_DIGESTS, name: str | None = None,
                    slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each distinct row once (null equals null). Without columns or duplicates the rows come back as they are.

    With ``name`` they are a written table: the rows that are alone, then slices of about ``slice_rows`` rows to compare, one
    after the other. Otherwise one plan holds it all.
    """
    spark = df.sparkSession
    if not df.columns:
        return written(spark, df, name) if name else df
    with shuffles_freed(spark):
        repeated = _repeated(df)
        n, rows = repeated.agg(F.count(F.lit(1)), F.sum("count")).first()
        if n == 0:
            return written(spark, df, name) if name else df
        parts = []
        if n > DIGESTS_A_WORD * broadcast_rows:
            others, rows = _with_digest(df), df.count() if name else rows
        else:
            alone, others = _split(df, repeated, n, broadcast_rows)
            parts = [alone.select(*_cols(df))]
        k = -(-rows // slice_rows) if name else 1
        for i in range(k):
            parts.append(others.filter(F.expr(f"pmod({_H1}, {k}L) = {i}")).select(*_cols(df)).dropDuplicates())
        return written(spark, parts, name) if name else reduce(DataFrame.unionByName, parts)


def duplicate_counts(df: DataFrame, by: list[str] | None = None, broadcast_rows: int = BROADCAST_DIGESTS) -> DataFrame:
    """Rows beyond the first of each identical-row group, per key (0 for a key without any)."""
    by = resolve_by(df, by)
    src = drop_null_keys(df, by)
    count = F.sum(F.col("count") - 1).cast("long").alias("duplicates")
    repeated = _repeated(src)
    n = repeated.count()
    rows = src
    if 0 < n <= broadcast_rows:
        rows = _with_digest(src).join(F.broadcast(repeated), [_H1, _H2], "left_semi").select(*src.columns)
    if n == 0:
        rows = src.limit(0)
    groups = rows.groupBy(*src.columns).count()
    if not by:
        any_row = src.agg(F.count(F.lit(1)).alias("_n"))  # no rows: null, as a sum over nothing
        found = groups.agg(F.coalesce(count, F.lit(0)).cast("long").alias("duplicates"))
        return join_small(any_row, found, []).select(F.when(F.col("_n") > 0, F.col("duplicates")).alias("duplicates"))
    found = written(df.sparkSession, groups.groupBy(*by).agg(count), "duplicates")
    keys = src.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return keys.join(found, by, "left").select(*by, F.coalesce("duplicates", F.lit(0)).cast("long").alias("duplicates"))
