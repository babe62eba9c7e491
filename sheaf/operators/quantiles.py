"""Exact per-group quantiles of integer-valued amounts (paise), in two scans of the rows.

The first scan makes one mergeable KLL sketch per key, which brackets every wanted rank between two values. The second
scan counts the rows below each bracket and keeps only the values inside, with their counts; the wanted order statistics
are then read off a running count over that small table. A bracket is never trusted: when the counts show that a rank is
not inside, the keys concerned are scanned again with a wider bracket, at last the whole range. So the result is exact at
every size, whatever the sketch says. Interpolation follows the linear rule (position = q * (n - 1)), exact for integer
inputs at q = 1/4, 1/2, 3/4.

The per-key tables (statistics with their brackets, the values inside, the result) are written to the shared folder, so
the planner knows their size: ledger rows meet them by a broadcast while they are small, and are not shuffled on the
company key. A hot company's rows are counted map-side; only distinct values inside its brackets reach one task, which
streams through them in order.

``radix`` is a second exact way without a sketch (digit by digit, a scan each 16 bits of the value range); ``sketch`` is the
explicit approximate choice (mergeable ``percentile_approx``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import drop_null_keys, join_small

DIGIT_BITS = 16
#: Items that a sketch keeps at a level: the error of a rank is about 0.2 % of the rows.
SKETCH_K = 2_000
#: (least rows of a group, bracket on either side of a rank as a share of the rows), from narrow to the whole range.
WIDTHS = ((2_000, 0.005), (200, 0.015), (20, 0.12), (0, 1.0))


def _keys(by):
    return [F.col(f"`{b}`") for b in by]


def _sketch(v: DataFrame, by, qs, names, accuracy: int) -> DataFrame:
    arr = F.percentile_approx(F.col("_v").cast("double"), [float(q) for q in qs], accuracy)
    g = v.groupBy(*by).agg(arr.alias("_q")) if by else v.agg(arr.alias("_q"))
    return g.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def _radix(v: DataFrame, stats: DataFrame, by, qs, names) -> DataFrame:
    """Exact order statistics by radix selection; ``stats`` holds n, mn, bits per group."""
    gk = by if by else ["_g"]
    if not by:
        v = v.withColumn("_g", F.lit(0))
        stats = stats.withColumn("_g", F.lit(0))
    # slots: lower and upper rank of every quantile
    slot_rows = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("n") - 1).cast("double")
        slot_rows.append(F.struct(F.lit(2 * i).alias("slot"), F.floor(pos).cast("long").alias("rank")))
        slot_rows.append(F.struct(F.lit(2 * i + 1).alias("slot"), F.ceil(pos).cast("long").alias("rank")))
    spark = v.sparkSession
    state = stats.filter(F.col("n") > 0).select(*gk, "mn", "bits", F.explode(F.array(*slot_rows)).alias("s"))
    state = state.select(*gk, "mn", "bits", "s.slot", "s.rank", F.lit(0).cast("long").alias("prefix"),
                         F.col("bits").alias("shift"))
    max_bits = stats.agg(F.max("bits")).first()[0] or 0
    rows = v.join(stats.select(*gk, "mn", "bits"), on=gk).select(*gk, (F.col("_v") - F.col("mn")).alias("_y"),
                                                                  "bits")
    rounds = max(1, -(-int(max_bits) // DIGIT_BITS))
    for _ in range(rounds):
        new_shift = F.greatest(F.col("shift") - DIGIT_BITS, F.lit(0))
        state = written(spark, state.withColumn("new_shift", new_shift), "quantile-state")
        wanted = state.select(*gk, "prefix", "shift", "new_shift").distinct()
        cand = rows.join(wanted, on=gk).filter(F.expr("shiftright(_y, shift) = prefix"))
        hist = cand.groupBy(*gk, "prefix", "new_shift", F.expr("shiftright(_y, new_shift)").alias("bucket")).agg(
            F.count(F.lit(1)).alias("c"))
        j = state.join(hist, on=[*gk, "prefix", "new_shift"])
        w = Window.partitionBy(*gk, "slot").orderBy("bucket")
        j = j.withColumn("cum", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        j = j.filter((F.col("cum") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("cum")))
        state = j.select(*gk, "mn", "bits", "slot", (F.col("rank") - (F.col("cum") - F.col("c"))).alias("rank"),
                         F.col("bucket").alias("prefix"), F.col("new_shift").alias("shift"))
    vals = state.select(*gk, "slot", (F.col("mn") + F.col("prefix")).cast("double").alias("x"))
    piv = vals.groupBy(*gk).agg(*[F.max(F.when(F.col("slot") == s, F.col("x"))).alias(f"_s{s}")
                                  for s in range(2 * len(qs))])
    out = stats.select(*gk, "n").join(piv, on=gk, how="left")
    cols = []
    for i, (q, name) in enumerate(zip(qs, names)):
        pos = F.lit(float(q)) * (F.col("n") - 1).cast("double")
        lo, hi = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        frac = pos - F.floor(pos)
        cols.append(F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac).alias(name))
    return out.select(*by, *cols)


def _brackets(qs):
    """Aggregates of the first scan: for each quantile the bounds of all widths, from one sketch."""
    sketch = F.kll_sketch_agg_bigint("_v", F.lit(SKETCH_K))
    ranks = lambda q: F.array(*[F.lit(float(min(max(q + side * w, 0.0), 1.0))) for _, w in WIDTHS for side in (-1, 1)])
    return [F.when(F.count("_v") > 0, F.kll_sketch_get_quantile_bigint(sketch, ranks(q))).alias(f"_b{i}") for i, q in enumerate(qs)]


def _pivot_rank(q, side):
    """The rank (from 0) below or above position q * (n - 1)."""
    pos = F.lit(float(q)) * (F.col("n") - 1).cast("double")
    return (F.floor(pos) if side == 0 else F.ceil(pos)).cast("long")


def _bracketed(v: DataFrame, stats: DataFrame, by, qs, names) -> DataFrame:
    """Exact order statistics from the brackets in ``stats`` and one more scan of the rows."""
    spark, m = v.sparkSession, len(qs)
    level = F.lit(len(WIDTHS) - 1)
    for i, (least, _) in reversed(list(enumerate(WIDTHS[:-1]))):
        level = F.when(F.col("n") >= least, i).otherwise(level)
    todo, out = stats.filter(F.col("n") > 0).withColumn("_level", level), None
    last = F.col("_level") == len(WIDTHS) - 1
    while True:
        bound = lambda i, side, edge: F.when(last, F.col(edge)).otherwise(
            F.element_at(f"_b{i}", 2 * F.col("_level") + 1 + side)).alias(f"_{'lh'[side]}{i}")
        ends = todo.select(*_keys(by), "n", *[bound(i, s, e) for i in range(m) for s, e in ((0, "mn"), (1, "mx"))])
        inside = [F.col("_v").between(F.col(f"_l{i}"), F.col(f"_h{i}")) for i in range(m)]
        some = inside[0]
        for x in inside[1:]:
            some = some | x
        zone = sum([(F.col("_v") < F.col(f"_l{i}")).cast("int") for i in range(m)], F.lit(0))  # lower bounds rise with q
        rows = join_small(v, ends.drop("n"), by)
        counts = rows.select(*_keys(by), F.when(some, F.col("_v")).alias("_v"), zone.alias("_zone"))
        counts = written(spark, counts.groupBy(*by, "_zone", "_v").agg(F.count(F.lit(1)).alias("_c")), "quantile-values")

        sums = [F.sum(F.when(F.col("_zone") >= m - i, F.col("_c")).otherwise(0)).alias(f"_below{i}") for i in range(m)]
        below = counts.groupBy(*by).agg(*sums) if by else counts.agg(*sums)
        plan = join_small(ends, below, by)
        t = join_small(counts.filter(F.col("_v").isNotNull()), plan, by)
        run = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = [F.sum(F.when(x, F.col("_c")).otherwise(0)).over(run) + F.col(f"_below{i}") for i, x in enumerate(inside)]
        t = t.select("*", *[u.alias(f"_upto{i}") for i, u in enumerate(upto)])
        at = [F.min(F.when(inside[i] & (F.col(f"_upto{i}") > _pivot_rank(q, side)) & (F.col(f"_below{i}") <= _pivot_rank(q, side)),
                           F.col("_v"))).alias(f"_s{2 * i + side}") for i, q in enumerate(qs) for side in (0, 1)]
        found = t.groupBy(*by).agg(F.first("n").alias("n"), *at) if by else t.agg(F.first("n").alias("n"), *at)
        missed = F.lit(False)
        for k in range(2 * m):
            missed = missed | F.col(f"_s{k}").isNull()
        found = written(spark, found.withColumn("_missed", missed), "quantile-found")
        hit = found.filter(~F.col("_missed"))
        out = hit if out is None else out.unionByName(hit)
        again = found.filter("_missed")
        if again.isEmpty():
            break
        # a rank outside its bracket: the next width
        todo = written(spark, join_small(todo, again.select(*by, "_missed"), by).drop("_missed").withColumn(
            "_level", F.col("_level") + 1), "quantile-again")
    cols = []
    for i, (q, name) in enumerate(zip(qs, names)):
        pos = F.lit(float(q)) * (F.col("n") - 1).cast("double")
        lo, hi = F.col(f"_s{2 * i}").cast("double"), F.col(f"_s{2 * i + 1}").cast("double")
        frac = pos - F.floor(pos)
        cols.append(F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac).alias(name))
    return out.select(*_keys(by), *cols)


def group_quantiles_paise(df: DataFrame, by: list[str], qs, names, method: str = "exact",
                          accuracy: int = 100_000) -> DataFrame:
    """Per key: the given quantiles of Amount in paise (DOUBLE) plus ``n_nonnull`` and ``n_rows``.

    ``method``: 'exact', 'radix' (exact too) or 'sketch' (see module docstring); ``qs`` rise. The result is a written table.
    """
    if method not in ("exact", "radix", "sketch"):
        raise ValueError(f"unknown quantile method {method!r}")
    if list(qs) != sorted(qs):
        raise ValueError("quantiles must rise")
    spark = df.sparkSession
    src = drop_null_keys(df, by)
    paise = F.round(F.col("Amount") * 100).cast("long")
    v = src.select(*_keys(by), paise.alias("_v"))
    aggs = [F.count("_v").alias("n"), F.count(F.lit(1)).alias("n_rows"), F.min("_v").alias("mn"), F.max("_v").alias("mx"),
            *(_brackets(qs) if method == "exact" else [])]
    stats = v.groupBy(*by).agg(*aggs) if by else v.agg(*aggs)
    stats = written(spark, stats.withColumn("bits", F.length(F.bin(F.col("mx") - F.col("mn"))).cast("int")),
                    "quantile-stats")
    v = v.filter(F.col("_v").isNotNull())
    if method == "sketch":
        q = _sketch(v, by, qs, names, accuracy)
    else:
        q = (_bracketed if method == "exact" else _radix)(v, stats, by, qs, names)
    base = stats.select(*by, F.col("n").alias("n_nonnull"), "n_rows")
    return written(spark, join_small(base, q, by, "left"), "quantiles")
