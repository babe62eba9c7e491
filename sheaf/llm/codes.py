"""Vector code compression: product quantisation by exact integer k-means over Hilbert-sorted blocks.

A component becomes an integer, floor(1024 x). A vector is cut into equal parts, and every part position has a codebook of
its own. Parts are sorted by the place of their point on a Hilbert curve and written once as flat blocks of neighbouring
points; a block stores its box (smallest and largest component values) and the sum of its points. Each round works on the
blocks alone: the least and largest distance of an entry from the box bound its distance from every point inside, so only
entries whose least distance does not exceed the smallest largest distance can be nearest. One entry left takes the whole
block by its stored sum; else a small kernel compares the block's points with that shortlist, exactly, ties to the lower
index. Each task adds up its parts for each entry; a round shuffles only these sums and returns the codebooks.

All numbers are integers. The kernel multiplies them as doubles only where every product sum stays below 2^53, else as
64-bit integers, so both give the same exact distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import valid_vector
from .store import arrow_batches, bounded_broadcast, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points of a block: neighbours on the curve.
BLOCK = 256
#: Bits of a point's Hilbert place, spread over the part's components: at least one each, and at most all of its bits.
KEY_BITS, ALL_BITS = 64, 28
#: Integer components are held inside this bound (components of about 65,000), so that all sums fit 64 bits.
BOUND = 1 << 26


def integers(batch_column, dim: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of equally long lists, held inside +-BOUND."""
    if isinstance(batch_column, pa.ChunkedArray):
        batch_column = batch_column.combine_chunks()
    x = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -BOUND, BOUND).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates in [0, 2^bits), as rows of big-endian bytes.

    The coordinates are turned into the curve's own frame from the highest bit down: where a coordinate's bit is set the
    first coordinate's lower bits are flipped, else they are exchanged; a Gray code over all coordinates then orders them.
    """
    x = points.T.astype(np.uint32).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for i in range(dims):
            set_ = (x[i] >> np.uint32(b)) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint32)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(b)) & 1 == 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip
    planes = [(x[i] >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1) for i in range(dims)]
    return np.packbits(np.array(planes, dtype=np.uint8).T, axis=1) if len(planes) else np.zeros((len(points), 0), np.uint8)


def _extremes(dim, scale):
    """Smallest and largest value of every component, a row each, of a task's rows."""
    def run(batches):
        lo, hi = np.full(dim, BOUND), np.full(dim, -BOUND)
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("vector"), dim, scale)
                lo, hi = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
        yield pa.RecordBatch.from_pydict({"place": np.arange(dim, dtype=np.int32), "lo": lo.astype(np.int64), "hi": hi.astype(np.int64)})
    return run


def _cutter(dim, parts, scale, lo, hi, kind):
    """A row for each part of each vector: part, Hilbert place, row, vec_id and label (with the first part only), point."""
    size = dim // parts
    bits = min(max(1, KEY_BITS // size), ALL_BITS)
    shift = np.maximum(np.ceil(np.log2(np.maximum(hi - lo, 1) + 1)).astype(np.int64) - bits, 0)

    def run(batches):
        for batch in batches:
            x = integers(batch.column("vector"), dim, scale)
            grid = (x - lo) >> shift
            for p in range(parts):
                own = slice(p * size, (p + 1) * size)
                keys = hilbert_keys(grid[:, own], bits)
                ids, labels = (batch.column(c) if p == 0 else pa.nulls(len(x), batch.column(c).type) for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, np.int32)), _binary(keys), batch.column("row"), ids, labels,
                     _binary(x[:, own].astype(kind))], names=["part", "place", "row", "vec_id", "label", "point"])
    return run


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _points(column, size, kind):
    """Points of consecutive binary values."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0]:at[-1]]
    return data.view(kind).astype(np.int64).reshape(-1, size)


def _blocker(size, block, kind, id_type, label_type):
    """Neighbouring points of one part as one row: box, sum, and flat points with their rows, ids and labels."""
    columns = ["part", "row", "vec_id", "label", "point"]

    def emit(held):
        part = held.column("part").to_numpy()
        x = _points(held.column("point"), size, kind)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        out = {k: [] for k in ("part", "n", "lo", "hi", "sum", "points", "rows", "ids", "labels")}
        for a, b in ((i, min(i + block, end)) for start, end in zip(edges[:-1], edges[1:]) for i in range(start, end, block)):
            v = x[a:b]
            for name, value in (("part", int(part[a])), ("n", b - a), ("lo", v.min(axis=0).tolist()), ("hi", v.max(axis=0).tolist()),
                                ("sum", v.sum(axis=0).tolist()), ("points", v.astype(kind).tobytes()),
                                ("rows", held.column("row").slice(a, b - a).to_pylist()),
                                ("ids", held.column("vec_id").slice(a, b - a).to_pylist() if part[a] == 0 else None),
                                ("labels", held.column("label").slice(a, b - a).to_pylist() if part[a] == 0 else None)):
                out[name].append(value)
        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), longs, longs, longs, pa.binary(), longs, pa.list_(id_type), pa.list_(label_type)]
        return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, kinds)], names=list(out))

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(columns))
                rows += batch.num_rows
            if rows >= 16 * block:  # whole blocks go, the rest waits for its neighbours
                whole = pa.Table.from_batches(held).combine_chunks()
                keep = rows % block
                yield emit(whole.slice(0, rows - keep).to_batches()[0])
                held, rows = ([whole.slice(rows - keep).to_batches()[0]], keep) if keep else ([], 0)
        if rows:
            yield emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    return run


def shortlists(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(blocks x entries): whether an entry can be the nearest one (or tie) of a point in a block's box."""
    below, above = lo[:, None, :] - entries, entries - hi[:, None, :]
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def _far(lo, hi, entries):
    return max((int(np.abs(v).max()) for v in (lo, hi, entries) if v.size), default=0)


def nearest(points: np.ndarray, entries: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry (ties to the lower one) and the squared distance. ``far``: largest magnitude."""
    exact = 4 * far * far * max(points.shape[1], 1) < 1 << 53
    p, e = (points.astype(np.float64), entries.astype(np.float64)) if exact else (points, entries)
    d = (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(points)), best].astype(np.int64)


def _blocks(batch, size, kind):
    """A batch's blocks by part: part, the rows' indexes, and their boxes."""
    part = batch.column("part").to_numpy()
    lo, hi = (batch.column(c).flatten().to_numpy().reshape(-1, size) for c in ("lo", "hi"))
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        yield int(p), own, lo[own], hi[own]


def _summer(codebooks, size, kind):
    """One assignment round over a task's blocks: for each part and used entry the number and the sum of its points."""
    parts, entries, _ = codebooks.shape

    def run(batches):
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            sums = batch.column("sum").flatten().to_numpy().reshape(-1, size)
            numbers, flat = batch.column("n").to_numpy(), batch.column("points")
            for p, own, lo, hi in _blocks(batch, size, kind):
                far = _far(lo, hi, codebooks[p])
                for i, short in zip(own, shortlists(lo, hi, codebooks[p])):
                    some = np.flatnonzero(short)
                    if len(some) == 1:
                        total[p, some[0]] += sums[i]
                        count[p, some[0]] += numbers[i]
                        continue
                    x = _points(flat.slice(int(i), 1), size, kind)
                    best, _ = nearest(x, codebooks[p][some], far)
                    order = np.argsort(best, kind="stable")
                    used, first = np.unique(best[order], return_index=True)
                    total[p, some[used]] += np.add.reduceat(x[order], first, axis=0)
                    count[p, some[used]] += np.diff(np.append(first, len(x)))
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
             pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def _assigner(codebooks, size, kind, id_type, label_type):
    """Every part's code and squared distance: row, part, code, error; vec_id and label with the first part."""
    def run(batches):
        for batch in batches:
            flat = batch.column("points")
            for p, own, lo, hi in _blocks(batch, size, kind):
                far = _far(lo, hi, codebooks[p])
                for i, short in zip(own, shortlists(lo, hi, codebooks[p])):
                    some = np.flatnonzero(short)
                    best, d = nearest(_points(flat.slice(int(i), 1), size, kind), codebooks[p][some], far)
                    n = len(best)
                    ids, labels = (batch.column(c)[int(i)].values if p == 0 else pa.nulls(n, t)
                                   for c, t in (("ids", id_type), ("labels", label_type)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("rows")[int(i)].values, pa.array(np.full(n, p, np.int32)), ids, labels,
                         pa.array(some[best].astype(np.int32)), pa.array(d)], names=["row", "part", "vec_id", "label", "code", "error"])
    return run


def _joined(run):
    """Small batches of a task joined to larger ones."""
    def joined(batches):
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return joined


def codebook_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(spark: SparkSession, vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
               scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): per kept row vec_id, label, codes (array, one a part) and error; codebooks as parts x entries x size.

    Kept are vectors that are not null or empty, hold only finite components and are as long as the first kept one (by
    vec_id, nulls last, then components). The first ``entries`` rows in that order are the start of the codebooks (fewer rows
    make fewer entries). A length that ``parts`` does not divide is filled up with zeros. Every row is kept by itself, so
    repeated rows and repeated or null vec_ids are coded each. Integers are held inside +-2^26 (components of about 65,000).
    Columns other than vec_id, embedding and label are ignored. Without a kept row: no rows and no entries.
    """
    kept = vectors.select("vec_id", "label", F.col("embedding").alias("vector")).where(F.coalesce(valid_vector("vector"), F.lit(False)))
    id_kind, label_kind = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    start = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(1).collect()
    dim = len(start[0]["vector"]) if start else parts
    kept = kept.where(F.size("vector") == dim)
    start = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    wide = -(-dim // parts) * parts
    if wide != dim:
        kept = kept.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("double"), wide - dim)))
    size = wide // parts
    with np.errstate(over="ignore"):
        first = np.array([r["vector"] + [0.0] * (wide - dim) for r in start], dtype=np.float64).reshape(-1, wide)
        first = np.clip(np.floor(first * scale), -BOUND, BOUND).astype(np.int64)
    codebooks = np.ascontiguousarray(first.reshape(-1, parts, size).transpose(1, 0, 2))
    shape = f"vec_id {id_kind}, label {label_kind}, codes array<int>, error long"
    if not start:
        return spark.createDataFrame([], shape), codebooks

    arrow_batches(kept)
    found = kept.select("vector").mapInArrow(_extremes(wide, scale), "place int, lo long, hi long")
    found = found.groupBy("place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("place").collect()
    lo, hi = (np.array([r[c] for r in found], dtype=np.int64) for c in ("lo", "hi"))
    kind = "<i2" if max(-lo.min(), hi.max()) < 1 << 15 else "<i4"
    cut = kept.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _cutter(wide, parts, scale, lo, hi, kind),
        f"part int, place binary, row long, vec_id {id_kind}, label {label_kind}, point binary")
    order = cut.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, label_type = (to_arrow_type(kept.schema[c].dataType) for c in ("vec_id", "label"))
    blocks = written(spark, order.mapInArrow(
        _blocker(size, block, kind, id_type, label_type),
        f"part int, n int, lo array<long>, hi array<long>, sum array<long>, points binary, rows array<long>, "
        f"ids array<{id_kind}>, labels array<{label_kind}>"), "codes-blocks")

    for _ in range(rounds):
        sums = blocks.select("part", "n", "lo", "hi", "sum", "points").mapInArrow(
            _summer(codebooks, size, kind), "part int, entry int, n long, sums array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)])
        codebooks = codebooks.copy()
        for r in sums.collect():  # a row for each used entry
            codebooks[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]

    coded = blocks.select("part", "lo", "hi", "points", "rows", "ids", "labels").mapInArrow(
        _joined(_assigner(codebooks, size, kind, id_type, label_type)),
        f"row long, part int, vec_id {id_kind}, label {label_kind}, code int, error long")
    whole = coded.groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("error").alias("error"),
        *[F.max(F.when(F.col("part") == p, F.col("code"))).alias(f"c{p}") for p in range(parts)])
    return whole.select("vec_id", "label", F.array(*[f"c{p}" for p in range(parts)]).alias("codes"), "error"), codebooks


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in four parts of 256 entries after four rounds; errors by vector and by label."""
    rows, codebooks = compressed(spark, table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = written(spark, rows.select("vec_id", "label", code.alias("code"), "error"), "codes")
    by_label = written(spark, rows.groupBy("label").agg(F.try_sum("error").alias("label_error")), "codes-labels")
    total = bounded_broadcast(by_label.withColumnRenamed("label", "of"))
    return rows.join(total, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignments of every part with codebook ``e{n}``, and the codebook after it."""
    return f"""
d{n} AS (SELECT v.vec_id, v.part, e.entry, sum((v.x - e.x) * (v.x - e.x)) AS d
      FROM v JOIN e{n} e ON v.part = e.part AND v.place = e.place GROUP BY ALL),
a{n} AS MATERIALIZED (SELECT vec_id, part, min({{'d': d, 'e': entry}}) AS best FROM d{n} GROUP BY ALL),
m{n} AS (SELECT v.part, a.best.e AS entry, v.place, sum(v.x) AS total, count(*) AS n FROM v JOIN a{n} a ON v.vec_id = a.vec_id AND v.part = a.part GROUP BY ALL),
e{n + 1} AS MATERIALIZED (SELECT e.part, e.entry, e.place, coalesce(
      CAST((m.total - ((m.total % m.n) + m.n) % m.n) // m.n AS BIGINT), e.x) AS x
      FROM e{n} e LEFT JOIN m{n} m USING (part, entry, place)),"""


#: DuckDB: every part is compared with every entry in each round.
OP13_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS nth, len(embedding) // {PARTS} AS size
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, nth, size, unnest(embedding) AS f, unnest(range(len(embedding))) AS i FROM k),
v AS MATERIALIZED (SELECT vec_id, nth, i // size AS part, i % size AS place,
      CAST(floor(CAST(f AS DOUBLE) * {SCALE}) AS BIGINT) AS x FROM u),
e0 AS MATERIALIZED (SELECT part, nth AS entry, place, x FROM v WHERE nth < {ENTRIES}),{''.join(map(_round_sql, range(ROUNDS)))}
d AS (SELECT v.vec_id, v.part, e.entry, sum((v.x - e.x) * (v.x - e.x)) AS d
      FROM v JOIN e{ROUNDS} e ON v.part = e.part AND v.place = e.place GROUP BY ALL),
a AS (SELECT vec_id, part, min({{'d': d, 'e': entry}}) AS best FROM d GROUP BY ALL),
o AS (SELECT vec_id, string_agg(lpad(printf('%x', best.e), 2, '0'), '' ORDER BY part) AS code,
      CAST(sum(best.d) AS BIGINT) AS error FROM a GROUP BY vec_id),
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM e{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN k USING (vec_id) CROSS JOIN s
"""
