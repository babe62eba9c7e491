"""Embedding near-dedup by an exact metric range join.

Vectors of equal label and length are scaled to length one, where a cosine of at least c is a Euclidean distance of at
most r = sqrt(2 - 2c). Equal vectors are one class first. Each large label gets pivots (vectors drawn by a hash); a class
lives in the cell of its nearest pivot p, its home. Another cell q can only hold a home within r of it if, by the triangle
inequality, its distance to q is at most the cell's radius plus r, and if it lies within r of the plane half-way between p
and q. The class is copied into exactly these cells. Every home then meets all its partners in its own cell, so the cells
are joined independently and each counts the links of its homes. Both bounds are widened by ``SLACK`` against rounding and
every link is confirmed by its cosine in double precision.

A cell of any size is joined in blocks of ``BLOCK`` homes and ``BLOCK`` members. A block returns one row for each home with
links and one edge for each member that its links connect, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .store import arrow_batches, bounded_broadcast, table, written

#: Classes that a cell should hold. A label gets a pivot for each so many of its classes.
CELL = 1_000
#: Pivots of one label, labels with pivots (the largest first) and components of all pivots: every task gets the pivots,
#: so their table is bounded at 8 MB. A label without pivots is one cell, joined in blocks like any other.
LABEL_PIVOTS, LARGE_LABELS, PIVOT_VALUES = 256, 4_096, 1_000_000
BLOCK = 1_000
SLACK = 1e-9


def valid_vector(vector: str | Column = "embedding") -> Column:
    """Whether a vector is not null, not empty and holds only finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_group(batch):
    """(label, size, indexes) of a batch's rows."""
    label, size = batch.column("label").to_pylist(), batch.column("size").to_numpy()
    groups = {}
    for i, key in enumerate(zip(label, size.tolist())):
        groups.setdefault(key, []).append(i)
    return [(key, np.array(own)) for key, own in groups.items()]


def _distances(x, pivots):
    """Distances of unit vectors to pivots, and each one's nearest pivot (ties to the first)."""
    d = np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))
    return d, d.argmin(axis=1)


def _radii(pivots):
    """Rows (label, size, cell, radius) of a batch's classes: how far a cell's homes are from its pivot."""
    def run(batches):
        for batch in batches:
            for (label, size), own in _by_group(batch):
                if (label, size) not in pivots:
                    continue
                d, home = _distances(_unit(_matrix(batch.column("vector").take(pa.array(own)))), pivots[(label, size)])
                cells, at = np.unique(home, return_inverse=True)
                far = np.zeros(len(cells))
                np.maximum.at(far, at, d[np.arange(len(d)), home])
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array([label] * len(cells), batch.column("label").type),
                    "size": np.full(len(cells), size, np.int32), "cell": cells.astype(np.int32), "radius": far})
    return run


def _dealer(pivots, radii, r):
    """Each class into its home cell and into every cell that may hold a home within r."""
    def run(batches):
        for batch in batches:
            for (label, size), own in _by_group(batch):
                x = _unit(_matrix(batch.column("vector").take(pa.array(own))))
                p = pivots.get((label, size))
                if p is None:
                    row, cell, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
                else:
                    d, home = _distances(x, p)
                    near = d[np.arange(len(x)), home]
                    apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[home]
                    # (d_q^2 - d_p^2) / (2 |pq|) is the distance to the plane between the pivots
                    into = (d ** 2 - near[:, None] ** 2 <= 2 * apart * (r + SLACK) + SLACK) & (
                        d <= radii[(label, size)] + r + SLACK)
                    into[np.arange(len(x)), home] = True
                    row, cell = np.nonzero(into)
                taken = pa.array(own[row])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(taken), batch.column("size").take(taken), pa.array(cell.astype(np.int32)),
                     pa.array(home[row] == cell), batch.column("node").take(taken), batch.column("copies").take(taken),
                     batch.column("vector").take(taken)], names=["label", "size", "cell", "home", "node", "copies", "vector"])
    return run


def _block_links(least: float):
    """Links between a block's homes and members: (a: home, b: null, n: weight of its links) and edges (a, b, 0)."""
    def run(key, block):
        home, node = block.column("home").to_numpy(), block.column("node").to_numpy()
        x, copies = _matrix(block.column("vector")), block.column("copies").to_numpy()
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        left, right = np.flatnonzero(home), np.flatnonzero(~home)
        cosine = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right])
        i, j = np.nonzero((cosine >= least) & (node[left][:, None] != node[right]))
        weight = np.bincount(i, copies[right[j]], len(left)).astype(np.int64)
        some = np.flatnonzero(weight)
        # smallest node that the block's links connect to each of its nodes
        kinds, at = np.unique(node, return_inverse=True)
        a, b, low = at[left[i]], at[right[j]], np.arange(len(kinds))
        while True:
            edge = np.minimum(low[a], low[b])
            new = low.copy()
            np.minimum.at(new, a, edge)
            np.minimum.at(new, b, edge)
            new = new[new]
            if np.array_equal(new, low):
                break
            low = new
        joined = np.flatnonzero(low != np.arange(len(kinds)))
        return pa.table({
            "a": pa.array(np.concatenate([node[left[some]], kinds[joined]]), pa.int64()),
            "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), kinds[low[joined]]]), pa.int64(),
                          mask=np.arange(len(some) + len(joined)) < len(some)),
            "n": pa.array(np.concatenate([weight[some], np.zeros(len(joined), np.int64)]), pa.int64())})
    return run


def _pivot_table(spark, classes, cell, label_pivots, values):
    """{(label, size): unit vectors} of the labels that are larger than one cell: at most ``values`` components."""
    sizes = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    sizes = sizes.withColumn("want", F.least(F.ceil(F.col("n") / cell), F.lit(label_pivots)).cast("int"))
    chosen, left = [], values
    for s in sizes.orderBy(F.desc("n"), "label", "size").limit(LARGE_LABELS).collect():
        want = min(s["want"], left // s["size"])
        if want >= 2:
            chosen.append((s["label"], s["size"], want))
            left -= want * s["size"]
    if not chosen:
        return {}
    kind = classes.schema["label"].dataType.simpleString()
    want = F.broadcast(spark.createDataFrame(chosen, f"label {kind}, size int, want int"))
    order = Window.partitionBy("label", "size").orderBy(F.xxhash64("vector"), "node")
    rows = classes.select("label", "size", "node", "vector").withColumn("r", F.row_number().over(order)).where(
        F.col("r") <= label_pivots).join(want, ["label", "size"]).where("r <= want")
    out = {}
    for row in rows.select("label", "size", "r", "vector").orderBy("label", "size", "r").collect():
        out.setdefault((row["label"], row["size"]), []).append(row["vector"])
    return {k: _unit(np.array(v, dtype=np.float64)) for k, v in out.items()}


def similar_vectors(spark: SparkSession, vectors: DataFrame, *, least: float = 0.93, cell: int = CELL, block: int = BLOCK,
                    label_pivots: int = LABEL_PIVOTS, pivot_values: int = PIVOT_VALUES) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id (smallest vec_id reachable by links) and kept.

    Rows are linked when their labels are equal and not null and the cosine is at least ``least`` (over 0). Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    Every row is a vector of its own: rows that repeat a vec_id are others to each other. A row without a vec_id takes no
    part: its component is null and it is kept. Columns other than vec_id, embedding and label are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    fits = valid_vector() & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(fits, F.lit(False)).alias("fits"))
    rows = rows.select("vec_id", "fits", F.xxhash64(F.lit(1), "label", "embedding").alias("h1"),
                       F.xxhash64(F.lit(2), "embedding", "label").alias("h2"), "label", F.col("embedding").alias("vector"))
    classes = rows.where("fits").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("vector").alias("vector"))
    classes = written(spark, classes.select("*", F.size("vector").alias("size"), F.monotonically_increasing_id().alias("node")),
                      "ranges-classes")
    arrow_batches(classes)
    members = classes.select("label", "size", "node", "copies", "vector")
    kind = classes.schema["label"].dataType.simpleString()
    item = classes.schema["vector"].dataType.simpleString()
    pivots = _pivot_table(spark, classes, cell, label_pivots, pivot_values)
    large = {}
    if pivots:
        large = {key: np.zeros(len(p)) for key, p in pivots.items()}
        found = members.mapInArrow(_radii(pivots), f"label {kind}, size int, cell int, radius double")
        for row in found.groupBy("label", "size", "cell").agg(F.max("radius").alias("radius")).collect():  # one for each pivot
            large[(row["label"], row["size"])][row["cell"]] = row["radius"]
    r = float(np.sqrt(2 - 2 * least))
    dealt = members.mapInArrow(_dealer(pivots, large, r),
                               f"label {kind}, size int, cell int, home boolean, node long, copies long, vector {item}")
    dealt = written(spark, dealt, "ranges-cells")
    cells = ["label", "size", "cell"]
    sizes = dealt.groupBy(*cells).agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("members"))
    sizes = written(spark, sizes.select(*cells, F.ceil(F.col("homes") / block).cast("int").alias("x"),
                                        F.ceil(F.col("members") / block).cast("int").alias("y")), "ranges-sizes")
    dealt = dealt.join(bounded_broadcast(sizes), cells)
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["node", "copies", "vector"]
    left = dealt.where("home").select(*cells, spot("x").alias("bx"), every("y").alias("by"), F.lit(True).alias("home"), *own)
    right = dealt.where("x > 0").select(*cells, every("x").alias("bx"), spot("y").alias("by"), F.lit(False).alias("home"), *own)
    links = left.unionByName(right).groupBy(*cells, "bx", "by").applyInArrow(_block_links(least), "a long, b long, n long")
    links = written(spark, links, "ranges-links")

    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(spark, links.where("b is not null").select("a", "b"))
    known = classes.select("h1", "h2", "rep", "copies", "node").join(counts, "node", "left").join(joined, "node", "left")
    known = known.select("h1", "h2", "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "node").alias("component"))
    least_id = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = written(spark, known.join(least_id, "component").select("h1", "h2", "n_links", "component_id"), "ranges-known")
    # rows that fit nothing must not meet a class of equal hashes
    out = rows.select("vec_id", *[F.when(F.col("fits"), F.col(h)).alias(h) for h in ("h1", "h2")]).join(known, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op12_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at a cosine of 0.93 inside equal labels."""
    return similar_vectors(spark, table(spark, sf_dir, "embeddings"))


#: DuckDB: every pair of a label is compared, then links are followed.
OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
o AS (SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id
      FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM o
"""
