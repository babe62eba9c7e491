"""Isolation forest (Liu, Ting & Zhou 2008) on the feature matrix, distributed.

Fit: rows are counted by a digest of their content. How many copies of a row enter the pool is one draw from the binomial
distribution of its count, by a hash of the digest: a row repeated a billion times weighs what it should, yet only drawn
copies ever exist as rows. Each pool row joins tree ``t`` when a second hash falls under a rate, and every tree keeps its
``psi`` (256) lowest-hash rows - so a tree never sees more than psi rows and the pool size does not grow with the data.
Trees are grown per group with ``applyInPandas`` (numpy), and only the nodes (<= trees x (2 psi - 1) rows) come to the
driver. A forest is a table of nodes (``node_table``) that can be saved, loaded and walked by SQL.

Scoring broadcasts the nodes and runs per Arrow batch with ``mapInArrow``. A row travels as the indexes and values of its
sparse vector; each split rules out leaves of the rows that it sends right, so its cost follows the entries, and only trees of
many leaves are walked. The cut-off is the ``contamination`` quantile of the training scores (``percentile_approx``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..operators.common import attach_row

#: A forest as a table: split nodes have a feature, leaves have -1 and their path length (depth + c(size)).
TABLE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int, depth int")
EULER = 0.5772156649015329


def average_path_length(n) -> np.ndarray:
    """c(n): average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(seed: int, psi: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        rng = np.random.default_rng([seed, tree])
        max_depth = int(math.ceil(math.log2(max(len(x), 2))))
        rows, stack = [], [(0, np.arange(len(x)), 0)]
        next_id = 1
        while stack:
            node, idx, depth = stack.pop()
            sub = x[idx]
            feat, thr, left, right = -1, 0.0, -1, -1
            if depth < max_depth and len(idx) > 1:
                lo, hi = sub.min(axis=0), sub.max(axis=0)
                cand = np.flatnonzero(hi > lo)
                if len(cand):
                    feat = int(rng.choice(cand))
                    thr = float(rng.uniform(lo[feat], hi[feat]))
                    go_left = sub[:, feat] <= thr
                    left, right = next_id, next_id + 1
                    next_id += 2
                    stack.append((right, idx[~go_left], depth + 1))
                    stack.append((left, idx[go_left], depth + 1))
            rows.append((tree, node, feat, thr, left, right, len(idx), depth))
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    return grow


@dataclass
class IsolationForestModel:
    feature: np.ndarray    # (trees, nodes) split feature, -1 on leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf_path: np.ndarray  # depth + c(size) on leaves
    psi: int
    offset: float = 0.0


def binomial_draw(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Smallest k with P(X <= k) >= u for X binomial of n and p: the inverse distribution function.

    Means up to 50 are summed up term by term; beyond, the normal law with its skewness correction is used.
    """
    n, u = np.asarray(n, dtype=np.int64), np.asarray(u, dtype=float)
    if p >= 1:
        return n.copy()
    k = np.zeros(len(n), dtype=np.int64)
    if p <= 0:
        return k
    mean = n * p
    for i in np.flatnonzero(mean > 50):
        z, sd = NormalDist().inv_cdf(min(max(u[i], 1e-15), 1 - 1e-15)), math.sqrt(mean[i] * (1 - p))
        k[i] = min(max(math.ceil(mean[i] + z * sd + (1 - 2 * p) * (z * z - 1) / 6 - 0.5), 0), n[i])
    on = np.flatnonzero(mean <= 50)
    term = np.exp(n[on] * np.log1p(-p))
    upto = term.copy()
    while True:
        more = (upto < u[on]) & (k[on] < n[on])
        on, term, upto = on[more], term[more], upto[more]
        if not len(on):
            return k
        term = term * (n[on] - k[on]) / (k[on] + 1) * (p / (1 - p))
        k[on] += 1
        upto = upto + term


def _draw(p: float):
    def draw(n: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(binomial_draw(n.to_numpy(), p, u.to_numpy()))
    return draw


def draw_pool(df: DataFrame, key_cols: list[str], rate: float, seed: int, features_col: str = "features",
              weight_col: str | None = None) -> DataFrame:
    """Rows drawn at ``rate``, a row each drawn copy: _d1, _d2 (digest of the keys), _copy (from 1) and the features.

    A row stands for ``weight_col`` copies (one without it). The result is a written table.
    """
    from ..session import written
    keys = [F.col(f"`{c}`") for c in key_cols]
    known = [k.isNull() for k in keys]  # a null leaves a hash unchanged
    digest = [F.xxhash64(F.lit(1), *keys, *known).alias("_d1"), F.xxhash64(F.lit(2), *known, *reversed(keys)).alias("_d2")]
    weight = F.col(f"`{weight_col}`").cast("long") if weight_col else F.lit(1).cast("long")
    counted = df.select(*digest, weight.alias("_w")).groupBy("_d1", "_d2").agg(F.sum("_w").alias("_n"))
    u = (F.pmod(F.xxhash64("_d1", "_d2", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    counted = counted.filter(F.col("_n") > 0).withColumn("_u", u)
    if rate < 1:  # no copy is drawn when u is within the chance of none: most rows end here, in generated code
        counted = counted.filter(F.col("_u") > F.exp(F.col("_n") * math.log1p(-rate)))
    k = F.pandas_udf(_draw(rate), "long")("_n", "_u")
    drawn = counted.select("_d1", "_d2", k.alias("_k")).filter("_k > 0")
    drawn = written(df.sparkSession, drawn, "iforest-drawn")  # about rate x rows: the pool's size, whatever the data's
    rows = df.select(*digest, F.col(features_col)).join(F.broadcast(drawn), ["_d1", "_d2"])
    rows = rows.groupBy("_d1", "_d2").agg(F.first("_k").alias("_k"), F.first(features_col).alias(features_col))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))).alias("_copy")
    return written(df.sparkSession, rows.select("_d1", "_d2", copies, features_col), "iforest-pool")


def fit(df: DataFrame, key_cols: list[str], features_col: str = "features", t: Thresholds = DEFAULT,
        n_trees: int = 100, psi: int = 256, oversample: float = 3.0, weight_col: str | None = None) -> IsolationForestModel:
    """A forest on the rows of ``df``; rows with equal ``key_cols`` are copies of one row.

    ``weight_col``, if given, says how many copies a row stands for. Draws hash row content and copy number only: a fixed
    seed gives the same forest for any partition count.
    """
    from ..session import ship_package
    ship_package(df.sparkSession)
    n = df.count() if weight_col is None else int(df.agg(F.sum(f"`{weight_col}`")).first()[0] or 0)
    # psi rows per tree, the method's own subsample, in two Bernoulli steps over every copy: into the pool, then into trees
    pool_rate = min(1.0, oversample * n_trees * psi / max(n, 1))
    tree_rate = min(1.0, oversample * psi / max(1.0, n * pool_rate))
    scale = 2 ** 31
    pool = draw_pool(df, key_cols, pool_rate, t.seed, features_col, weight_col)
    pool = pool.withColumn("_rid", F.xxhash64("_d1", "_d2", "_copy"))
    # tree membership is decided on ids only; vectors join back after the cut to psi rows
    member = pool.select("_rid", "_d1", "_d2", "_copy").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    member = member.withColumn("_h", F.xxhash64("_d1", "_d2", "_copy", F.col("tree"), F.lit(t.seed + 1)))
    member = member.filter(F.pmod(F.col("_h"), F.lit(scale)) < int(tree_rate * scale))
    member = member.withColumn("_rn", F.row_number().over(Window.partitionBy("tree").orderBy("_h", "_rid")))
    member = member.filter(F.col("_rn") <= psi).select("tree", "_rid")
    sample = member.join(pool.select("_rid", features_col), "_rid").select(
        "tree", vector_to_array(features_col, "float32").alias("x"))  # float32 like the usual forest
    nodes = sample.groupBy("tree").applyInPandas(_grow(t.seed, psi), NODE_SCHEMA).toPandas()
    nodes["path"] = nodes["depth"] + average_path_length(nodes["size"].to_numpy())
    return _pack(nodes, min(psi, max(n, 1)))


def node_table(spark: SparkSession, model: IsolationForestModel) -> DataFrame:
    """The forest's nodes (``TABLE_SCHEMA``); a node that no split leads to has no row."""
    rows = []
    for tree in range(model.feature.shape[0]):
        todo = [0]
        while todo:
            k = todo.pop()
            split = int(model.feature[tree, k]) >= 0
            left, right = (int(model.left[tree, k]), int(model.right[tree, k])) if split else (-1, -1)
            rows.append((tree, k, int(model.feature[tree, k]), float(model.threshold[tree, k]), left, right,
                         0.0 if split else float(model.leaf_path[tree, k])))
            todo += [left, right] if split else []
    return spark.createDataFrame(rows, TABLE_SCHEMA)


def from_node_table(nodes: DataFrame, psi: int, offset: float = 0.0) -> IsolationForestModel:
    """A forest from its node table (bounded: trees x (2 psi - 1) rows reach the driver)."""
    model = _pack(nodes.select("tree", "node", "feature", "threshold", "left", "right", "path").toPandas(), psi)
    model.offset = float(offset)
    return model


def save_forest(spark: SparkSession, model: IsolationForestModel, path: str) -> None:
    """Write the node table and one row of psi and cut-off below ``path``, replacing a forest saved there."""
    node_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/nodes")
    meta = spark.createDataFrame([(int(model.psi), float(model.offset))], "psi int, offset double")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/meta")


def load_forest(spark: SparkSession, path: str) -> IsolationForestModel | None:
    """The forest saved at ``path``; None when there is none. A damaged one raises."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/meta/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    meta = spark.read.parquet(f"{path.rstrip('/')}/meta").first()
    return from_node_table(spark.read.parquet(f"{path.rstrip('/')}/nodes"), meta["psi"], meta["offset"])


def _pack(nodes: pd.DataFrame, psi: int) -> IsolationForestModel:
    trees = sorted(nodes["tree"].unique())
    width = int(nodes["node"].max()) + 1 if len(nodes) else 1
    shape = (len(trees), width)
    feat = np.full(shape, -1, dtype=np.int32)
    thr = np.zeros(shape)
    left = np.zeros(shape, dtype=np.int32)
    right = np.zeros(shape, dtype=np.int32)
    leaf = np.zeros(shape)
    pos = {tr: i for i, tr in enumerate(trees)}
    ti = nodes["tree"].map(pos).to_numpy()
    ni = nodes["node"].to_numpy()
    feat[ti, ni] = nodes["feature"].to_numpy()
    thr[ti, ni] = nodes["threshold"].to_numpy()
    left[ti, ni] = np.maximum(nodes["left"].to_numpy(), 0)
    right[ti, ni] = np.maximum(nodes["right"].to_numpy(), 0)
    leaf[ti, ni] = nodes["path"].to_numpy()
    return IsolationForestModel(feat, thr, left, right, leaf, psi)


#: Rows walked through all trees together: their features stay in the processor's cache.
WALK_ROWS = 2_000
#: Leaves of a tree that the bits of one word stand for; larger trees are walked.
WORD_LEAVES = 64


def _walk(m: IsolationForestModel, tr: int) -> tuple:
    """Features, thresholds, children and path lengths of a tree's nodes, and the steps to its deepest leaf."""
    here = np.arange(m.feature.shape[1])
    leaf = m.feature[tr] < 0
    child = np.empty(2 * len(here), dtype=np.int64)  # of node k: 2k left, 2k + 1 right
    child[0::2], child[1::2] = np.where(leaf, here, m.left[tr]), np.where(leaf, here, m.right[tr])
    reached, depth = np.zeros(1, dtype=np.int64), 0
    while len(reached := reached[~leaf[reached]]):
        reached, depth = np.unique(np.concatenate([child[2 * reached], child[2 * reached + 1]])), depth + 1
    return np.maximum(m.feature[tr], 0).astype(np.int64), m.threshold[tr], child, m.leaf_path[tr], depth


def _walked(walk: tuple, part: np.ndarray) -> np.ndarray:
    """Path length of each row in one tree; every row takes as many steps as the deepest, a leaf leading to itself."""
    feature, threshold, child, path, depth = walk
    flat, row = part.ravel(), np.arange(len(part)) * part.shape[1]
    node = np.zeros(len(part), dtype=np.int64)
    for _ in range(depth):
        left = flat.take(row + feature.take(node)) <= threshold.take(node)
        node = child.take(2 * node + ~left)
    return path.take(node)


def _path_lengths(m: IsolationForestModel, x: np.ndarray) -> np.ndarray:
    """Mean path length of each row over the trees, walked node by node."""
    n, trees = len(x), m.feature.shape[0]
    walks = [_walk(m, tr) for tr in range(trees)]
    total = np.zeros(n)
    for start in range(0, n, WALK_ROWS):
        part = np.ascontiguousarray(x[start:start + WALK_ROWS])
        some = np.zeros(len(part))
        for walk in walks:
            some += _walked(walk, part)
        total[start:start + WALK_ROWS] = some
    return total / max(trees, 1)


def _leaf_words(m: IsolationForestModel) -> tuple[list, dict]:
    """The forest as words of leaves: each tree's leaf paths from left to right (None for more than ``WORD_LEAVES``), and by
    feature its split nodes as (tree, threshold, leaves that stay possible when a row goes right)."""
    paths, splits = [], {}
    for tr in range(m.feature.shape[0]):
        leaves, nodes, todo = [], [], [(0, None)]
        while todo:
            k, parent = todo.pop()
            if parent is not None:  # a right child: the leaves since its parent are left of it
                parent.append(len(leaves))
            if m.feature[tr, k] < 0:
                leaves.append(m.leaf_path[tr, k])
                continue
            nodes.append([int(m.feature[tr, k]), float(m.threshold[tr, k]), len(leaves)])
            todo += [(int(m.right[tr, k]), nodes[-1]), (int(m.left[tr, k]), None)]
        paths.append(np.array(leaves) if len(leaves) <= WORD_LEAVES else None)
        if paths[-1] is not None:
            for feature, threshold, first, end in nodes:
                word = ((1 << len(leaves)) - 1) & ~((1 << end) - (1 << first))
                splits.setdefault(feature, []).append((tr, threshold, np.uint64(word)))
    return paths, splits


def _entry_path_lengths(m: IsolationForestModel, words: tuple[list, dict], width: int, n: int, row, at, flat) -> np.ndarray:
    """``_path_lengths`` of ``n`` rows given by their entries (row, feature, value); an absent one is 0.

    A row's leaf is the leftmost one that no split to the right rules out. So a split costs only the rows it sends right, and
    with sparse rows these are few; the order of its tests does not matter.
    """
    paths, splits = words
    order = np.argsort(at.astype(np.uint16) if width < 1 << 16 else at, kind="stable")
    row, at, flat = row[order], at[order], flat[order]
    ends = np.searchsorted(at, np.arange(width + 1))
    possible = [None if p is None else np.full(n, (1 << len(p)) - 1, dtype=np.uint64) for p in paths]
    for feature, nodes in splits.items():
        rows, values = row[ends[feature]:ends[feature + 1]], flat[ends[feature]:ends[feature + 1]]
        for tr, threshold, word in nodes:
            left = values <= threshold
            if 0.0 <= threshold:
                right = rows[~left]
            else:  # a row without an entry goes right, too
                right = np.ones(n, dtype=bool)
                right[rows[left]] = False
            possible[tr][right] &= word
    if any(p is None for p in paths):
        x = np.zeros((n, width))
        x[row, at] = flat
    total = np.zeros(n)
    for tr, path in enumerate(paths):
        if path is None:
            walk = _walk(m, tr)
            for start in range(0, n, WALK_ROWS):
                total[start:start + WALK_ROWS] += _walked(walk, x[start:start + WALK_ROWS])
        else:
            p = possible[tr]
            total += path.take(np.bitwise_count((p & (~p + np.uint64(1))) - np.uint64(1)))
    return total / max(len(paths), 1)


def _used_entries(used: np.ndarray, indices, values) -> tuple:
    """(row, place of the feature in ``used``, value) of the entries of used features, from Arrow lists of a vector column's
    indexes (null for a dense vector) and values."""
    n = len(values)
    place = np.full(int(used[-1]) + 1 if len(used) else 0, -1)
    place[used] = np.arange(len(used))
    sparse = indices.is_valid().to_numpy(zero_copy_only=False)
    size = values.value_lengths().to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32).astype(np.float64)  # as the trees were grown
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    at[sparse[row]] = indices.flatten().to_numpy(zero_copy_only=False)
    known = at < len(place)
    row, at, flat = row[known], place[at[known]], flat[known]
    return row[at >= 0], at[at >= 0], flat[at >= 0]


def score(model: IsolationForestModel, df: DataFrame, keep: list[str], features_col: str = "features",
          t: Thresholds = DEFAULT) -> DataFrame:
    """Adds ``score_samples`` = -2^(-E[h(x)]/c(psi)) (higher is more normal); ``with_decision``
    then turns it into ``Anomaly_Score`` and ``Is_Anomaly_Predicted``."""
    from ..session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    cpsi = float(average_path_length([model.psi])[0]) or 1.0
    used = np.unique(model.feature[model.feature >= 0])
    place = np.zeros(int(used[-1]) + 1 if len(used) else 1, dtype=model.feature.dtype)
    place[used] = np.arange(len(used))
    small = replace(model, feature=np.where(model.feature >= 0, place[np.maximum(model.feature, 0)], -1))
    try:
        bc = spark.sparkContext.broadcast((small, used))  # node arrays: bounded by trees x (2 psi - 1)
        get_model = lambda: bc.value
    except Exception:  # noqa: BLE001 - remote session: the small arrays travel inside the function
        get_model = lambda: (small, used)
    vector = F.unwrap_udt(features_col)
    base = df.select(*[F.col(f"`{c}`") for c in keep], vector["indices"].alias("_i"), vector["values"].alias("_x"))
    out_schema = base.drop("_i", "_x").schema.add("score_samples", "double")
    names = [f.name for f in out_schema.fields]

    def run(batches):
        import pyarrow as pa
        m, features = get_model()
        words = _leaf_words(m)
        for rb in batches:
            if not rb.num_rows:
                continue
            entries = _used_entries(features, rb.column(len(names) - 1), rb.column(len(names)))
            s = -np.power(2.0, -_entry_path_lengths(m, words, len(features), rb.num_rows, *entries) / cpsi)
            yield pa.RecordBatch.from_arrays([*rb.columns[:len(names) - 1], pa.array(s, pa.float64())], names=names)

    return base.mapInArrow(run, out_schema)


def offset(scored: DataFrame, t: Thresholds = DEFAULT) -> float:
    """The contamination quantile of the training scores (bounded-memory sketch), as one scalar."""
    return float(scored.agg(F.percentile_approx("score_samples", t.contamination, 100_000)).first()[0])


def apply_offset(scored: DataFrame, off: float) -> DataFrame:
    """decision = score - offset; a row is an anomaly when its decision is below 0."""
    d = F.col("score_samples") - F.lit(off)
    return scored.select(*[c for c in scored.columns if c != "score_samples"], d.alias("Anomaly_Score"),
                         (d < 0).alias("Is_Anomaly_Predicted"))


def with_decision(scored: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Offset = contamination quantile of the scores; decision = score - offset; anomaly when below 0."""
    off = scored.agg(F.percentile_approx("score_samples", t.contamination, 100_000).alias("offset"))
    s = attach_row(scored, off)  # the cut-off is one scalar
    return s.select(*[c for c in scored.columns if c != "score_samples"],
                    (F.col("score_samples") - F.col("offset")).alias("Anomaly_Score"),
                    (F.col("score_samples") - F.col("offset") < 0).alias("Is_Anomaly_Predicted"))


def amount_only_features(df: DataFrame, out_col: str = "features") -> DataFrame:
    """The fallback feature vector when no feature pipeline is available: [log1p(Amount or 0)]."""
    from pyspark.ml.feature import VectorAssembler
    from .features import log_amount
    return VectorAssembler(inputCols=["_log_amount"], outputCol=out_col).transform(
        df.withColumn("_log_amount", log_amount(F.col("Amount")))).drop("_log_amount")
