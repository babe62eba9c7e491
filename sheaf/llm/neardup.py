"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct word shingles (``width`` words; with fewer words, the whole sequence). Sets are
embedded as ``SKETCH`` minwise tokens. Each of ``trees`` independent trees puts a set into the node of one minwise
token; a node of more than ``small`` sets from more than one component branches on two further tokens chosen by the
node's own hash, again and again. Small nodes are compared exhaustively; larger nodes link every member to the
node's smallest member before they branch. A large mixed node is a family of texts that are all alike when most of its
members are linked to the smallest one, when it hardly shrinks by branching, or when it is left after ``depth`` levels.
A family does not branch: its members outside its largest component are compared exactly with all others, in blocks.
Every candidate is confirmed on the full sets.

Recall for a pair at similarity s: it meets in a tree's first node with probability s, so eight trees find a pair at
0.8 in small nodes with probability 1 - 0.2^8 = 0.999997. In branching nodes the pair survives a level with mean
2 x 0.8 > 1 children (extinction 0.0625 per tree), so it is missed by all eight trees with probability
(0.2 + 0.8 x 0.0625)^8 = 1.5e-5, taking tokens as independent. A pair that meets in a family's node is never missed.

Work stays linear in copies: equal sets are collapsed first, and members already linked are not compared again. A
node never emits all pairs of its members unless it holds at most ``small`` of them. A family's unlinked pairs are
compared one by one, without a cap, but a block of them emits at most one link for each class it joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .store import arrow_batches, bounded_broadcast, table, written
from .words import mix64, ragged, sequence_hash, slices, text_bytes, words

SKETCH = 64
TREES = 8
SMALL = 16
#: Branching levels below the first node. A node that is still large and mixed there is compared exactly.
DEPTH = 6
#: A large mixed node that keeps more than this share of its parent is compared exactly and not branched again.
STUCK = 0.75
#: A large mixed node with at least this share of its members linked to its smallest one is a family.
FAMILY = 0.5
#: Members and shingles of a family's chunk: two chunks are compared by one task.
CHUNK, CHUNK_ITEMS = 500, 500_000
#: A pair goes to the exact check when at least this share of its minwise tokens agree: 4 standard deviations
#: (sqrt(0.8 x 0.2 / 64) = 0.05) under 0.8, so a true pair is missed there with probability 1.3e-4 at exactly 0.8.
SIEVE = 0.6


def _shingles(buf, offsets, width):
    """(sorted distinct shingles of all texts, bounds) of a slice whose offsets start at 0."""
    h, at = words(buf, offsets)
    grams = sequence_hash(h, width)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(grams[a:b - width + 1]))
        elif b > a:
            sets.append(sequence_hash(h[a:b], b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds


def _sketcher(width: int, size: int):
    def run(batches):
        mult = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        add = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in slices(offs):
                sets, at = _shingles(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], width)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sketch = np.zeros((j - i, size), dtype=np.int32)
                if len(full):
                    for k in range(size):
                        low = np.minimum.reduceat(sets * mult[k] + add[k], at[full])
                        sketch[full, k] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
                ids = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest()
                       for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()),
                     pa.array(ids, pa.binary()), ragged(sketch.ravel(), np.arange(j - i + 1) * size, pa.int32())],
                    names=["doc_id", "n_shingles", "set_id", "sketch"])
    return run


def shingle_sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, set_id (16-byte digest of the set) and its minwise tokens."""
    return arrow_batches(docs).select("doc_id", "text").mapInArrow(
        _sketcher(width, SKETCH), "doc_id long, n_shingles long, set_id binary, sketch array<int>")


def _lister(width: int):
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in slices(offs):
                sets, at = _shingles(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).cast(pa.int64()),
                     ragged(sets.view(np.int64), at, pa.int64())], names=["id", "items"])
    return run


def _sieved(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose minwise tokens agree often enough."""
    a = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return (pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .where(agree >= SIEVE * SKETCH).select("a", "b", "na", "nb"))


def _confirmed(spark, docs, reps, pairs, width, percent):
    """Links of ``pairs`` that hold on the full sets. Only documents in a sieved pair are read again."""
    near = written(spark, _sieved(pairs, reps, percent), "neardup-pairs")
    ids = written(spark, near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "neardup-ids")
    texts = docs.select("doc_id", "text").where("text is not null").join(bounded_broadcast(ids), "doc_id", "left_semi")
    full = arrow_batches(texts).mapInArrow(_lister(width), "id long, items array<bigint>")
    # rows that repeat a doc_id: the set with the representative's size, once
    full = written(spark, full.dropDuplicates(["id", "items"]), "neardup-sets")
    a = full.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    b = full.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return written(spark, near.join(a, "a").join(b, "b")
                   .where(both * 100 >= percent * (F.size("ia") + F.size("ib") - both))
                   .select("a", "b").distinct(), "neardup-links")


def _compare(percent: int):
    """Links between a chunk of members outside the main component and a chunk of all: one for each pair of components."""
    def run(key, group):
        outside, ids, component = (group.column(c).to_numpy() for c in ("outside", "rep", "component"))
        lists = group.column("items").combine_chunks()
        items, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        kinds, code = np.unique(items, return_inverse=True)
        size, component, links = np.diff(at), component.copy(), []
        mark = np.zeros(len(kinds), dtype=bool)
        for a in np.flatnonzero(outside):
            other = np.flatnonzero(~outside & (component != component[a])
                                   & (100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a])))
            if not len(other):
                continue
            own, n = code[at[a]:at[a + 1]], size[other]
            mark[own] = True
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            both = np.add.reduceat(mark[code[np.repeat(at[other] - first, n) + np.arange(n.sum())]].astype(np.int64), first)
            mark[own] = False
            for b in other[100 * both >= percent * (size[a] + n - both)]:
                if component[b] != component[a]:
                    links.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
                    component[component == component[b]] = component[a]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})
    return run


def _family_links(spark, docs, stuck, labels, width, percent):
    """Exact links between the components of every family: nodes of ``stuck`` (key, rep, leader) that share members."""
    families = components(spark, stuck.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    members = _labelled(families.select(F.col("node").alias("rep"), F.col("component").alias("family")), labels)
    parts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    stats = parts.groupBy("family").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("most"))
    mixed = written(spark, stats.where("parts > 1").select("family", F.col("most.component").alias("main")), "neardup-families")
    members = written(spark, members.join(bounded_broadcast(mixed), "family"), "neardup-family")
    if members.isEmpty():
        return None
    ids = members.select(F.col("rep").alias("doc_id"))
    texts = docs.select("doc_id", "text").where("text is not null").join(bounded_broadcast(ids), "doc_id", "left_semi")
    full = arrow_batches(texts).mapInArrow(_lister(width), "id long, items array<bigint>").where(F.size("items") > 0)
    # rows that repeat a doc_id: every set of it, once
    full = written(spark, full.dropDuplicates(["id", "items"]).join(members, F.col("id") == F.col("rep")).select(
        "family", "rep", "component", (F.col("component") != F.col("main")).alias("outside"), "items"), "neardup-family-sets")
    chunks = lambda which: F.ceil(F.greatest(
        F.count(F.when(which, 1)) / CHUNK, F.sum(F.when(which, F.size("items"))) / CHUNK_ITEMS)).cast("int")
    chunks = full.groupBy("family").agg(chunks(F.col("outside")).alias("some"), chunks(F.lit(True)).alias("all"))
    dealt = full.join(bounded_broadcast(written(spark, chunks, "neardup-chunks")), "family")
    spot = lambda n: F.pmod(F.xxhash64("items"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("outside").select("family", spot("some").alias("x"), every("all").alias("y"), F.lit(True).alias("outside"),
                                         "rep", "component", "items")
    right = dealt.where("some > 0").select("family", every("some").alias("x"), spot("all").alias("y"), F.lit(False).alias("outside"),
                                           "rep", "component", "items")
    # dealt out by the pair of chunks: a family's tasks must not stay together
    links = left.unionByName(right).repartition("family", "x", "y").groupBy("family", "x", "y").applyInArrow(
        _compare(percent), "a long, b long")
    return written(spark, links.distinct(), "neardup-links")


def _merged(spark, labels, links):
    """Labels with the components of ``links`` joined: edges between components, then their smallest member."""
    ends = _labelled(links.select(F.col("a").alias("rep"), "b"), labels).select(F.col("component").alias("ca"), "b")
    ends = _labelled(ends.select(F.col("b").alias("rep"), "ca"), labels)
    merged = components(spark, ends.select(F.col("ca").alias("a"), F.col("component").alias("b"))).toDF("old", "new")
    known = labels.join(merged, labels.component == merged.old, "left").select(
        "node", F.coalesce("new", "component").alias("component"))
    alone = merged.select(F.col("old").alias("node"), F.col("new").alias("component"))
    return written(spark, known.unionByName(alone).distinct(), "neardup-labels")


def _labelled(nodes, labels):
    return nodes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))


def _mixed(members):
    """Members of nodes that hold more than one component, with the sizes of node and parent and its smallest member."""
    stats = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"), F.min("component").alias("lo"),
                                       F.max("component").alias("hi"), F.min(F.struct("rep", "component")).alias("top"))
    return members.drop("parent").join(stats.where("lo < hi"), "key").select("key", "rep", "component", "n", "parent",
                                                              F.col("top.rep").alias("leader"),
                                                              F.col("top.component").alias("leader_component"))


def _cross_pairs(mixed, small):
    few = mixed.where(F.col("n") <= small)
    a = few.select("key", F.col("rep").alias("a"), F.col("component").alias("ca"))
    b = few.select("key", F.col("rep").alias("b"), F.col("component").alias("cb"))
    inside = a.join(b, "key").where("a < b and ca != cb").select("a", "b")
    stars = mixed.where((F.col("n") > small) & (F.col("component") != F.col("leader_component")))
    return inside.unionByName(stars.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")))


def near_duplicates(spark: SparkSession, docs: DataFrame, *, width: int = 5, percent: int = 80, trees: int = TREES,
                    small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest linked doc_id) and kept.

    Two documents are linked when ``100 * intersection >= percent * union`` of their full sets. Null or empty texts
    have an empty set and no link. Rows that repeat a doc_id count as one document (of several sets). A null doc_id
    takes no part: its component is null and it is kept. Columns other than doc_id and text are ignored.
    """
    rows = written(spark, shingle_sketches(docs, width), "neardup-rows")
    reps = (rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_id")
            .agg(F.min(F.struct("doc_id", "n_shingles")).alias("r"), F.first("sketch").alias("sketch")))
    reps = written(spark, reps.select("set_id", F.col("r.doc_id").alias("rep"),
                                      F.col("r.n_shingles").alias("n_shingles"), "sketch"), "neardup-reps")
    tokens = F.array(*[F.xxhash64(F.lit(t), F.col("sketch")[t]) for t in range(trees)])
    nodes = reps.select("rep", F.explode(tokens).alias("key"))

    lead = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).where("n > 1")
    stars = nodes.join(lead, "key").where("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    stars = written(spark, stars.distinct(), "neardup-stars")
    links = _confirmed(spark, docs, reps, stars, width, percent)
    labels = written(spark, components(spark, links), "neardup-labels")

    # every level's members and pairs are written: no plan spans the levels
    mixed = written(spark, _mixed(_labelled(nodes, labels).withColumn("parent", F.lit(None).cast("long"))), "neardup-mixed")
    pairs = written(spark, _cross_pairs(mixed, small), "neardup-level")
    stuck = mixed.limit(0).select("key", "rep", "leader")
    for level in range(depth + 1):
        large = mixed.where(F.col("n") > small)
        if large.isEmpty():
            break
        linked = large.groupBy("key").agg(F.avg((F.col("component") == F.col("leader_component")).cast("double")).alias("linked"))
        large = written(spark, large.join(linked, "key"), "neardup-large")  # read three times
        still = F.lit(True) if level == depth else (F.col("linked") >= FAMILY) | F.coalesce(
            F.col("n") > STUCK * F.col("parent"), F.lit(False))
        stuck = stuck.unionByName(large.where(still).select("key", "rep", "leader"))
        large = large.where(~still).select("key", "rep", "component", F.col("n").alias("parent"))
        if large.isEmpty():
            break
        rest = SKETCH - trees
        spot = [F.pmod(F.xxhash64(F.lit(k), F.col("key")), F.lit(rest)).cast("int") + trees for k in range(2)]
        child = F.array(*[F.xxhash64(F.lit(k), F.col("key"), s, F.col("sketch")[s]) for k, s in enumerate(spot)])
        deeper = large.join(reps.select("rep", "sketch"), "rep").select(
            F.explode(child).alias("key"), "rep", "component", "parent")
        # read twice: rows branch once a level
        mixed = written(spark, _mixed(written(spark, deeper, "neardup-branches")), "neardup-mixed")
        pairs = pairs.unionByName(written(spark, _cross_pairs(mixed, small), "neardup-level"))
    more = _confirmed(spark, docs, reps, pairs.distinct().join(stars, ["a", "b"], "left_anti"), width, percent)
    if not more.isEmpty():
        labels = _merged(spark, labels, more)
    if not stuck.isEmpty():
        rest = _family_links(spark, docs, stuck, labels, width, percent)
        if rest is not None and not rest.isEmpty():
            labels = _merged(spark, labels, rest)

    known = reps.select("set_id", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("set_id", F.coalesce("component", "rep").alias("set_component"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(known, "set_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("set_component", "doc_id"))
                     .alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents over 4-word shingles at similarity 0.8."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"), width=4)


#: DuckDB: every pair of distinct sets that share a shingle is compared exactly, then links are followed.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
      ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.other = p.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c USING (doc_id)
"""
