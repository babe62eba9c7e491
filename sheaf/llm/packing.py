"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm on islands.

Documents are tokenized, closed with ``END`` and cut only when longer than a sequence. Pieces as long as a sequence
are sequences of their own. The others are dealt by hash into shards of about ``SHARD_PIECES``. A shard is packed by
``ISLANDS`` independent populations. A child takes whole well-filled sequences of one parent, drops the other parent's
sequences that hold one of their pieces, and best-fits the displaced pieces. After each epoch every island's elite
migrates to the next island (a shuffle). Sequences that end up under ``LOOSE`` full are opened and their pieces packed
again with those of other shards, until one shard holds them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import arrow_batches, table, written
from .tokens import counter
from .words import slices, text_bytes

CAPACITY = 2048
END = 0
SHARD_PIECES = 4000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 5
POPULATION = 4
LOOSE = 0.98

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, capacity: int, keep_ids: bool):
    def run(batches):
        encode = counter(path)
        for batch in batches:
            _, offs = text_bytes(batch.column("text"))
            for i, j in slices(offs):
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode.encode(texts)):
                    ids = np.append(ids, END).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at:at + capacity]
                        rows["doc_id"].append(doc)
                        rows["piece"].append(k)
                        rows["start"].append(at)
                        rows["length"].append(len(own))
                        rows["ids_crc32"].append(zlib.crc32(own.tobytes()))
                        rows["ids"].append(own.astype(np.int32) if keep_ids else None)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [pa.array(v, k) for v, k in zip(rows.values(), kinds)]
                n = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays(arrays[:n], names=list(rows)[:n])
    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every text (null: empty) with place, length and checksum, and the ids on request."""
    schema = PIECE + (", ids array<int>" if keep_ids else "")
    return arrow_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_cutter(path, capacity, keep_ids), schema)


class _Packing:
    """Sequences of piece numbers; ``lengths`` is in falling order."""

    def __init__(self, lengths, capacity, bins):
        self.lengths, self.capacity, self.bins = lengths, capacity, bins
        self.fill = [sum(lengths[i] for i in b) for b in bins]

    def best_fit(self, pieces):
        """Put each piece into the fullest sequence that has room."""
        room = sorted((self.capacity - f, k) for k, f in enumerate(self.fill) if f < self.capacity)
        for i in pieces:
            size = self.lengths[i]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, k = room.pop(at)
                self.bins[k].append(i)
                self.fill[k] += size
                left -= size
            else:
                k, left = len(self.bins), self.capacity - size
                self.bins.append([i])
                self.fill.append(size)
            if left:
                insort(room, (left, k))
        return self

    def rank(self):
        return len(self.bins), -sum(f * f for f in self.fill)

    def child(self, other, rng):
        """Whole well-filled sequences of ``other`` go into a copy of this packing; displaced pieces are best-fitted."""
        full = np.array(other.fill) / self.capacity
        take = np.flatnonzero(rng.random(len(full)) < 0.6 * full ** 8)
        inside = {i for k in take for i in other.bins[k]}
        kept, displaced = [], []
        for b in self.bins:
            if inside.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in inside]
        loosest = sorted(range(len(kept)), key=lambda k: sum(self.lengths[i] for i in kept[k]))[:2]
        for k in loosest:  # mutation: open the emptiest sequences too
            displaced += kept[k]
        kept = [b for k, b in enumerate(kept) if k not in loosest]
        out = _Packing(self.lengths, self.capacity, kept + [list(other.bins[k]) for k in take])
        return out.best_fit(sorted(displaced))

    def genes(self):
        out = np.zeros(len(self.lengths), dtype=np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out


def _from_genes(lengths, capacity, genes):
    bins = [[] for _ in range(int(max(genes)) + 1)]
    for i, k in enumerate(genes):
        bins[k].append(i)
    return _Packing(lengths, capacity, bins)


def _evolve(lengths, capacity, seeds, rng):
    """A population grown from given packings; stops at the bound ceil(sum / capacity)."""
    bound = -(-sum(lengths) // capacity)
    n = len(lengths)
    people = list(seeds)
    if not people:
        people = [_Packing(lengths, capacity, []).best_fit(range(n))]
    while len(people) < POPULATION and min(p.rank()[0] for p in people) > bound:
        order = np.argsort(np.arange(n) + rng.normal(0, n / 20, n), kind="stable")
        people.append(_Packing(lengths, capacity, []).best_fit(order.tolist()))
    people.sort(key=_Packing.rank)
    for _ in range(GENERATIONS):
        if people[0].rank()[0] <= bound or len(people) < 2:
            break
        for _ in range(POPULATION):
            a, b = rng.choice(len(people), 2, replace=False)
            people.append(people[a].child(people[b], rng))
        people = sorted(people, key=_Packing.rank)[:POPULATION]
    return people[0]


_ORDER = ["length", "doc_id", "piece", "start", "ids_crc32"]


def _ordered(pdf):
    return pdf.sort_values(_ORDER, ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)


def _settle(capacity):
    def run(key, pdf):
        lengths = sorted(pdf["length"].astype(int).tolist(), reverse=True)
        best = _evolve(lengths, capacity, [], np.random.default_rng([int(key[0]), int(key[1]), 1]))
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "lengths": [np.array(lengths, np.int32)],
                             "genes": [best.genes()], "bins": [len(best.bins)]})
    return run


def _migrate(capacity, epoch):
    def run(key, pdf):
        lengths = [int(x) for x in pdf["lengths"].iloc[0]]
        pdf = pdf.sort_values("bins", kind="stable")
        seeds = [_from_genes(lengths, capacity, g) for g in pdf["genes"]]
        best = _evolve(lengths, capacity, seeds, np.random.default_rng([int(key[0]), int(key[1]), epoch]))
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "lengths": [np.array(lengths, np.int32)],
                             "genes": [best.genes()], "bins": [len(best.bins)]})
    return run


def _place(round_no):
    def run(key, pieces, best):
        pieces = _ordered(pieces)
        genes = np.asarray(best.sort_values(["bins", "island"], kind="stable")["genes"].iloc[0])
        pieces["sequence_id"] = (np.int64(round_no) << 56) + (np.int64(key[0]) << 24) + genes
        pieces["offset"] = pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"]
        pieces["filled"] = pieces.groupby("sequence_id")["length"].transform("sum")
        return pieces
    return run


_STATE = "shard long, island int, lengths array<int>, genes array<int>, bins int"


def _pack_shards(spark, pieces, shards, capacity, round_no, schema):
    """Pack each shard by itself; returns the pieces with sequence_id, offset and how full their sequence is."""
    salt = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(round_no))
    dealt = written(spark, pieces.withColumn("shard", F.pmod(salt, F.lit(shards))), "packing-shards")
    each = dealt.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "length")
    state = each.groupBy("shard", "island").applyInPandas(_settle(capacity), _STATE)
    for epoch in range(2, EPOCHS + 1):
        state = written(spark, state, "packing-islands")
        guests = state.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        state = state.unionByName(guests).groupBy("shard", "island").applyInPandas(_migrate(capacity, epoch), _STATE)
    best = state.select("shard", "island", "genes", "bins")
    # ids travel as text: pandas would make floats of long ids beside a null
    placed = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(
        _place(round_no), schema.replace("doc_id long", "doc_id string") + ", shard long, sequence_id long, offset long, filled long")
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    A null or empty text is the one token ``END``. Repeated rows are packed each. An empty table gives no row.
    Columns other than doc_id and text are ignored.
    """
    schema = PIECE + (", ids array<int>" if keep_ids else "")
    pieces = written(spark, token_pieces(docs, path, capacity, keep_ids), "packing-pieces")
    names = pieces.columns
    done = pieces.where(F.col("length") == capacity).withColumn(
        "sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    rest, round_no, before, fewest = pieces.where(F.col("length") < capacity), 0, None, None
    while True:
        n = rest.count()
        if not n:
            return done
        shards = -(-n // SHARD_PIECES)
        packed = written(spark, _pack_shards(spark, rest, shards, capacity, round_no, schema), "packing-round")
        if before is not None and packed.where("offset = 0").count() >= fewest:
            return done.unionByName(before)  # packing them again saved no sequence
        if shards == 1:
            return done.unionByName(packed.select(*names, "sequence_id", "offset"))
        tight = F.col("filled") >= LOOSE * capacity
        done = done.unionByName(packed.where(tight).select(*names, "sequence_id", "offset"))
        loose = packed.where(~tight)
        before, fewest = loose.select(*names, "sequence_id", "offset"), loose.where("offset = 0").count()
        rest, round_no = loose.select(*names), round_no + 1


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens of the public word-level BPE."""
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
