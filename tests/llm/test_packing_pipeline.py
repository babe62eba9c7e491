"""Packing against the plain definition of pieces, and the pipeline's stages on a table with planted cases."""

import zlib

import numpy as np
import pytest

from sheaf.llm import packing

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def check(rows, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    want = []
    for doc, text in texts:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(doc, k, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes()))
                 for k, at in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_pieces_and_sequences(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [(0, None), (1, ""), (2, "x " * 700), (None, "null id"), (3, "same"), (3, "same"), (4, "cat " * 99), (5, "cat " * 100)]
    texts += [(10 + k, " ".join(["tree"] * int(n))) for k, n in enumerate(rng.integers(1, 150, 400))]
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, length int")
    monkeypatch.setattr(packing, "SHARD_PIECES", 120)  # several shards and rounds
    rows = packing.pack(spark, df, PATH, capacity=100, keep_ids=True).collect()
    used, bound = check(rows, texts, 100)
    assert used <= bound * 1.03 + 1
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(spark, df.limit(0), PATH).count() == 0


def test_large_ids_beside_a_null_id(spark):
    texts = [(None, "one"), (2 ** 60 + 1, "two"), (-2 ** 62 - 1, "three"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check(packing.pack(spark, df, PATH, capacity=8).collect(), texts, 8)


def test_loose_sequences_are_packed_again_until_nothing_is_saved(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [(k, " ".join(["tree"] * int(n))) for k, n in enumerate(rng.integers(20, 60, 600))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(packing, "SHARD_PIECES", 12)  # 50 shards: many rounds
    monkeypatch.setattr(packing, "GENERATIONS", 2)
    rounds, real = [], packing._pack_shards
    monkeypatch.setattr(packing, "_pack_shards", lambda *a: rounds.append(a[2]) or real(*a))
    used, bound = check(packing.pack(spark, df, PATH, capacity=100).collect(), texts, 100)
    assert len(rounds) > 4 and used <= bound * 1.06
    # pieces that never share a sequence: nothing is saved, so the second round is the last
    rounds.clear()
    texts = [(k, " ".join(["tree"] * 60)) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert check(packing.pack(spark, df, PATH, capacity=100).collect(), texts, 100)[0] == 60 and len(rounds) == 2


def test_children_keep_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = sorted(rng.integers(1, 99, 200).tolist(), reverse=True)
    a = packing._Packing(lengths, 100, []).best_fit(range(200))
    b = packing._Packing(lengths, 100, []).best_fit(rng.permutation(200).tolist())
    for _ in range(20):
        c = a.child(b, rng)
        assert sorted(i for k in c.bins for i in k) == list(range(200))
        assert all(sum(lengths[i] for i in k) == f <= 100 for k, f in zip(c.bins, c.fill))


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(60)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    texts = [r.text for r in docs.orderBy("doc_id").limit(3).collect()]
    extra = [(1001, texts[0] + " tail", "en", "s", None), (1002, "12 34", "en", "s", 5), (1003, None, "en", "s", None),
             (1004, "words before " + item.text + " words behind", "en", "s", 1),
             (1005, "the of and is in that password=abcdefgh1234 the of and was", "en", "s", 3), (None, "the of and is not lost", "en", "s", 2)]
    from pyspark.sql import functions as F
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("__base", F.lit("clash")).withColumn(
        "found", F.lit(1))
    folder = str(tmp_path)
    table.write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == table.columns and [f.dataType for f in out.schema] == [f.dataType for f in table.schema]
        out.write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
        kept[name] = {r[0] for r in now.select("doc_id").collect()}
    assert not kept["language_id"] & {1002, 1003} and {1001, 1004, 1005, None} <= kept["language_id"]
    assert 1001 not in kept["near_dedup"] and None in kept["near_dedup"]
    assert 1004 not in kept["decontaminate"] and 1005 in kept["decontaminate"]
    assert kept["redact_secrets"] == kept["decontaminate"] == kept["pack_sequences"]
    red = spark.read.parquet(f"{folder}/stage3").where("doc_id = 1005").first()
    assert "abcdefgh1234" not in red.text and red.n_chars == len(red.text)
    assert sorted(r.length for r in now.collect()) == sorted(r.length for r in pipeline.run(spark, folder).collect())
