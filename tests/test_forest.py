"""The isolation forest's draws, its node table and its scorer; TF-IDF weights as rows."""

from math import comb

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sheaf.ml import features as fx
from sheaf.ml import iforest
from sheaf.sources.fixture import ledger


def test_binomial_draw_is_the_inverse_distribution_function():
    u = (np.arange(2_000) + 0.5) / 2_000
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.9), (300, 0.01)):
        cdf = np.cumsum([comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)])
        assert iforest.binomial_draw(np.full(2_000, n), p, u).tolist() == [int(np.searchsorted(cdf, x - 1e-12)) for x in u]
    for n, p in ((10_000, 0.02), (2_000_000_000, 3e-5)):  # beyond a mean of 50: the normal law
        k = iforest.binomial_draw(np.full(2_000, n), p, u)
        assert abs(k.mean() - n * p) < 0.01 * n * p and abs(k.std() / (n * p * (1 - p)) ** 0.5 - 1) < 0.02
        assert (np.diff(k) >= 0).all()
    assert iforest.binomial_draw(np.array([3, 9]), 1.0, np.array([0.1, 0.9])).tolist() == [3, 9]
    assert iforest.binomial_draw(np.array([3, 9]), 0.0, np.array([0.1, 0.9])).tolist() == [0, 0]


def test_a_row_repeated_two_billion_times(spark):
    rows = spark.range(4_000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("v"), F.lit(100_000).alias("n"))
    rows = rows.unionByName(spark.createDataFrame([(-1, 500.0, 2_000_000_000)], "k long, v double, n long"))
    feats = VectorAssembler(inputCols=["v"], outputCol="features").transform(rows)
    pool = iforest.draw_pool(feats, ["k"], 3 * 20 * 64 / 2.4e9, 42, weight_col="n")
    assert abs(pool.count() - 3 * 20 * 64) < 5 * (3 * 20 * 64) ** 0.5
    m = iforest.fit(feats, ["k"], n_trees=20, psi=64, weight_col="n")
    s = {r.k: r.score_samples for r in iforest.score(m, feats.where("k in (-1, 5)"), ["k"]).collect()}
    assert s[-1] > s[5]  # what almost every row looks like is the normal case
    # a row's share of the pool follows its weight
    feats = VectorAssembler(inputCols=["v"], outputCol="features").transform(
        spark.range(2_000).select(F.col("id").alias("k"), F.lit(1.0).alias("v"), F.when(F.col("id") < 1_000, 30).otherwise(10).alias("n")))
    heavy, light = (iforest.draw_pool(feats, ["k"], 0.1, 7, weight_col="n").join(feats.select("k", F.xxhash64(
        F.lit(1), "k", F.col("k").isNull()).alias("_d1")), "_d1").groupBy((F.col("k") < 1_000).alias("heavy")).count()
        .orderBy(F.desc("heavy")).toPandas()["count"])
    assert abs(heavy - 3_000) < 250 and abs(light - 1_000) < 150


def test_forest_saved_and_loaded_scores_the_same(spark, sf_small, tmp_path):
    keys = ["Company_ID", "Date", "Description", "Amount", "Category"]
    feats = iforest.amount_only_features(ledger(spark, sf_small)).select(*keys, "features")
    m = iforest.fit(feats, keys, n_trees=10)
    m.offset = -0.61
    assert iforest.load_forest(spark, str(tmp_path / "none")) is None
    for _ in range(2):  # written over an older one, too
        iforest.save_forest(spark, m, str(tmp_path / "forest"))
    back = iforest.load_forest(spark, str(tmp_path / "forest"))
    assert (back.psi, back.offset) == (m.psi, m.offset)
    a, b = (sorted(tuple(r) for r in iforest.score(x, feats, ["Amount"]).collect()) for x in (m, back))
    assert a == b


def test_sparse_and_dense_vectors_score_alike(spark):
    x = np.random.default_rng(1).normal(size=(300, 6)).round(3)
    x[:, 2:5] = 0
    dense = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["k", "features"])
    mixed = spark.createDataFrame([(i, Vectors.dense(v) if i % 3 else Vectors.sparse(6, [0, 1, 5], v[[0, 1, 5]]))
                                   for i, v in enumerate(x)], ["k", "features"])
    m = iforest.fit(dense, ["k"], n_trees=10, psi=64)
    a, b = (sorted(tuple(r) for r in iforest.score(m, d, ["k"]).collect()) for d in (dense, mixed))
    assert a == b and len({s for _, s in a}) > 50
    one = iforest.fit(dense.limit(1), ["k"], n_trees=3)  # no split at all
    assert iforest.score(one, dense, ["k"]).select("score_samples").distinct().count() == 1


def test_term_weights_without_terms(spark):
    df = spark.createDataFrame([(1, "a b c", None), (2, "solo words", 1)], "k long, Description string, tfidf int")
    assert fx.tfidf_weights(df, ["k"]).collect() == []  # no term in two documents
    df = spark.createDataFrame([(1, "rent paid"), (2, "rent paid twice"), (3, "?"), (4, None)], "k long, Description string")
    got = {(r.k, r.term): r.weight for r in fx.tfidf_weights(df, ["k"]).collect()}
    assert set(got) == {(k, w) for k in (1, 2) for w in ("rent", "paid", "rent paid")}
    assert got[(1, "rent")] == pytest.approx(3 ** -0.5)


def test_payment_modes_are_numbered_over_many_ranges(spark, monkeypatch):
    names = [f"mode {k:04d}" for k in range(2_000)]
    df = spark.createDataFrame([(n,) for n in reversed(names)] + [(None,)] + [("hot",)] * 3_000, "Payment_Mode string").repartition(5)
    got = {r.payment_mode: r.mode_index for r in fx.payment_mode_index(df).collect()}
    assert got == {n: i for i, n in enumerate(sorted([*names, "hot", "Bank Transfer"]))}
    assert fx.payment_mode_index(df.limit(0)).collect() == []
    monkeypatch.setattr(fx, "MAX_MODES", 10)
    with pytest.raises(ValueError, match="Payment_Mode"):
        fx.fit_feature_spec(df.selectExpr("Payment_Mode", "'x y' AS Description", "1 AS Amount"))
