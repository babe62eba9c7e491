"""Work that must not grow faster than the rows: terms once a row, preview by values, one pass for the dirty ledger."""

from datetime import date, timedelta
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from sheaf.ml import classify, iforest
from sheaf.ml import features as fx
from sheaf.operators import quality
from sheaf.sources import fixture

TEXTS = [("Rent - a 12 blue ring!",), ("rent rent rent",), ("x",), ("",), (None,), ("!!",)]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_computed_once_a_row(spark):
    df = spark.createDataFrame(TEXTS, "Description string")
    both = fx.with_terms(df).select("_terms", fx.description_terms(F.col("Description")).alias("whole")).collect()
    assert [r["_terms"] for r in both] == [r["whole"] for r in both]
    docs = fx.term_document_frequency(df)
    assert _plan(docs).count("regexp_extract_all") <= 1
    assert {r["term"]: (r["tf"], r["df"]) for r in docs.collect()} == {"rent": (4, 2)}


def test_weights_are_not_computed_below_a_grouping(spark):
    df = spark.createDataFrame(TEXTS * 3, "Description string")
    rows = df.groupBy("Description").agg(F.count(F.lit(1)).alias("n"))
    w = fx.tfidf_weights(rows, ["Description", "n"], corpus=df)
    below = _plan(w).split("Aggregate", 1)[1].splitlines()[1:]  # the grouping's own line may compute them, once a group
    assert not any("regexp_extract_all" in line for line in below)
    assert {r["Description"] for r in w.collect()} == {"Rent - a 12 blue ring!", "rent rent rent", None}


def _preview_rows(spark):
    rows = [("A", date(2024, 1, 1) + timedelta(days=i // 7), f"t{i % 5}", Decimal(i)) for i in range(700)]
    rows += [("A", None, "none", Decimal(1))] * 3 + [(None, date(2024, 1, 2), "null key", Decimal(2))] * 30
    rows += [("B", None, f"b{i}", Decimal(i)) for i in range(4)] + [("C", date(2024, 1, 1), "one", None)] * 2
    return spark.createDataFrame(rows, "Company_ID string, Date date, Description string, Amount decimal(18,2)").repartition(4)


def test_preview_is_the_first_rows(spark):
    df = _preview_rows(spark)
    got = [tuple(r) for r in quality.preview(df, n=20).collect()]
    last = lambda v: (v is None, v)
    want = []
    for key in ("A", "B", "C", None):
        mine = sorted((tuple(r) for r in df.collect() if r[0] == key),
                      key=lambda r: tuple((v is None, v if v is not None else 0) for v in r[1:2]) + (last(r[2]), (r[3] is None, r[3] or 0)))
        want += [(*r, i + 1) for i, r in enumerate(mine[:20])]
    key = lambda r: (str(r[0]), r[-1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_preview_sorts_only_rows_up_to_the_cut(spark):
    df = _preview_rows(spark)
    plan = _plan(quality.preview(df, n=20))
    assert "LeftSemi" in plan  # rows beyond the n-th row's date are gone before the full-row sort
    assert quality.preview(df, by=[], n=20).count() == 20


def test_dirty_rows_take_one_pass(spark):
    amounts = [Decimal(k) / 100 for k in (5, 132, 6, 251, 252, 253, 5)] + [None]
    base = spark.createDataFrame([("A", a, "Expense") for a in amounts], "Company_ID string, Amount decimal(18,2), Category string")
    for c in ("Date", "Description", "Transaction_Type", "Sub_Category", "Schedule_III_Head", "GST_Percentage", "GST_Amount",
              "Payment_Mode", "Vendor_Client_Name"):
        base = base.withColumn(c, F.lit(None).cast("string"))
    out = fixture.dirty(base)
    assert "Union" not in _plan(out)
    assert sorted(str(r["Amount"]) for r in out.select("Amount").collect()) == sorted(
        ["0.05", "0.05", "0.05", "0.05", "1.32", "1.32", "0.06", "-2.51", "0.00", "None", "None"])


def test_ledger_tasks_grow_with_lineitem(spark, monkeypatch):
    path = "/root/testdata/sf0.001"
    small = fixture.ledger_view(spark, path)
    monkeypatch.setattr(fixture, "TASK_BYTES", 2_000)
    large = fixture.ledger_view(spark, path)
    assert "RepartitionByExpression" in _plan(large) and "RepartitionByExpression" not in _plan(small)
    assert large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty()


def test_forest_walk_equals_a_walk_by_hand(monkeypatch):
    monkeypatch.setattr(iforest, "WALK_ROWS", 3)
    nan = float("nan")
    m = iforest.IsolationForestModel(np.array([[0, -1, 1, -1, -1], [-1, -1, -1, -1, -1]]), np.array([[1.0, 0, 5.0, 0, 0], [0.0] * 5]),
                                     np.array([[1, 0, 3, 0, 0], [0] * 5]), np.array([[2, 0, 4, 0, 0], [0] * 5]),
                                     np.array([[0, 1.5, 0, 2.25, 3.5], [0.5, 0, 0, 0, 0]]), 4)
    x = np.array([[1.0, 9], [1.5, 5], [2, 5.5], [nan, nan], [0, 0]])
    assert iforest._path_lengths(m, x).tolist() == [1.0, 1.375, 2.0, 2.0, 1.0]
    assert iforest._path_lengths(m, np.zeros((0, 2))).tolist() == []
    leaves = iforest.IsolationForestModel(*[np.array([[v]]) for v in (-1, 0.0, 0, 0, 1.0)], 1)
    assert iforest._path_lengths(leaves, np.zeros((2, 0))).tolist() == [1.0, 1.0]


def _random_forest(rng, trees, features, splits):
    """Trees grown by splitting a random leaf ``splits`` times; thresholds on both sides of 0."""
    shape = (trees, 2 * splits + 1)
    feature, threshold = np.full(shape, -1), rng.normal(size=shape).round(1)
    left, right, path = np.zeros(shape, dtype=int), np.zeros(shape, dtype=int), rng.uniform(1, 9, size=shape)
    for tr in range(trees):
        for k in range(splits):
            leaf = rng.choice(np.flatnonzero(feature[tr, :2 * k + 1] < 0))
            feature[tr, leaf], left[tr, leaf], right[tr, leaf] = rng.integers(features), 2 * k + 1, 2 * k + 2
    return iforest.IsolationForestModel(feature, threshold, left, right, path, 256)


def test_forest_by_entries_equals_the_walk(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 9)).round(1) * (rng.random((700, 9)) < 0.3)
    x[3, 1], x[4, 2], x[5, 0] = np.nan, np.inf, -np.inf
    row, at = np.nonzero(x)
    for splits in (0, 1, 40, 63, 90):  # 91 leaves do not fit one word: these trees are walked
        m = _random_forest(rng, 6, 9, splits)
        for leaves in (64, 2):
            monkeypatch.setattr(iforest, "WORD_LEAVES", leaves)
            got = iforest._entry_path_lengths(m, iforest._leaf_words(m), 9, len(x), row, at, x[row, at])
            assert got.tolist() == iforest._path_lengths(m, x).tolist()
    monkeypatch.setattr(iforest, "WORD_LEAVES", 64)
    m = _random_forest(rng, 50, 500, 30)  # a split costs only the rows that it sends right: none is walked
    monkeypatch.setattr(iforest, "_walked", None)
    none = np.zeros(0, dtype=int)
    assert len(iforest._entry_path_lengths(m, iforest._leaf_words(m), 500, 4, none, none, np.zeros(0))) == 4


def test_split_reads_a_known_hash_and_ranks_once(spark):
    rows = [(c, i, f"t{i % 7}") for c in ("a", "b", None) for i in range(400)]
    df = spark.createDataFrame(rows, "Category string, k int, t string")
    plain = classify.split_train_test(df)
    known = classify.split_train_test(df.withColumn("_h", classify.content_hash(df.columns)), key_cols=df.columns, hash_col="_h")
    for a, b in zip(plain, known):
        assert b.columns == df.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert "Window" not in _plan(a) and "Window" not in _plan(b)  # no use of a part ranks rows again
