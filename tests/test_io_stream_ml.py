"""Sources/sinks, rule files, streaming equivalence and ML properties."""

import json
import os

from pyspark.sql import functions as F

from sheaf.ml import classify, iforest
from sheaf.ml import features as fx
from sheaf.operators import clean, rules
from sheaf.session import scratch_path
from sheaf.sources import io
from sheaf.sources.fixture import ledger, ledger_dirty
from sheaf.sources.rules import load_rules, read_rules_df
from sheaf.streaming import stream


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_load_rules_order_and_bad_file(tmp_path):
    r = load_rules()
    assert [x.severity for x in r] == sorted([x.severity for x in r], key=["critical", "warning", "info"].index)
    assert r[0].rule_name == "cash_violation_40a3" and len(r) == 7
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert load_rules(str(bad)) == [] and load_rules(str(tmp_path / "missing.json")) == []


def test_rules_dataframe_reader(spark):
    names = [r["rule_name"] for r in read_rules_df(spark).collect()]
    assert names == [r.rule_name for r in load_rules()]


def test_custom_rule_predicate(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps([{"rule_name": "big_upi", "condition": "amount > 1000 AND payment_mode = 'UPI'",
                              "severity": "info", "section": "x", "message": "m"}]))
    from tests.helpers import ledger as mk, row
    df = mk(spark, [row(amount="5000.00", mode="UPI"), row(amount="5000.00", mode="Cash")])
    assert rules.rule_hits(df, load_rules(str(p))).count() == 1


def test_csv_round_trip_and_clean_name_filter(spark, sf_small):
    led = ledger(spark, sf_small)
    path = scratch_path(spark, "t_csv")
    io.write_by_company(led, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("Company_ID=")) == sorted(
        f"Company_ID={r[0]}" for r in led.select("Company_ID").distinct().collect())
    io.write_clean_ledger(led.limit(5), os.path.join(path, "Company_ID=COMP_001", "x_clean"), fmt="csv")
    back = io.read_ledgers(spark, path)
    assert back.count() == led.count()  # the *clean* file is left out
    assert _rows(back.select(*led.columns)) == _rows(led)


def test_read_upload_csv_missing_columns(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("Date,Amount,Category\n2023-04-05,100.5,Expense\nnot-a-date,x,Income\n")
    df = io.read_upload_csv(spark, str(p))
    r = df.orderBy(F.col("Date").asc_nulls_last()).collect()
    assert str(r[0]["Date"]) == "2023-04-05" and float(r[0]["Amount"]) == 100.5
    assert r[1]["Date"] is None and r[1]["Amount"] is None


def test_stream_clean_equals_batch(spark, sf_small):
    src = scratch_path(spark, "t_stream_src")
    io.write_by_company(ledger_dirty(spark, sf_small), src)
    out, ck = scratch_path(spark, "t_stream_out"), scratch_path(spark, "t_stream_ck")
    stream.stream_clean_ledger(spark, src, out, ck)
    got = spark.read.parquet(out).drop("batch_id")
    exp = clean.clean_ledger(io.read_ledgers(spark, src))
    assert _rows(got.select(*exp.columns)) == _rows(exp)


def test_stream_rule_hits_equal_batch(spark, sf_small):
    led = ledger(spark, sf_small)
    src = scratch_path(spark, "t_rules_src")
    led.repartition(3).write.parquet(src)
    out, ck = scratch_path(spark, "t_rules_out"), scratch_path(spark, "t_rules_ck")
    stream.stream_rule_hits(spark, src, out, ck, max_files_per_trigger=1)
    assert _rows(spark.read.parquet(out)) == _rows(rules.rule_hits(spark.read.parquet(src)))


def test_description_terms_match_python_ngrams(spark):
    df = spark.createDataFrame([("Raw Material - a Big, big!! order 7",), (None,), ("x",)], "Description string")
    got = [r[0] for r in df.select(fx.description_terms(F.col("Description"))).collect()]
    assert got[0] == ["raw", "material", "big", "big", "order", "raw material", "material big", "big big",
                      "big order"]
    assert got[1] == ["unknown", "transaction", "unknown transaction"] and got[2] == []


def test_classifier_and_forest_properties(spark, sf_small):
    led = ledger(spark, sf_small)
    train, test = classify.split_train_test(led)
    n, nt = led.count(), test.count()
    assert 0.15 < nt / n < 0.25
    model = classify.fit(train)
    acc = classify.evaluate(model, test).filter("label = '__accuracy__'").first()["precision"]
    assert acc > 0.9
    pred = classify.predict_categories(model, led)
    low = pred.filter("Confidence_pct < 70").filter(~F.col("used_fallback")).count()
    assert low == 0
    feats = fx.transform(model.features, led)
    keys = ["Company_ID", "Date", "Description", "Amount", "Category", "Sub_Category", "Payment_Mode"]
    m = iforest.fit(feats, keys, n_trees=50)
    scored = iforest.with_decision(iforest.score(m, feats, keys))
    rate = scored.filter("Is_Anomaly_Predicted").count() / n
    assert 0.03 < rate < 0.07


def test_save_load_model_and_metrics(spark, sf_small, tmp_path):
    led = ledger(spark, sf_small)
    train, test = classify.split_train_test(led)
    model = classify.fit(train)
    path = str(tmp_path / "model")
    classify.save_category_model(model, path)
    back = classify.load_category_model(path)
    a = _rows(classify.predict_categories(model, test).select("Predicted_Category", "Confidence_pct"))
    b = _rows(classify.predict_categories(back, test).select("Predicted_Category", "Confidence_pct"))
    assert a == b
    assert classify.load_category_model(str(tmp_path / "nothing")) is None
    out = str(tmp_path / "metrics")
    io.write_metrics(classify.metrics_table(classify.evaluate(model, test)), out)
    lines = [json.loads(x) for f in os.listdir(out) if f.endswith(".json") for x in open(os.path.join(out, f))]
    assert {x["label"] for x in lines} >= {"Expense", "Income", "Asset", "Liability", "__accuracy__"}


def test_forest_is_the_same_for_any_partition_count(spark, sf_small):
    import numpy as np
    led = ledger(spark, sf_small)
    feats = iforest.amount_only_features(led)
    keys = ["Company_ID", "Date", "Description", "Amount", "Category", "Sub_Category", "Payment_Mode"]
    a = iforest.fit(feats.repartition(3), keys, n_trees=20)
    b = iforest.fit(feats.repartition(7), keys, n_trees=20)
    assert np.array_equal(a.feature, b.feature) and np.allclose(a.threshold, b.threshold)
    assert np.allclose(a.leaf_path, b.leaf_path)


def test_spend_hierarchy_parents_equal_children(spark, sf_small):
    from pyspark.sql import functions as F
    from sheaf.operators import rollups
    h = rollups.spend_hierarchy(ledger(spark, sf_small))
    kids = (h.filter("level > 1").groupBy("Company_ID", "parent").agg(F.sum("amount").alias("k"))
            .withColumnRenamed("parent", "id"))
    j = h.filter("level < 3").join(kids, ["Company_ID", "id"])
    bad = j.filter(F.abs(F.col("amount") - F.col("k")) > 1e-6).count()
    assert bad == 0 and j.count() == h.filter("level < 3").count()
    leaves = h.filter("level = 3")
    assert leaves.filter("gst_ratio < 0 OR gst_ratio > 1").count() == 0
    assert abs(leaves.groupBy("Company_ID").agg(F.sum("pct").alias("p")).agg(F.max(F.abs(F.col("p") - 100)))
               .first()[0]) < 0.5
