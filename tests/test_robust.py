"""Ledgers that used to stop a query: zero totals, empty tables, negative amounts, bad rules, missing columns, odd dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheaf.functions.scalars import parse_date
from sheaf.ml import classify, iforest
from sheaf.ml import features as fx
from sheaf.operators import anomaly, clean, insights, quality, quantiles, rollups, rules
from sheaf.session import ensure_checkpoint_dir
from sheaf.sources import io
from sheaf.sources.rules import Rule
from tests.helpers import ledger, row


def test_a_company_with_total_zero_keeps_the_others(spark):
    df = ledger(spark, [row(company="A", amount="0.00"), row(company="B", amount="5.00")])
    got = {r.Company_ID: r.share_pct for r in rollups.category_totals(df).collect()}
    assert got == {"A": None, "B": 100.0}


def test_null_profile_on_an_empty_ledger_and_null_companies(spark):
    assert all(r.completeness_pct == 100.0 for r in quality.null_profile(ledger(spark, []), by=[]).collect())
    df = ledger(spark, [row(company=None), row(company="A")])
    got = {(r.Company_ID, r.column_name): r.null_count for r in quality.null_profile(df).collect()}
    assert got[None, "Company_ID"] == 1 and got["A", "Company_ID"] == 0


def test_negative_and_null_amounts_have_features(spark, sf_small):
    from sheaf.sources.fixture import ledger as fixture
    from sheaf.sources.fixture import ledger_dirty
    pipe = fx.feature_pipeline(fx.fit_feature_spec(fixture(spark, sf_small)))
    out = fx.transform(pipe, ledger_dirty(spark, sf_small))
    assert out.where("amount_scaled is null or isnan(amount_scaled)").count() == 0
    assert iforest.amount_only_features(ledger_dirty(spark, sf_small)).count() > 0


def test_inference_fills_amounts_with_the_median_and_takes_missing_columns(spark, sf_small):
    from sheaf.sources.fixture import ledger as fixture
    train = fixture(spark, sf_small).limit(600)
    model = classify.fit(train)
    raw = ledger(spark, [row(amount="10.00"), row(amount="30.00"), row(amount=None)])
    got = classify.predict_categories(model, raw)
    assert sorted(float(r.Amount) for r in got.collect()) == [10.0, 20.0, 30.0]
    bare = classify.predict_categories(model, raw.drop("Date", "Payment_Mode"))
    assert bare.where("Predicted_Category is not null").count() == 3


def test_one_bad_rule_does_not_stop_the_scan(spark):
    df = ledger(spark, [row(amount="50000.00", mode="Cash", desc="x")])
    good = Rule("good", "amount > 10000", "critical")
    bad = [Rule("unknown field", "no_such_field > 1"), Rule("not boolean", "amount + 1"), Rule("syntax", "amount >")]
    cast = Rule("cast", "CAST(description AS INT) > 3 OR amount > 1", "info")
    with pytest.warns(UserWarning):
        names = {r.rule_name for r in rules.rule_violations(df, [good, *bad, cast]).collect()}
    assert names == {"good", "cast"}
    with pytest.warns(UserWarning):
        assert {r.rule_name for r in rules.rule_hits(df, [good, *bad]).collect()} == {"good"}
        assert rules.rule_violations(df, bad).count() == rules.rule_hits(df, bad).count() == 0
    assert [r.rule_name for r, _ in rules.check_rules(df, [good, *bad])[1]] == [r.rule_name for r in bad]


@pytest.mark.parametrize("text, day", [
    ("2023-04-05", (2023, 4, 5)), ("05/04/2023", (2023, 4, 5)), ("5-4-2023", (2023, 4, 5)), ("5 Apr 2023", (2023, 4, 5)),
    ("05-Apr-2023", (2023, 4, 5)), ("April 5, 2023", (2023, 4, 5)), ("12/25/2023", (2023, 12, 25)), ("2023/04/05", (2023, 4, 5)),
    ("31/02/2023", None), ("soon", None), ("", None), (None, None)])
def test_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "d string").select(parse_date("d")).first()[0]
    assert got == (dt.date(*day) if day else None)


def test_cleaned_amounts_keep_the_schema_type(spark):
    df = ledger(spark, [row(amount="1.00"), row(amount="1.01", desc="b"), row(amount=None, desc="c")])
    out = clean.clean_ledger(df)
    assert out.schema["Amount"].dataType == df.schema["Amount"].dataType
    assert sorted(float(r.Amount) for r in out.collect()) == [1.0, 1.01, 1.01]


def test_insights_read_booked_classes(spark):
    rows = [row(amount="50000.00", mode="Cash", cat="Expense", desc=str(k)) for k in range(3)]
    df = ledger(spark, rows).withColumn("Predicted_Category", F.lit("Income"))
    codes = {r.code for r in insights.compliance_insights(df, cat_col="Predicted_Category").collect()}
    assert {"s40a3_cash_expense", "major_head"} <= codes


def test_chunks_are_cleaned_by_themselves(spark, tmp_path):
    for name, amounts in (("a", ["1.00", "1.00", None, "3.00"]), ("b", ["1.00", None, "9.00"])):
        io.write_clean_ledger(ledger(spark, [row(amount=a) for a in amounts]).coalesce(1), f"{tmp_path}/part={name}", "csv")
    got = io.read_ledger_chunks(spark, str(tmp_path))
    by = {}
    for r in got.collect():
        by.setdefault(r._chunk.split("/")[-2][-1], []).append(float(r.Amount))
    assert {k: sorted(v) for k, v in by.items()} == {"a": [1.0, 2.0, 3.0], "b": [1.0, 5.0, 9.0]}


def test_a_repeated_row_does_not_fill_the_forest_sample(spark):
    from pyspark.ml.functions import array_to_vector
    rest = spark.range(200_000).select(F.col("id").alias("k"))
    df = rest.unionByName(spark.range(200_000).select(F.lit(-1).cast("long").alias("k")))
    df = df.withColumn("features", array_to_vector(F.array((F.col("k") % 1000).cast("double"))))
    m = iforest.fit(df, ["k"], n_trees=20, psi=64)
    assert m.feature.shape[0] == 20
    s = iforest.score(m, df.where("k in (-1, 5)").distinct(), ["k"])
    assert all(-1 <= r.score_samples <= 0 for r in s.collect())


def test_full_confusion_matrix(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 0), (3, 1)], "label int, prediction int")
    got = {(r.label, r.prediction): r["count"] for r in classify.full_matrix(pairs).collect()}
    assert len(got) == 16 and got[0, 0] == 2 and got[3, 1] == 1 and sum(got.values()) == 3


def test_missing_models_and_damaged_models_differ(spark, tmp_path):
    assert io.load_model(f"{tmp_path}/none") is None
    (tmp_path / "bad" / "metadata").mkdir(parents=True)
    with pytest.raises(Exception):
        io.load_model(f"{tmp_path}/bad")


def test_no_local_folder_on_a_cluster():
    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_thresholds_do_not_shuffle_rows_on_the_company(spark, sf_small):
    from sheaf.sources.fixture import ledger as fixture
    out = anomaly.iqr_outliers(fixture(spark, sf_small))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(Company_ID" not in plan


def test_quantiles_have_one_exact_way():
    assert not hasattr(quantiles, "MAP_MAX_ROWS") and not hasattr(quantiles, "choose_method")
