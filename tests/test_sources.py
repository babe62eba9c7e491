"""Line numbers over many splits, uploads with damaged lines, chunks, company folders, the rule language and the split."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from sheaf.config import DEFAULT
from sheaf.ml import classify
from sheaf.operators import rules
from sheaf.sources import io, lines
from sheaf.sources.fixture import ledger
from sheaf.sources.rules import Rule, load_rules
from tests.helpers import ledger as make, row


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    texts = {f"f{k}.csv": [f"{k}:{i}" + "x" * (i * 7 % 90) if i % 11 else "" for i in range(n)]
             for k, n in enumerate((0, 1, 300, 1000))}
    for name, text in texts.items():
        (tmp_path / name).write_text("".join(t + ("\r\n" if name == "f2.csv" else "\n") for t in text))
    (tmp_path / "other.txt").write_text("not read\n")
    rows = spark.read.text(str(tmp_path / "f3.csv"))
    assert rows.rdd.getNumPartitions() > 5
    got = {(os.path.basename(r[lines.FILE]), r.line): r.value for r in lines.text_lines(spark, str(tmp_path)).collect()}
    assert got == {(name, i + 1): t for name, text in texts.items() for i, t in enumerate(text)}


def test_chunks_of_rows(spark, tmp_path, small_splits):
    rows = [row(company="A", date="2023-01-01", amount=f"{i}.00", desc=f"row {i}") for i in range(1, 701)]
    make(spark, rows).coalesce(1).write.option("header", True).csv(str(tmp_path / "a"))
    make(spark, rows[:30] + [rows[0]]).coalesce(1).write.option("header", True).csv(str(tmp_path / "b"))
    got = io.read_ledger_chunks(spark, str(tmp_path / "*"), rows=300).collect()
    chunks = collections.defaultdict(set)
    for r in got:
        folder, number = r._chunk.split("/")[-2], r._chunk.split("#")[-1]
        chunks[folder, number].add(int(r.Amount))
    assert dict(chunks) == {("a", "0"): set(range(1, 301)), ("a", "1"): set(range(301, 601)), ("a", "2"): set(range(601, 701)),
                            ("b", "0"): set(range(1, 31))}  # the repeated row of b went inside its chunk
    assert len(got) == 730
    assert {r._chunk.split("/")[-2] for r in io.read_ledger_chunks(spark, str(tmp_path / "*"), rows=None).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        io.read_ledger_chunks(spark, str(tmp_path), rows=0)


def test_upload_keeps_good_rows_and_names_the_others(spark, tmp_path):
    (tmp_path / "one.csv").write_text("﻿Date,Description,Amount,GST_Percentage,Note,Note,\n"
                                      "2023-04-05,\"rent, \"\"paid\"\"\",100.5,18,1,x,\n"
                                      "\n   \n"
                                      "not-a-date,plain, 7 ,,2,,2.5\n"
                                      "2023-04-06,short,1\n"
                                      "2023-04-06,long,1,5,1,x,3,4\n"
                                      "2023-04-06,bad,abc,5,1,x,3\n"
                                      "2023-04-06,bad too,abc,x,1,x,3\n"
                                      "2023-04-06,\"open,1,5,1,x,3\n"
                                      "2023-04-06,nan,NaN,5,1,x,3\n")
    (tmp_path / "two.csv").write_text("Amount,Category\r\n5,Income\r\n")
    (tmp_path / "only_header.csv").write_text("Amount,Category\n")
    (tmp_path / "empty.csv").write_text("")
    good, rejects = lines.read_upload(spark, str(tmp_path))
    got = {(os.path.basename(r.file), r.line): r.reason for r in rejects.collect()}
    assert got == {("one.csv", 6): "missing fields", ("one.csv", 7): "extra fields", ("one.csv", 8): "bad number in Amount",
                   ("one.csv", 9): "bad number in Amount; bad number in GST_Percentage", ("one.csv", 10): "open quote",
                   ("one.csv", 11): "bad number in Amount"}
    assert "2023-04-06,short,1" in {r.text for r in rejects.collect()}
    kinds = dict(good.dtypes)
    assert kinds["Amount"] == "decimal(18,2)" and kinds["Note"] == "bigint" and kinds["Note_2"] == "string"
    assert kinds["column_7"] == "double" and kinds["Category"] == "string"
    rows = sorted(((str(r.Date), r.Description, float(r.Amount), r.Category, r.Note, r.column_7) for r in good.collect()), key=str)
    assert rows == sorted([("2023-04-05", 'rent, "paid"', 100.5, None, 1, None), ("None", "plain", 7.0, None, 2, 2.5),
                           ("None", None, 5.0, "Income", None, None)], key=str)
    lenient = io.read_upload_csv(spark, str(tmp_path))  # the three lines with unreadable numbers stay
    assert lenient.count() == 6 and lenient.filter("Amount is null").count() == 3


def test_upload_of_nothing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("\n\n")
    good, rejects = lines.read_upload(spark, str(tmp_path))
    assert good.count() == 0 and rejects.count() == 0 and "Amount" in good.columns


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".csv")}


def test_only_the_companies_written_again_are_replaced(spark, sf_small, tmp_path):
    path, led = str(tmp_path / "by"), ledger(spark, sf_small)
    io.write_by_company(led, path, rows_per_file=100)
    before, manifest = _files(path), {r.file: r.rows for r in io.company_files(spark, path).collect()}
    assert max(manifest.values()) <= 100 and sum(manifest.values()) == led.count() and len(manifest) == len(before)
    again = led.filter("Company_ID = 'COMP_003'").limit(5)
    io.write_by_company(again, path, replace=False)
    after = _files(path)
    assert {f for f in before if "COMP_003" not in f} == {f for f in after if "COMP_003" not in f}
    assert all(after[f] == t for f, t in before.items() if "COMP_003" not in f)
    counts = {r.Company_ID: r.rows for r in io.company_files(spark, path).groupBy("Company_ID").agg(F.sum("rows").alias("rows")).collect()}
    assert counts["COMP_003"] == 5 and sum(counts.values()) == led.filter("Company_ID <> 'COMP_003'").count() + 5


REFUSED = ["rand() > 2 or amount > 5", "reflect('java.lang.Math', 'abs', 1) > 0", "exists(select 1)", "amount > (select 1)",
           "amount in (select 1)", "sum(amount) > 1", "row_number() over (order by amount) > 1", "uuid() = 'a'",
           "try_reflect('a', 'b') = 'x'", "input_file_name() = 'x'", "current_user() = 'x'", "now() > '2020-01-01'",
           "explode(array(true))", "assert_true(amount > 1) is null", "raise_error('x') is null", "java_method('a.B', 'c') = 'x'",
           "amount + 1", "no_such = 1", "amount >", "monotonically_increasing_id() > 1"]


@pytest.mark.parametrize("condition", REFUSED)
def test_conditions_outside_the_language_stop_nothing(spark, condition):
    df = make(spark, [row(amount="5.00"), row(amount="50.00")])
    rule, good = Rule("bad", condition), Rule("good", "amount > 10")
    with pytest.warns(UserWarning, match="'bad' is skipped"):
        found = rules.rule_violations(df, [rule, good], by=[]).collect()
    assert [(r.rule_name, r["count"]) for r in found] == [("good", 1)]
    with pytest.warns(UserWarning):
        assert rules.rule_hits(df, [rule, good]).count() == 1


def test_conditions_inside_the_language(spark):
    df = make(spark, [row(amount="5.00"), row(amount="50.00")])
    inside = ["amount between 1 and 9", "description like '%alary%' and upper(trim(category)) = 'EXPENSE'", "payment_mode is not null",
              "cast(sub_category as int) is null and amount % 5 = 0", "case when amount > 9 then true else false end",
              "coalesce(payment_mode, 'x') in ('Bank Transfer') or not category <=> 'Asset'", "length(concat(category, '-')) > 3",
              "round(amount / 3, 1) >= 1.7 and abs(-amount) < 1e6", "if(amount > 1, substring(description, 1, 3) = 'Sal', false)",
              "contains(description, 'ary') and startswith(description, 'S') and description rlike '^S.*'", "nullif(category, 'x') ilike 'exp%'",
              "description like 'rand() > %' or true"]
    good, bad = rules.check_rules(df, [Rule(c, c) for c in inside] + load_rules())
    assert not bad and len(good) == len(inside) + 7


def test_split_is_exact_in_every_class(spark):
    rows = [("a", i, "x") for i in range(1_000)] + [("b", i, None) for i in range(7)] + [("c", 1, "same")] * 503 + [("d", 1, "")] * 2
    rows += [(None, i, "n") for i in range(15)]
    df = spark.createDataFrame(rows, "Category string, k int, t string")
    train, test = classify.split_train_test(df)
    assert train.columns == test.columns == df.columns
    n = {r.Category: r["count"] for r in test.groupBy("Category").count().collect()}
    assert n == {"a": 200, "b": 1, "c": 101, None: 3}  # of two rows round(0.4) = 0
    key = lambda part: collections.Counter(map(tuple, part.collect()))
    assert key(train) + key(test) == collections.Counter(rows)
    assert key(classify.split_train_test(df.repartition(7))[1]) == key(test)
    from dataclasses import replace
    none, every = (classify.split_train_test(df, replace(DEFAULT, test_fraction=x))[1].count() for x in (0.0, 1.0))
    assert (none, every) == (0, len(rows))
    assert [x.count() for x in classify.split_train_test(df.limit(0))] == [0, 0]
