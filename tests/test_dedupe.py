"""Duplicates by digest: equal to Spark's own full-row comparison, with a fraction of the shuffle."""

import pytest
from pyspark.sql import functions as F

from sheaf.operators import dedupe
from sheaf.sources.fixture import ledger, ledger_dirty


def rows_of(df):
    return sorted(str(tuple(r)).replace("-0.0", "0.0") for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [("A", None, "x", 0.0), ("A", "x", None, 0.0), ("A", None, "x", -0.0), ("A", None, "x", 0.0), ("B", "b", "b", float("nan")),
            ("B", "b", "b", float("nan")), (None, None, None, None), (None, None, None, None), ("C", "c", "c", 1.0)]
    rows += [("hot", "same", "row", 2.0)] * 500
    return spark.createDataFrame(rows, "Company_ID string, `a b` string, c string, Amount double")


@pytest.mark.parametrize("most", [10 ** 6, 1, 0])
def test_equal_to_full_row_comparison(odd, most):
    assert rows_of(dedupe.drop_duplicates(odd, most)) == rows_of(odd.dropDuplicates())
    got = {r.Company_ID: r.duplicates for r in dedupe.duplicate_counts(odd, broadcast_rows=most).collect()}
    assert got == {"A": 2, "B": 1, "C": 0, "hot": 499}
    assert dedupe.duplicate_counts(odd, [], most).first().duplicates == 503


def test_empty_and_unique_tables(odd):
    assert rows_of(dedupe.drop_duplicates(odd.limit(0))) == []
    assert dedupe.duplicate_counts(odd.limit(0)).collect() == []
    assert dedupe.duplicate_counts(odd.limit(0), []).first().duplicates is None
    one = odd.filter("Company_ID = 'C'")
    assert rows_of(dedupe.drop_duplicates(one)) == rows_of(one)
    assert dedupe.duplicate_counts(one).first().duplicates == 0


def test_different_rows_with_one_digest_stay(odd, monkeypatch):
    same = [F.lit(1).cast("long").alias(dedupe._H1), F.lit(2).cast("long").alias(dedupe._H2)]
    monkeypatch.setattr(dedupe, "row_digest", lambda df: same)
    assert rows_of(dedupe.drop_duplicates(odd)) == rows_of(odd.dropDuplicates())
    assert dedupe.duplicate_counts(odd, []).first().duplicates == 503


def _shuffled(spark, df):
    """Bytes written to shuffles by running ``df``, from the metrics of the plan that ran."""
    seen, total = set(), 0
    df.write.format("noop").mode("overwrite").save()
    todo = [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName() == "Exchange" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("dataSize").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_table_with_few_duplicates_shuffles_less_than_a_third(spark, sf_small):
    df = ledger_dirty(spark, sf_small)
    whole = _shuffled(spark, df.dropDuplicates())
    digests = _shuffled(spark, df.select(*dedupe.row_digest(df)).groupBy(dedupe._H1, dedupe._H2).count())
    rows = _shuffled(spark, dedupe.drop_duplicates(df))
    assert rows_of(dedupe.drop_duplicates(df)) == rows_of(df.dropDuplicates())
    assert 3 * (digests + rows) < whole


def test_rows_without_duplicates_are_not_shuffled(spark, sf_small):
    df = ledger(spark, sf_small).select("Company_ID", "Date", "Description").dropDuplicates()
    assert "Exchange" not in dedupe.drop_duplicates(spark.createDataFrame(df.toPandas(), df.schema))._jdf.queryExecution().toString()
