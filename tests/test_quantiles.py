"""Exact quantiles must equal Spark's exact percentile (and the pandas linear rule), whatever the sketch says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators.quantiles import group_quantiles_paise
from tests.helpers import ledger, row


METHODS = ["exact", "radix"]


def _q(df, by, method="exact"):
    r = group_quantiles_paise(df, by, (0.25, 0.5, 0.75), ("a", "b", "c"), method=method)
    return sorted(tuple(x) for x in r.collect())


def _percentile(df, by):
    """Spark's own exact percentile on paise."""
    v = df.dropna(subset=by) if by else df
    arr = F.percentile((F.col("Amount") * 100).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = v.groupBy(*by).agg(F.count("Amount").alias("n"), F.count(F.lit(1)).alias("rows"), arr.alias("q"))
    return sorted(tuple(x) for x in g.select(*by, "n", "rows", *[F.col("q")[i] for i in range(3)]).collect())


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("by", [["Company_ID"], []])
def test_equals_percentile_on_fixture(spark, sf_small, by, method):
    from sheaf.sources.fixture import ledger_dirty
    df = ledger_dirty(spark, sf_small)
    assert _q(df, by, method) == _percentile(df, by)


def _amounts(spark, groups):
    """A ledger-like table (Company_ID, Amount) of paise by group."""
    rows = [(g, int(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "Company_ID string, p long")
    return df.select("Company_ID", (F.col("p").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("Amount"))


def _groups():
    rng = np.random.default_rng(5)
    hot = rng.lognormal(9, 3, 40_000)  # one group holds most rows
    return {"hot": hot, "ties": np.repeat([1, 5, 5, 9], 2_000), "two": [3, 7], "one": [4], "neg": -rng.integers(0, 99, 500),
            "far": np.concatenate([np.full(3_000, -10 ** 15), np.full(1_000, 10 ** 15)]),
            **{f"n{n}": rng.integers(0, 10 ** 6, n) for n in (19, 20, 21, 199, 200, 201, 1_999, 2_000, 2_001)}}


@pytest.mark.parametrize("by", [["Company_ID"], []])
def test_skewed_tied_and_small_groups(spark, by):
    df = _amounts(spark, _groups())
    assert _q(df, by) == _percentile(df, by) == _q(df, by, "radix")


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    from sheaf.operators import quantiles as m
    df = _amounts(spark, _groups())
    want = _percentile(df, ["Company_ID"])
    # brackets of no width, and a sketch of the least size: many ranks are outside
    monkeypatch.setattr(m, "SKETCH_K", 8)
    monkeypatch.setattr(m, "WIDTHS", ((5, 0.0), (5, 0.01), (5, 0.05), (0, 1.0)))
    assert _q(df, ["Company_ID"]) == want


def test_two_scans_of_the_rows(spark, monkeypatch):
    from sheaf.operators import quantiles as m
    df = _amounts(spark, _groups())
    scans, real = [], m.written

    def spy(spark_, frame, name):
        scans.append((name, frame._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")))
        return real(spark_, frame, name)
    monkeypatch.setattr(m, "written", spy)
    assert len(_q(df, ["Company_ID"])) == len(_groups())
    assert sum(n for _, n in scans) == 2  # the statistics with the sketch, and the counts


def test_edge_groups(spark):
    amounts = ["-5.00", "0.00", "0.01", "0.01", "1000000.00", None, "7.25"]
    rows = [row(company="A", amount=a) for a in amounts] + [row(company="B", amount="3.00")] + \
           [row(company="C", amount=None)]
    df = ledger(spark, rows)
    got = {r[0]: r for r in _q(df, ["Company_ID"])}
    vals = np.array([-500, 0, 1, 1, 100000000, 725], dtype=float)
    exp = np.percentile(vals, [25, 50, 75])
    assert got["A"][1:3] == (6, 7) and list(got["A"][3:]) == list(exp)
    assert got["B"][3:] == (300.0, 300.0, 300.0)
    assert got["C"][1] == 0 and got["C"][3] is None
    assert _q(df, ["Company_ID"], "radix") == _q(df, ["Company_ID"])
    with pytest.raises(ValueError):
        _q(df, ["Company_ID"], "map")
