"""What the cleaning of arriving files leaves and holds on disk: compressed files, shuffles freed, intermediates deleted."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from sheaf.operators import clean, dedupe
from sheaf.session import delete_scratch, ensure_checkpoint_dir, scratch_path, scratch_scope, shuffles_freed, written
from sheaf.sources import fixture, io
from sheaf.sources.fixture import ledger_dirty
from sheaf.streaming import stream
from tests.helpers import ledger as mk, row
from tests.test_dedupe import _shuffled, rows_of


def _folders(spark):
    return set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))


def _shuffle_bytes(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f) for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data"))


def _settles(value, wanted):
    """Shuffle files are removed in the background."""
    for _ in range(50):
        if value() == wanted:
            break
        time.sleep(0.1)
    return value()


@pytest.fixture(scope="module")
def some_repeated(spark):
    rows = [row(desc=f"payment {i} of a longer text", amount=f"{i}.50") for i in range(2_000)]
    return mk(spark, rows + rows[:100] + [row(company=None, desc=None, mode=None)] * 3)


def test_many_repeated_digests_do_not_shuffle_the_rows_that_are_alone(spark, some_repeated):
    # 101 repeated digests and a broadcast limit of 50: the bitmap decides
    got = dedupe.drop_duplicates(some_repeated, 50)
    assert rows_of(got) == rows_of(some_repeated.dropDuplicates())
    assert 3 * _shuffled(spark, got) < _shuffled(spark, some_repeated.dropDuplicates())


@pytest.mark.parametrize("most", [1_000, 50, 1])
def test_slices_hold_each_row_once(spark, some_repeated, most):
    whole = rows_of(some_repeated.dropDuplicates())
    before = _shuffle_bytes(spark)
    for rows in (10 ** 6, 60):
        assert rows_of(dedupe.drop_duplicates(some_repeated, most, "t_slices", slice_rows=rows)) == whole
    assert _settles(lambda: _shuffle_bytes(spark) <= before, True)


def test_company_folders_free_their_shuffle_and_compress(spark, sf_small):
    led, plain, small = ledger_dirty(spark, sf_small), scratch_path(spark, "t_plain"), scratch_path(spark, "t_small")
    before = _shuffle_bytes(spark)
    io.write_by_company(led, plain)
    io.write_by_company(led, small, compression="gzip")
    assert _settles(lambda: _shuffle_bytes(spark) <= before, True)
    size = lambda p: sum(os.path.getsize(f) for f in glob.glob(f"{p}/Company_ID=*/*.csv*"))
    assert 4 * size(small) < size(plain)
    assert rows_of(io._normalise(spark.read.option("header", True).csv(small)).select(*led.columns)) == rows_of(led)


def test_stream_query_leaves_its_result_alone(spark, sf_small):
    import __spark_entry__ as e
    exp = rows_of(e.queries()["clean_ledger"](spark, sf_small))
    before, split = _folders(spark), spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = e.queries()["stream_clean_ledger"](spark, sf_small)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == split
    left = {x.rsplit("-", 1)[0] for x in _folders(spark) - before}
    assert left <= {"stream_clean_out", "stream_clean_ckpt"} and rows_of(got) == exp


def test_stream_takes_batches_of_compressed_and_plain_files(spark, tmp_path):
    import gzip
    head = "Company_ID,Date,Description,Amount,Transaction_Type,Category,Sub_Category,Schedule_III_Head,GST_Percentage," \
           "GST_Amount,Payment_Mode,Vendor_Client_Name\n"
    line = "{},2023-05-10,x,{},Debit,Expense,s,h,0,0.00,UPI,V\n".format
    one = head + line("C1", "10.00") * 2 + line("C1", "") + line("C2", "-1.00")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.csv").write_text(one)
    with gzip.open(tmp_path / "a" / "b.csv.gz", "wt") as f:
        f.write(one)
    for files, batches in (("*.csv", 1), ("*.csv.gz", 1), ("*.{csv,csv.gz}", 2)):
        out, ck = scratch_path(spark, "t_out"), scratch_path(spark, "t_ck")
        before = _folders(spark)
        stream.stream_clean_ledger(spark, str(tmp_path / "a"), out, ck, max_files_per_trigger=1, files=files)
        got = spark.read.parquet(out)
        # each batch by itself: one of the two equal rows, and the missing amount filled
        assert sorted((r.batch_id, r.Company_ID, str(r.Amount)) for r in got.collect()) == [
            (b, "C1", "10.00") for b in range(batches) for _ in range(2)]
        assert {os.path.basename(x) for x in (out, ck)} == _folders(spark) - before


def test_scratch_scope_deletes_its_own_folders_and_restores_the_setting(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key, None), _folders(spark)
    kept = scratch_path(spark, "t_kept")
    spark.range(3).write.parquet(kept)
    with pytest.raises(ValueError), shuffles_freed(spark), scratch_scope(spark):
        with scratch_scope(spark):
            inner = written(spark, spark.range(5), "t_inner")
            assert inner.count() == 5 and spark.conf.get(key) == "true"
        written(spark, [spark.range(2), spark.range(2)], "t_outer")
        assert {x.rsplit("-", 1)[0] for x in _folders(spark) - before} == {"t_kept", "t_outer"}
        raise ValueError
    assert _folders(spark) - before == {os.path.basename(kept)} and spark.conf.get(key, None) == was
    delete_scratch(spark, kept)
    assert _folders(spark) == before


def test_cleaning_in_slices_equals_cleaning_at_once(spark, some_repeated, monkeypatch):
    exp = rows_of(clean.clean_ledger(some_repeated))
    monkeypatch.setattr(dedupe.drop_duplicates, "__defaults__", (50, None, 40))
    assert rows_of(clean.clean_ledger(some_repeated)) == exp


def _by_company(spark):
    rows = [row(company=c, desc=f"{c} {i}", date=f"2023-05-{1 + i % 28:02d}")
            for c, n in (("A", 30), ("B", 5), ("C", 200), ("D", 40), ("E", 1)) for i in range(n)]
    return mk(spark, rows + [row(company=None, desc="none")] * 2)


def test_companies_are_written_in_slices_of_whole_companies(spark, tmp_path):
    df = _by_company(spark)
    runs = io._company_slices(df, 50)
    assert [round(share * 278) for _, share in runs] == [37, 200, 41]  # null, A and B; C alone; D and E
    assert [df.filter(some).count() for some, _ in runs] == [37, 200, 41]
    assert io._company_slices(df.limit(0), 50) == [] and len(io._company_slices(df, 10 ** 6)) == 1
    path = str(tmp_path / "all")
    io.write_by_company(df.withColumn("Description", F.lit("old")), path, partitions=4)
    back = lambda: rows_of(io._normalise(spark.read.option("header", True).csv(path)).select(*df.columns))
    io.write_by_company(df, path, partitions=4, compression="gzip", slice_rows=50)
    assert back() == rows_of(df)  # nothing old is left, no slice replaced another
    again = df.filter("Company_ID IN ('B', 'D', 'E')").withColumn("Description", F.lit("new"))
    io.write_by_company(again, path, partitions=4, replace=False, slice_rows=3)
    assert back() == rows_of(df.filter("Company_ID IS NULL OR Company_ID IN ('A', 'C')").unionByName(again))


@pytest.mark.parametrize("dirty", [False, True])
def test_a_ledger_table_in_slices_has_the_rows_of_the_view(spark, sf_small, monkeypatch, dirty):
    monkeypatch.setattr(fixture, "SLICE_BYTES", 30_000)
    jobs = []
    view = fixture.ledger_view
    monkeypatch.setattr(fixture, "ledger_view", lambda *a: jobs.append(a[2:]) or view(*a))
    got = fixture.ledger_table(spark, f"{os.path.dirname(sf_small)}/./{os.path.basename(sf_small)}", dirty)
    assert [k for k, _ in jobs] == [*range(len(jobs))] and len(jobs) > 1
    monkeypatch.undo()
    whole = fixture.ledger_dirty_view(spark, sf_small) if dirty else fixture.ledger_view(spark, sf_small)
    assert rows_of(got) == rows_of(whole)
