"""Queries that put the readers, writers, the rule language and the split on values SQL can recompute, with that SQL.

Every one starts from the ledger of the given tables; its constants are written out in the SQL, not imported.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import classify
from ..operators import clean, rules
from ..schema import LEDGER_COLUMNS
from ..session import scratch_path
from ..sources import io, lines
from ..sources.fixture import ledger, ledger_dirty
from ..sources.rules import Rule
from .catalog import present
from .fixture_sql import with_ledger

CHUNK = 500
_COMPANY = r"Company_ID=([^/]+)/"


def _by_company(df: DataFrame, order: list[str]) -> DataFrame:
    """Each company in one file, in a given order (a fixture: it fixes what a line's number is)."""
    return df.repartition("Company_ID").sortWithinPartitions("Company_ID", *order)


def ledger_chunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as one CSV a company, numbered and read in chunks of 500 rows of a file."""
    path = scratch_path(spark, "chunk_csv")
    order = [c for c in LEDGER_COLUMNS if c != "Company_ID"]
    _by_company(ledger(spark, sf_dir), order).write.partitionBy("Company_ID").option("header", True).csv(path)
    df = io.numbered_ledgers(spark, path)
    return present(df.groupBy("Company_ID", F.floor((F.col("_row") - 1) / CHUNK).cast("long").alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("_row").alias("first_row"), F.max("_row").alias("last_row"),
        F.sum("Amount").alias("total"), F.min("Date").alias("first_date")))


def _upload(spark: SparkSession, sf_dir: str):
    """Upload files of four columns, one a company in text order; some lines damaged by a rule on the amount."""
    k = (F.col("Amount") * 100).cast("bigint") % 97
    date, amount = F.coalesce(F.col("Date").cast("string"), F.lit("")), F.col("Amount").cast("string")
    text = F.concat(F.lit('"'), F.coalesce("Description", F.lit("")), F.lit('"'))
    cat = F.coalesce("Category", F.lit(""))
    line = (F.when(k == 1, F.concat_ws(",", date, text, amount, cat, F.lit("extra")))
            .when(k == 2, F.concat_ws(",", date, text))
            .when(k == 3, F.concat_ws(",", date, text, F.lit("12x"), cat))
            .when(k == 4, F.concat(date, F.lit(',"'), F.coalesce("Description", F.lit("")), F.lit(","), amount, F.lit(","), cat))
            .otherwise(F.concat_ws(",", date, text, amount, cat)))
    rows = ledger(spark, sf_dir).select("Company_ID", F.lit(1).alias("part"), line.alias("value"))
    head = rows.select("Company_ID").distinct().select("Company_ID", F.lit(0).alias("part"),
                                                       F.lit("Date,Description,Amount,Category").alias("value"))
    path = scratch_path(spark, "upload_csv")
    files = _by_company(rows.unionByName(head), ["part", "value"]).drop("part")
    files.write.partitionBy("Company_ID").text(path)
    return lines.read_upload(spark, path, "*.txt")


def upload_rejects(spark, sf_dir):
    rejects = _upload(spark, sf_dir)[1]
    return rejects.select(F.regexp_extract("file", _COMPANY, 1).alias("Company_ID"), "line", "text", "reason")


def upload_rows(spark, sf_dir):
    good = _upload(spark, sf_dir)[0]
    return present(good.groupBy("Category").agg(F.count(F.lit(1)).alias("rows"), F.sum("Amount").alias("total"),
                                                F.min("Date").alias("first_date"), F.countDistinct("Description").alias("texts")))


#: Conditions inside and outside the predicate language, with the SQL of those inside.
GIVEN_RULES = [("large", "amount > 500000", "Amount > 500000"), ("random", "rand() > 2 or amount > 5", None),
               ("reflected", "reflect('java.lang.Math', 'abs', 1) > 0", None), ("sub-query", "exists(select 1)", None),
               ("cash", "payment_mode in ('Cash', 'UPI') and amount >= 10000.50", "Payment_Mode IN ('Cash', 'UPI') AND Amount >= 10000.50"),
               ("aggregate", "sum(amount) > 1", None), ("window", "row_number() over (order by amount) > 1", None),
               ("text", "lower(description) like '%rent%' and not category <=> 'Income'",
                "lower(Description) LIKE '%rent%' AND Category IS DISTINCT FROM 'Income'"),
               ("user", "current_user() = 'x'", None), ("number", "amount + 1", None), ("unknown", "no_such > 1", None),
               ("choice", "case when category = 'Asset' then amount between 1 and 100000 else amount % 1000 = 0 end",
                "CASE WHEN Category = 'Asset' THEN Amount BETWEEN 1 AND 100000 ELSE Amount % 1000 = 0 END"),
               ("outside", "java_method('java.util.UUID', 'randomUUID') != ''", None)]


def rule_check_of_given(spark, sf_dir):
    """Each stated rule: whether the language takes it, and its hits in the ledger; the refused ones stop nothing."""
    led, given = ledger(spark, sf_dir), [Rule(n, c) for n, c, _ in GIVEN_RULES]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        good, _ = rules.check_rules(led, given)
        hits = rules.rule_violations(led, given, by=[])
    known = spark.createDataFrame([(r.rule_name, r in good) for r in given], "rule_name string, accepted boolean")
    return known.join(hits.select("rule_name", "count"), "rule_name", "left").select(
        "rule_name", "accepted", F.coalesce("count", F.lit(0)).alias("hits"))


SPLIT_KEYS = ["Company_ID", "Date", "Description", "Amount", "Category", "Sub_Category", "Payment_Mode"]


def split_counts(spark, sf_dir):
    train, test = classify.split_train_test(ledger_dirty(spark, sf_dir).select(*SPLIT_KEYS))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return present(both.groupBy("Category", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("Amount").alias("total")))


def company_files(spark, sf_dir):
    """The ledger by company, then two companies written again with other amounts: the manifest, by company."""
    path, led = scratch_path(spark, "company_csv"), ledger(spark, sf_dir)
    io.write_by_company(led, path, rows_per_file=1_000)
    some = led.filter(F.col("Company_ID").isin("COMP_003", "COMP_007"))
    io.write_by_company(some.withColumn("Amount", (F.col("Amount") * 2).cast("decimal(18,2)")), path, replace=False)
    files = io.company_files(spark, path)
    return present(files.groupBy("Company_ID").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")))


def write_clean_ledger(spark, sf_dir):
    """The cleaned dirty ledger, written as CSV and read back."""
    path = scratch_path(spark, "cleaned_csv")
    io.write_clean_ledger(clean.clean_ledger(ledger_dirty(spark, sf_dir)), path, fmt="csv")
    return present(io.read_ledgers(spark, path, exclude=""))


def write_metrics(spark, sf_dir):
    """The evaluation of stated predictions, written as JSON and read back."""
    from .checked import evaluation_of_given
    path = scratch_path(spark, "metrics")
    io.write_metrics(classify.metrics_table(evaluation_of_given(spark, sf_dir)), path)
    return spark.read.schema("label string, precision double, recall double, f1 double, support long").json(path)


def queries() -> dict:
    return {f.__name__: f for f in (ledger_chunk_numbers, upload_rejects, upload_rows, rule_check_of_given, split_counts,
                                    company_files, write_clean_ledger, write_metrics)}


_UPLOAD = """k AS (SELECT *, CAST(Amount * 100 AS BIGINT) % 97 AS k, COALESCE(CAST(Date AS VARCHAR), '') AS d,
  COALESCE(Description, '') AS t, CAST(Amount AS VARCHAR) AS a, COALESCE(Category, '') AS c FROM ledger),
u AS (SELECT Company_ID, Date, Description, Amount, Category, k, CASE k
        WHEN 1 THEN d || ',"' || t || '",' || a || ',' || c || ',extra' WHEN 2 THEN d || ',"' || t || '"'
        WHEN 3 THEN d || ',"' || t || '",12x,' || c WHEN 4 THEN d || ',"' || t || ',' || a || ',' || c
        ELSE d || ',"' || t || '",' || a || ',' || c END AS text FROM k)"""


def oracle_sql(others: dict[str, str]) -> dict[str, str]:
    """SQL of these queries; a round trip must return what the written query (in ``others``) does."""
    order = ", ".join(f"{c} NULLS FIRST" for c in LEDGER_COLUMNS if c != "Company_ID")
    key = " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '~')" for c in SPLIT_KEYS)
    ties = ", ".join(f"{c} NULLS FIRST" for c in SPLIT_KEYS)
    checks = " UNION ALL ".join(
        f"SELECT '{n}' AS rule_name, TRUE AS accepted, (SELECT COUNT(*) FROM ledger WHERE {s}) AS hits" if s else
        f"SELECT '{n}' AS rule_name, FALSE AS accepted, CAST(0 AS BIGINT) AS hits" for n, _, s in GIVEN_RULES)
    q = {}
    q["ledger_chunk_numbers"] = with_ledger(f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Company_ID ORDER BY {order}) AS n FROM ledger)
SELECT Company_ID, (n - 1) // 500 AS chunk, COUNT(*) AS rows, MIN(n) AS first_row, MAX(n) AS last_row,
       CAST(SUM(Amount) AS DOUBLE) AS total, strftime(MIN(Date), '%Y-%m-%d') AS first_date FROM r GROUP BY ALL""")
    q["upload_rejects"] = with_ledger(f"""
WITH {_UPLOAD},
n AS (SELECT *, 1 + ROW_NUMBER() OVER (PARTITION BY Company_ID ORDER BY text) AS line FROM u)
SELECT Company_ID, line, text, CASE k WHEN 1 THEN 'extra fields' WHEN 2 THEN 'missing fields' WHEN 3 THEN 'bad number in Amount'
       ELSE 'open quote' END AS reason FROM n WHERE k BETWEEN 1 AND 4""")
    q["upload_rows"] = with_ledger(f"""
WITH {_UPLOAD}
SELECT Category, COUNT(*) AS rows, CAST(SUM(Amount) AS DOUBLE) AS total, strftime(MIN(Date), '%Y-%m-%d') AS first_date,
       COUNT(DISTINCT Description) AS texts FROM u WHERE k NOT BETWEEN 1 AND 4 GROUP BY Category""")
    q["rule_check_of_given"] = with_ledger(checks)
    q["split_counts"] = with_ledger(f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Category ORDER BY substr(md5({key}), 1, 15), {ties}) AS n,
                  ROUND(COUNT(*) OVER (PARTITION BY Category) * 0.2) AS want FROM ledger_dirty)
SELECT Category, CASE WHEN n <= want THEN 'test' ELSE 'train' END AS part, COUNT(*) AS rows, CAST(SUM(Amount) AS DOUBLE) AS total
FROM r GROUP BY ALL""", dirty=True)
    q["company_files"] = with_ledger("""
SELECT Company_ID, COUNT(*) AS rows, CAST(SUM(CASE WHEN Company_ID IN ('COMP_003', 'COMP_007') THEN 2 ELSE 1 END * Amount)
       AS DOUBLE) AS total FROM ledger GROUP BY Company_ID""")
    q["write_clean_ledger"] = others["clean_ledger"]
    q["write_metrics"] = others["evaluation_of_given"]
    return q
