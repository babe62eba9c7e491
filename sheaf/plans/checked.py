"""Queries that put each step behind the trained models, the chunked cleaner, the single-ledger mode, another class column
and the finding texts on values SQL can recompute, with that SQL. Its constants are written out, not imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LABELS
from ..functions.scalars import category_index
from ..ml import anomalies, classify, iforest
from ..operators import anomaly, insights, rollups
from ..sources import io
from ..sources.fixture import ledger, ledger_dirty
from .catalog import present
from .fixture_sql import with_ledger
from .oracle_sql import _inr_sql, insight_sql, text_sql


def given_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with a class, a predicted class and a probability that follow from the amount."""
    k = (F.col("Amount") * 100).cast("bigint")
    led = ledger(spark, sf_dir).filter(F.col("Category").isin(*LABELS)).withColumn("y", category_index("Category"))
    led = led.withColumn("p", F.when(k % 10 < 8, F.col("y")).otherwise(((F.col("y") + k) % 4).cast("int")))
    return led.withColumn("p_max", ((k * 7919) % 1000).cast("double") / 1000.0)


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = given_predictions(spark, sf_dir)
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.col("p") + 1)
    return g.select("Company_ID", "Date", "Description", "Amount", "Category", *classify.gated(label, F.col("p_max")))


def evaluation_of_given(spark, sf_dir):
    return classify.evaluate_pairs(given_predictions(spark, sf_dir).select("y", "p"), averages=True)


def confusion_of_given(spark, sf_dir):
    g = given_predictions(spark, sf_dir)
    return classify.full_matrix(g.select(F.col("y").alias("label"), F.col("p").alias("prediction")))


def fallback_of_given(spark, sf_dir):
    return classify.fallback_rate(_gated(spark, sf_dir))


def prediction_counts_of_given(spark, sf_dir):
    return classify.prediction_counts(_gated(spark, sf_dir))


def low_confidence_of_given(spark, sf_dir):
    return present(classify.low_confidence_rows(_gated(spark, sf_dir)))


def clean_ledger_chunks(spark, sf_dir):
    """The dirty ledger in chunks (by GST slab), each cleaned by itself."""
    d = ledger_dirty(spark, sf_dir).withColumn("_chunk", F.col("GST_Percentage").cast("string"))
    return present(io.clean_ledger_chunks(d).groupBy("_chunk", "Company_ID").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("Amount").alias("total"), F.min("Amount").alias("least")))


def category_totals_single(spark, sf_dir):
    return rollups.category_totals(ledger(spark, sf_dir), by=[])


def statistical_anomalies_single(spark, sf_dir):
    return anomaly.statistical_anomalies(ledger(spark, sf_dir), by=[])


def category_totals_predicted(spark, sf_dir):
    return rollups.category_totals(_gated(spark, sf_dir), cat_col="Predicted_Category")


def insight_messages(spark, sf_dir):
    found = insights.insight_messages(insights.compliance_insights(ledger(spark, sf_dir)))
    return found.select("Company_ID", "seq", "code", "level", "message")


#: A small forest stated node by node: tree, node, feature (0 amount, 1 month, 2 GST %), threshold, left, right, size, depth.
GIVEN_NODES = [(0, 0, 0, 50000.0, 1, 2, 16, 0), (0, 1, 1, 6.5, 3, 4, 11, 1), (0, 2, -1, 0.0, -1, -1, 5, 1),
               (0, 3, -1, 0.0, -1, -1, 9, 2), (0, 4, -1, 0.0, -1, -1, 2, 2),
               (1, 0, 2, 8.5, 1, 2, 16, 0), (1, 1, -1, 0.0, -1, -1, 7, 1), (1, 2, 0, 1250000.25, 3, 4, 9, 1),
               (1, 3, 0, 999.5, 5, 6, 8, 2), (1, 4, -1, 0.0, -1, -1, 1, 2), (1, 5, -1, 0.0, -1, -1, 3, 3), (1, 6, -1, 0.0, -1, -1, 5, 3),
               (2, 0, 1, 1.5, 1, 2, 16, 0), (2, 1, -1, 0.0, -1, -1, 1, 1), (2, 2, 1, 11.5, 3, 4, 15, 1),
               (2, 3, -1, 0.0, -1, -1, 14, 2), (2, 4, -1, 0.0, -1, -1, 1, 2)]
GIVEN_PSI = 16


def given_forest(spark: SparkSession) -> iforest.IsolationForestModel:
    """The forest of ``GIVEN_NODES``, through its node table."""
    rows = [(*n[:6], 0.0 if n[2] >= 0 else float(n[7] + iforest.average_path_length([n[6]])[0])) for n in GIVEN_NODES]
    return iforest.from_node_table(spark.createDataFrame(rows, iforest.TABLE_SCHEMA), GIVEN_PSI)


def forest_score_of_given(spark, sf_dir):
    """Scores of a stated forest over (amount, month, GST %) of every ledger row, after saving and loading it."""
    from pyspark.ml.feature import VectorAssembler
    from ..session import scratch_path
    path = scratch_path(spark, "given_forest")
    iforest.save_forest(spark, given_forest(spark), path)
    rows = ledger(spark, sf_dir).select("Company_ID", "Date", "GST_Percentage", F.col("Amount").cast("double").alias("Amount"),
                                        F.month("Date").cast("double").alias("m"), F.col("GST_Percentage").cast("double").alias("g"))
    feats = VectorAssembler(inputCols=["Amount", "m", "g"], outputCol="features").transform(rows)
    out = iforest.score(iforest.load_forest(spark, path), feats, ["Company_ID", "Date", "Amount", "GST_Percentage"])
    return present(out.withColumn("score_samples", F.round("score_samples", 9)))


def given_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with a flag and a score that follow from the amount."""
    k = (F.col("Amount") * 100).cast("bigint")
    return ledger(spark, sf_dir).withColumns({"Is_Anomaly_Predicted": F.when(k % 11 != 0, k % 37 == 0),
                                              "Anomaly_Score": ((k * 7919) % 1000).cast("double") / 1000.0 - 0.5})


def anomaly_summary_of_given(spark, sf_dir):
    return anomalies.anomaly_summary(given_anomalies(spark, sf_dir))


def predicted_anomaly_rows_of_given(spark, sf_dir):
    rows = anomalies.predicted_anomaly_rows(given_anomalies(spark, sf_dir))
    return present(rows.select("Company_ID", "rank", "Date", "Description", "Amount", "Anomaly_Score"))


def model_properties(spark, sf_dir):
    """What must hold of the trained models whatever their weights: one row a property."""
    from . import ml_queries as q
    pred = q._predicted(spark, sf_dir)
    p = pred.agg(F.avg((F.col("Predicted_Category") == F.col("Category")).cast("double")).alias("right"),
                 F.min("Confidence_pct").alias("lo"), F.max("Confidence_pct").alias("hi"),
                 F.count_if(F.col("Confidence_pct") < 69.95).alias("low"), F.count_if("used_fallback").alias("fell"),
                 F.count(F.lit(1)).alias("n")).first()
    s = q._scored(spark, sf_dir)
    f = s.agg(F.avg(F.col("Is_Anomaly_Predicted").cast("double")).alias("share"),
              F.min("Anomaly_Score").alias("lo"), F.max("Anomaly_Score").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    held = [("accuracy over 0.9", p["right"] > 0.9), ("confidence between 25 and 100", 25 <= p["lo"] and p["hi"] <= 100),
            ("fallback below 70 % confidence", p["low"] <= p["fell"]), ("every row predicted", p["n"] == f["n"]),
            ("forest flags between 4 and 6 %", 0.04 <= f["share"] <= 0.06), ("scores within one", f["lo"] > -1 and f["hi"] < 1)]
    return spark.createDataFrame([(a, bool(b)) for a, b in held], "property string, holds boolean")


def queries() -> dict:
    return {f.__name__: f for f in (
        evaluation_of_given, confusion_of_given, fallback_of_given, prediction_counts_of_given, low_confidence_of_given,
        clean_ledger_chunks, category_totals_single, statistical_anomalies_single, category_totals_predicted, insight_messages,
        forest_score_of_given, anomaly_summary_of_given, predicted_anomaly_rows_of_given, model_properties)}


_GIVEN = """g0 AS (SELECT *, CASE Category WHEN 'Expense' THEN 0 WHEN 'Income' THEN 1 WHEN 'Asset' THEN 2 ELSE 3 END AS y,
              CAST(Amount * 100 AS BIGINT) AS k FROM ledger WHERE Category IN ('Expense', 'Income', 'Asset', 'Liability')),
g AS (SELECT *, CASE WHEN k % 10 < 8 THEN y ELSE (y + k) % 4 END AS p,
             CAST((k * 7919) % 1000 AS DOUBLE) / 1000.0 AS p_max FROM g0)"""
_LAB = "lab AS (SELECT * FROM (VALUES (0, 'Expense'), (1, 'Income'), (2, 'Asset'), (3, 'Liability')) t(c, label))"


def _gated_sql() -> str:
    text = text_sql()["ledger_text"]
    keyword = text[text.index("CASE WHEN regexp"):text.index(" AS keyword_category")] if "CASE WHEN regexp" in text else None
    if keyword is None:
        start = text.index(" AS keyword_category")
        keyword = text[text.rindex("CASE", 0, text.index("ELSE CASE WHEN Amount > 500000")):start]
    return f"""{_GIVEN}, {_LAB},
gt AS (SELECT Company_ID, Date, Description, Amount, Category,
              CASE WHEN p_max < 0.7 THEN {keyword} ELSE lab.label END AS Predicted_Category,
              ROUND(p_max * 100, 1) AS Confidence_pct, p_max < 0.7 AS used_fallback
       FROM g JOIN lab ON lab.c = g.p)"""


def _totals(src: str, cat: str, key: str = "") -> str:
    keys = f"{key}, " if key else ""
    over = f"PARTITION BY {key}" if key else ""
    return (f"SELECT {keys}{cat} AS category, CAST(SUM(Amount) AS DOUBLE) AS amount, CAST(SUM(Amount) AS DOUBLE) / "
            f"CAST(SUM(SUM(Amount)) OVER ({over}) AS DOUBLE) * 100 AS share_pct FROM {src} WHERE {cat} IS NOT NULL"
            f"{f' AND {key} IS NOT NULL' if key else ''} GROUP BY {keys}{cat}")


def oracle_sql() -> dict[str, str]:
    gated = _gated_sql()
    one = "CAST(CAST(ROUND(value, 1) AS DECIMAL(18,1)) AS VARCHAR)"
    amount, value = _inr_sql("CAST(amount AS DECIMAL(18,2))"), _inr_sql("FLOOR(value)")
    q = {}
    q["evaluation_of_given"] = with_ledger(f"""WITH {_GIVEN}, {_LAB},
m0 AS (SELECT label, COUNT_IF(y = c AND p = c) AS tp, COUNT_IF(y = c) AS support, COUNT_IF(p = c) AS predicted
       FROM lab CROSS JOIN g GROUP BY label),
m1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM m0),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m1)
SELECT label, precision, recall, f1, support FROM m
UNION ALL SELECT '__accuracy__', SUM(tp) / SUM(support), SUM(tp) / SUM(support), SUM(tp) / SUM(support),
                 CAST(SUM(support) AS BIGINT) FROM m
UNION ALL SELECT '__macro__', AVG(precision), AVG(recall), AVG(f1), CAST(SUM(support) AS BIGINT) FROM m
UNION ALL SELECT '__weighted__', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
                 SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM m""")
    q["confusion_of_given"] = with_ledger(f"""WITH {_GIVEN}, {_LAB}
SELECT a.c AS label, b.c AS prediction, (SELECT COUNT(*) FROM g WHERE y = a.c AND p = b.c) AS count
FROM lab a CROSS JOIN lab b""")
    q["fallback_of_given"] = with_ledger(f"""WITH {gated}
SELECT Company_ID, AVG(CAST(used_fallback AS DOUBLE)) * 100 AS fallback_pct, COUNT(*) AS n FROM gt GROUP BY Company_ID""")
    q["prediction_counts_of_given"] = with_ledger(f"""WITH {gated}
SELECT Company_ID, Predicted_Category AS category, COUNT(*) AS n,
       CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER (PARTITION BY Company_ID) AS DOUBLE) * 100 AS pct
FROM gt WHERE Company_ID IS NOT NULL GROUP BY Company_ID, Predicted_Category""")
    q["low_confidence_of_given"] = with_ledger(f"""WITH {gated}
SELECT Company_ID, strftime(Date, '%Y-%m-%d') AS Date, Description, CAST(Amount AS DOUBLE) AS Amount, Category,
       Predicted_Category, Confidence_pct, used_fallback FROM gt WHERE Confidence_pct < 60.0""")
    q["category_totals_predicted"] = with_ledger(f"WITH {gated} " + _totals("gt", "Predicted_Category", "Company_ID"))
    q["category_totals_single"] = with_ledger(_totals("ledger", "Category"))
    q["clean_ledger_chunks"] = with_ledger("""
WITH dd AS (SELECT DISTINCT *, CAST(GST_Percentage AS VARCHAR) AS _chunk FROM ledger_dirty),
med AS (SELECT _chunk, Company_ID, CAST(CAST(CAST(FLOOR(quantile_cont(CAST(Amount * 100 AS DOUBLE), 0.5) + 0.5) AS BIGINT)
          AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS m FROM dd GROUP BY ALL),
f AS (SELECT dd._chunk, dd.Company_ID, COALESCE(dd.Amount, med.m) AS amt FROM dd LEFT JOIN med
      ON dd.Company_ID = med.Company_ID AND dd._chunk = med._chunk)
SELECT _chunk, Company_ID, COUNT(*) AS rows, CAST(SUM(amt) AS DOUBLE) AS total, CAST(MIN(amt) AS DOUBLE) AS least
FROM f WHERE NOT COALESCE(amt < 0, FALSE) GROUP BY _chunk, Company_ID""", dirty=True)
    q["statistical_anomalies_single"] = with_ledger("""
WITH t0 AS (SELECT quantile_cont(CAST(Amount * 100 AS DOUBLE), 0.25) AS q1p, quantile_cont(CAST(Amount * 100 AS DOUBLE), 0.75)
              AS q3p, COUNT(Amount) AS n_nonnull FROM ledger),
t AS (SELECT *, q3p + 3.0 * (q3p - q1p) AS tp FROM t0),
o AS (SELECT COUNT(*) AS c, SUM(Amount) AS s, MAX(Amount) AS m FROM ledger, t WHERE CAST(Amount * 100 AS DOUBLE) > tp)
SELECT n_nonnull >= 10 AS available, q1p / 100.0 AS q1, q3p / 100.0 AS q3, (q3p - q1p) / 100.0 AS iqr, tp / 100.0 AS threshold,
       c AS count, CAST(COALESCE(s, 0) AS DOUBLE) AS total_amount, CAST(m AS DOUBLE) AS max_amount, n_nonnull FROM t, o""")
    q["insight_messages"] = f"""SELECT Company_ID, seq, code, level, CASE
 WHEN code = 'net_result' AND level = 'info' THEN 'The period closed with a profit of ' || {amount} || ', ' || {one} || ' % of income.'
 WHEN code = 'net_result' THEN 'The period closed with a loss of ' || {amount} || '.'
 WHEN code = 'margin_band' THEN 'Of every rupee earned, ' || {one} || ' % is left as profit.'
 WHEN code = 'expense_ratio' THEN 'Expenses of ' || {amount} || ' use up ' || {one} || ' % of income.'
 WHEN code = 'major_head' THEN 'This head costs ' || {amount} || ', ' || {one} || ' % of all expenses.'
 WHEN code = 'gst_liability' THEN 'GST of ' || {amount} || ' is payable, ' || {one} || ' % of income.'
 WHEN code = 'large_txns' THEN CAST(n AS VARCHAR) || ' transactions exceed ' || {value} || '; the largest is ' || {amount} || '.'
 WHEN code = 's40a3_cash_expense' THEN CAST(n AS VARCHAR) || ' cash expenses over the limit, ' || {amount} || ' together, may not be deductible.'
 WHEN code = 's269st_cash' THEN CAST(n AS VARCHAR) || ' cash transactions reach the limit, ' || {amount} || ' together.'
 WHEN code = 's44ab_audit' THEN 'Turnover of ' || {amount} || ' needs an audit of the accounts.'
 WHEN code = 'tds_26q' THEN 'Tax is to be deducted at source from payments of ' || {amount} || '.'
 WHEN code = 's208_advance_tax' THEN 'An advance tax instalment of about ' || {amount} || ' is due.'
 WHEN code = 's17_5_blocked_itc' THEN 'GST credit of ' || {amount} || ' on blocked items cannot be taken.'
 WHEN code = 'leverage' THEN 'Liabilities stand at ' || {one} || ' times the assets.' END AS message
FROM ({insight_sql()["compliance_insights"]}) i"""
    nodes = ", ".join(map(str, GIVEN_NODES))
    q["forest_score_of_given"] = with_ledger(f"""
SELECT * FROM (WITH RECURSIVE n AS (SELECT *, CASE WHEN size > 2 THEN 2 * (LN(size - 1.0) + 0.5772156649015329) - 2 * (size - 1.0) / size
                                WHEN size = 2 THEN 1.0 ELSE 0.0 END AS c
      FROM (VALUES {nodes}) t(tree, node, feature, threshold, "left", "right", size, depth)),
r AS (SELECT ROW_NUMBER() OVER () AS id, Company_ID, Date, CAST(Amount AS DOUBLE) AS Amount, GST_Percentage,
             [CAST(CAST(CAST(Amount AS DOUBLE) AS FLOAT) AS DOUBLE), CAST(month(Date) AS DOUBLE), CAST(GST_Percentage AS DOUBLE)] AS x
      FROM ledger),
w(id, x, tree, node) AS (SELECT id, x, tree, 0 FROM r CROSS JOIN (SELECT DISTINCT tree FROM n) UNION ALL
      SELECT w.id, w.x, w.tree, CASE WHEN w.x[n.feature + 1] <= n.threshold THEN n."left" ELSE n."right" END
      FROM w JOIN n ON w.tree = n.tree AND w.node = n.node WHERE n.feature >= 0),
h AS (SELECT id, AVG(depth + c) AS h FROM w JOIN n ON w.tree = n.tree AND w.node = n.node WHERE n.feature < 0 GROUP BY id)
SELECT Company_ID, strftime(Date, '%Y-%m-%d') AS Date, Amount, GST_Percentage,
       ROUND(-POWER(2.0, -h / (2 * (LN({GIVEN_PSI} - 1.0) + 0.5772156649015329) - 2 * ({GIVEN_PSI} - 1.0) / {GIVEN_PSI})), 9) AS score_samples
FROM r JOIN h ON r.id = h.id) s""")
    flags = """g AS (SELECT *, CASE WHEN CAST(Amount * 100 AS BIGINT) % 11 <> 0 THEN CAST(Amount * 100 AS BIGINT) % 37 = 0 END AS flag,
       CAST((CAST(Amount * 100 AS BIGINT) * 7919) % 1000 AS DOUBLE) / 1000.0 - 0.5 AS score FROM ledger)"""
    q["anomaly_summary_of_given"] = with_ledger(f"""
WITH {flags},
t0 AS (SELECT Company_ID, quantile_cont(CAST(Amount * 100 AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(Amount * 100 AS DOUBLE), 0.75)
       AS q3 FROM ledger GROUP BY Company_ID HAVING COUNT(Amount) >= 10),
s AS (SELECT g.Company_ID, COALESCE(CAST(Amount * 100 AS DOUBLE) > q3 + 3.0 * (q3 - q1), FALSE) AS stat, COALESCE(flag, FALSE) AS ml
      FROM g LEFT JOIN t0 ON g.Company_ID = t0.Company_ID)
SELECT Company_ID, COUNT_IF(stat) AS statistical_count, COUNT_IF(ml) AS ml_count, COUNT_IF(stat OR ml) AS total_unique,
       COUNT(*) AS rows FROM s GROUP BY Company_ID""")
    q["predicted_anomaly_rows_of_given"] = with_ledger(f"""
WITH {flags},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Company_ID ORDER BY score, Amount DESC, Date NULLS LAST, Description NULLS LAST)
      AS rk FROM g WHERE flag)
SELECT Company_ID, CAST(rk AS INTEGER) AS rank, strftime(Date, '%Y-%m-%d') AS Date, Description, CAST(Amount AS DOUBLE) AS Amount,
       score AS Anomaly_Score FROM r WHERE rk <= 100""")
    names = ["accuracy over 0.9", "confidence between 25 and 100", "fallback below 70 % confidence", "every row predicted",
             "forest flags between 4 and 6 %", "scores within one"]
    q["model_properties"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', TRUE)" for n in names) + ") t(property, holds)"
    return q
