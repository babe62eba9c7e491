"""Catalogue entries for the ML, file and streaming operators.

Fitted models are kept per (application, data folder) so repeated queries in
one session reuse them, the way a deployment loads saved artifacts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import anomalies, classify, iforest
from ..ml import features as fx
from ..session import app_id, delete_scratch, scratch_path
from ..sources import io
from ..sources.fixture import _MATERIALIZED, _source_stamp, ledger, ledger_dirty
from ..streaming import stream

_MODELS: dict[tuple, object] = {}


def _key(spark: SparkSession, sf_dir: str, what: str) -> tuple:
    return (app_id(spark), sf_dir.rstrip("/"), what, _source_stamp(spark, sf_dir))


def feature_model(spark: SparkSession, sf_dir: str):
    """Feature pipeline fitted on the whole ledger (vocabulary, idf, modes, scaling)."""
    k = _key(spark, sf_dir, "feature_model")
    if k not in _MODELS:
        _MODELS[k] = fx.feature_pipeline(fx.fit_feature_spec(ledger(spark, sf_dir)))
    return _MODELS[k]


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with their sparse ``features`` vector, written once to the shared folder:
    training, evaluation, prediction and the isolation forest all read it."""
    k = _key(spark, sf_dir, "feature_table")
    if k not in _MODELS:
        out = fx.transform(feature_model(spark, sf_dir), ledger(spark, sf_dir))
        # keep what training, prediction, the forest and the feature report read; the text vector is
        # kept only as its non-zero count (the full vector is inside ``features``), the split's hash as it is read often
        out = out.select(*KEYS, "features", nonzero_terms("tfidf"), "amount_scaled", "mode_index", "month",
                         "is_weekend", classify.content_hash(KEYS).alias("_split_hash"))
        path = scratch_path(spark, "features")
        out.write.mode("overwrite").parquet(path)
        _MODELS[k] = path
    return spark.read.parquet(_MODELS[k])


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the feature table: the split's counts and cuts are found once and serve training and evaluation."""
    k = _key(spark, sf_dir, "split")
    if k not in _MODELS:
        _MODELS[k] = classify.split_train_test(feature_table(spark, sf_dir), key_cols=KEYS, hash_col="_split_hash")
    return _MODELS[k]


def category_model(spark: SparkSession, sf_dir: str) -> classify.CategoryModel:
    k = _key(spark, sf_dir, "category_model")
    if k not in _MODELS:
        train, _ = _split(spark, sf_dir)
        _MODELS[k] = classify.fit_on_features(feature_model(spark, sf_dir), train)
    return _MODELS[k]


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.term_document_frequency(ledger(spark, sf_dir))


def payment_mode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.payment_mode_index(ledger(spark, sf_dir))


def amount_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.amount_scaling(ledger(spark, sf_dir))
    return s.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: number of non-zero TF-IDF terms and the four numeric features."""
    out = feature_table(spark, sf_dir)
    return out.select("Company_ID", "Category", "nonzero", F.round("amount_scaled", 6).alias("amount_scaled"),
                      "mode_index", "month", "is_weekend")


def nonzero_terms(col: str):
    """Number of non-zero entries, counted in the sparse vector itself."""
    return F.size(F.array_remove(F.unwrap_udt(col)["values"], 0.0)).alias("nonzero")


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per company, distinct description and term: the number of ledger rows, and the term's weight to 9 digits."""
    led = ledger(spark, sf_dir)
    rows = led.groupBy("Company_ID", "Description").agg(F.count(F.lit(1)).alias("n"))
    w = fx.tfidf_weights(rows, ["Company_ID", "Description", "n"], corpus=led)
    return w.withColumn("weight", F.round("weight", 9))


def classifier_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = category_model(spark, sf_dir)
    _, test = _split(spark, sf_dir)
    return classify.evaluate(model, test, features_ready=True)


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = category_model(spark, sf_dir)
    _, test = _split(spark, sf_dir)
    pred = model.classifier.transform(test.filter(F.col("Category").isin("Expense", "Income", "Asset",
                                                                         "Liability")))
    from ..functions.scalars import category_index
    return classify.full_matrix(pred.select(category_index("Category").alias("label"),
                                            F.col("prediction").cast("int").alias("prediction")))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.predict_categories(category_model(spark, sf_dir), feature_table(spark, sf_dir),
                                       features_ready=True)


def predict_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = _predicted(spark, sf_dir)
    return pred.select("Company_ID", F.date_format("Date", "yyyy-MM-dd").alias("Date"), "Description",
                       F.col("Amount").cast("double").alias("Amount"), "Category", "Predicted_Category",
                       "Confidence_pct", "used_fallback")


def prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.prediction_counts(_predicted(spark, sf_dir))


def fallback_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.fallback_rate(_predicted(spark, sf_dir))


KEYS = ["Company_ID", "Date", "Description", "Amount", "Category", "Sub_Category", "Payment_Mode",
        "Vendor_Client_Name", "GST_Amount"]
#: Columns that the reports on forest scores read.
SCORED = ["Company_ID", "Date", "Description", "Amount", "Category"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest scores written once; the cut-off (one scalar) is kept and applied when the scores are read."""
    k = _key(spark, sf_dir, "iforest_scored")
    if k not in _MODELS:
        feats = feature_table(spark, sf_dir)
        model = iforest.fit(feats, KEYS)
        raw = scratch_path(spark, "iforest_raw")
        iforest.score(model, feats, SCORED).write.mode("overwrite").parquet(raw)  # score once
        _MODELS[k] = (raw, iforest.offset(spark.read.parquet(raw)))
    raw, off = _MODELS[k]
    return iforest.apply_offset(spark.read.parquet(raw), off)


def isolation_forest_amount_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Amount-only fallback detector: a forest on log1p(Amount) alone, over the whole ledger."""
    feats = iforest.amount_only_features(ledger(spark, sf_dir).select(*KEYS))
    model = iforest.fit(feats, KEYS)
    raw = scratch_path(spark, "iforest_amount_raw")
    iforest.score(model, feats, ["Company_ID", "Date", "Amount", "Category"]).write.mode("overwrite").parquet(raw)
    scored = spark.read.parquet(raw)
    s = iforest.apply_offset(scored, iforest.offset(scored))
    return s.select("Company_ID", F.date_format("Date", "yyyy-MM-dd").alias("Date"),
                    F.col("Amount").cast("double").alias("Amount"), "Category", "Anomaly_Score",
                    "Is_Anomaly_Predicted")


def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("Company_ID", F.date_format("Date", "yyyy-MM-dd").alias("Date"),
                    F.col("Amount").cast("double").alias("Amount"), "Category", "Anomaly_Score",
                    "Is_Anomaly_Predicted")


def anomaly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.anomaly_summary(_scored(spark, sf_dir))


def predicted_anomaly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = anomalies.predicted_anomaly_rows(_scored(spark, sf_dir))
    return r.select("Company_ID", "rank", F.date_format("Date", "yyyy-MM-dd").alias("Date"), "Description",
                    F.col("Amount").cast("double").alias("Amount"), "Category", "Anomaly_Score")


def low_confidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = classify.low_confidence_rows(_predicted(spark, sf_dir))
    return r.select("Company_ID", F.date_format("Date", "yyyy-MM-dd").alias("Date"), "Description",
                    F.col("Amount").cast("double").alias("Amount"), "Category", "Predicted_Category",
                    "Confidence_pct", "used_fallback")


def read_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: write the ledger as one CSV folder per company, read every CSV back."""
    k = _key(spark, sf_dir, "ledger_csv")
    if k not in _MODELS:
        path = scratch_path(spark, "ledger_csv")
        io.write_by_company(ledger(spark, sf_dir), path)
        _MODELS[k] = path
    return io.read_ledgers(spark, _MODELS[k])


def stream_clean_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty ledger files by company -> file stream -> per-batch cleaning (one batch: all files)."""
    src = scratch_path(spark, "dirty_csv")
    io.write_by_company(ledger_dirty(spark, sf_dir), src, compression="gzip", slice_rows=io.SLICE_ROWS)
    out, ckpt = scratch_path(spark, "stream_clean_out"), scratch_path(spark, "stream_clean_ckpt")
    stream.stream_clean_ledger(spark, src, out, ckpt, files="*.csv.gz", task_bytes=stream.COMPRESSED_TASK_BYTES)
    delete_scratch(spark, src)
    return spark.read.parquet(out).drop("batch_id")


def stream_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger Parquet files -> file stream -> stateless rule hits in append mode."""
    src = _materialized_path(spark, sf_dir)
    out, ckpt = scratch_path(spark, "stream_rules_out"), scratch_path(spark, "stream_rules_ckpt")
    stream.stream_rule_hits(spark, src, out, ckpt, max_files_per_trigger=4)
    return spark.read.parquet(out)


def _materialized_path(spark: SparkSession, sf_dir: str) -> str:
    ledger(spark, sf_dir)
    for k, v in _MATERIALIZED.items():
        if k[0] == app_id(spark) and k[1] == sf_dir.rstrip("/") and not k[2]:
            return v
    raise RuntimeError("ledger table not materialized")


def queries() -> dict:
    return {
        "read_ledgers": read_ledgers,
        "stream_clean_ledger": stream_clean_ledger,
        "stream_rule_hits": stream_rule_hits,
        "term_document_frequency": term_document_frequency,
        "payment_mode_index": payment_mode_index,
        "amount_scaling": amount_scaling,
        "feature_matrix": feature_matrix,
        "tfidf_weights": tfidf_weights,
        "classifier_evaluation": classifier_evaluation,
        "confusion_matrix": confusion_matrix,
        "predict_categories": predict_categories,
        "prediction_counts": prediction_counts,
        "fallback_rate": fallback_rate,
        "isolation_forest": isolation_forest,
        "isolation_forest_amount_only": isolation_forest_amount_only,
        "anomaly_summary": anomaly_summary,
        "predicted_anomaly_rows": predicted_anomaly_rows,
        "low_confidence_rows": low_confidence_rows,
    }

