"""Category classifier: Spark ML multinomial model on the feature matrix, with the confidence-gated
keyword fallback, an exact stratified split and the evaluation tables.

Re-aimed: the reference trains a dense neural network; here the same task
(4 classes from description, amount, mode, month, weekend) uses
``LogisticRegression(family="multinomial")`` (or ``MultilayerPerceptronClassifier``)
so training is a distributed Spark ML job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, LABELS, Thresholds
from ..functions.scalars import category_index
from ..functions.text import keyword_category
from ..session import written
from . import features as fx


@dataclass
class CategoryModel:
    features: PipelineModel
    classifier: object  # fitted Spark ML classification model


def content_hash(cols: list[str]):
    """60 bits of the MD5 of the columns as text, a null being ``~`` (any SQL engine can compute it)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def split_train_test(df: DataFrame, t: Thresholds = DEFAULT, key_cols: list[str] | None = None, class_col: str = "Category",
                     hash_col: str | None = None):
    """(train, test): of every class exactly round(``test_fraction`` x rows) rows are test rows, those of the lowest content hash.

    One scan counts rows by class and hash bucket (65,536 buckets, combined map-side). A running count over the buckets finds
    each class's cut bucket; lower buckets are test, higher ones train, and only the rows of the cut bucket are ranked, by
    hash, content and copy, and written. Equal rows are interchangeable, so a seedless split is the same for any partition count.
    ``hash_col`` names a column that already holds ``content_hash`` of the key columns; it is left out of the result.
    """
    cols = key_cols or [c for c in df.columns if not c.startswith("_")]
    group = F.coalesce(F.col(f"`{class_col}`").cast("string"), F.lit("\u0000")).alias("_class")
    kept = [c for c in df.columns if c != hash_col]
    known = content_hash(cols) if hash_col is None else F.col(f"`{hash_col}`")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], known.alias("_hash"), group).withColumn("_bucket", F.shiftright("_hash", 44))
    counts = rows.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(df.sparkSession, counts, "split-counts")
    totals = counts.groupBy("_class").agg(F.round(F.sum("_n") * t.test_fraction).cast("long").alias("_want"))
    run = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_n").over(run)).join(totals, "_class")
    cuts = counts.filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
    cuts = written(df.sparkSession, cuts.select("_class", F.col("_bucket").alias("_cut"),
                                                (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_need")), "split-cuts")
    rows = rows.join(cuts, "_class", "left")  # a class of no test rows has no cut
    low = F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False))
    at = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    order = Window.partitionBy("_class").orderBy("_hash", *[F.col(f"`{c}`") for c in cols])
    ranked = rows.filter(at).withColumn("_test", F.row_number().over(order) <= F.col("_need")).select(*kept, "_test")
    ranked = written(df.sparkSession, ranked, "split-ranked")  # each use of a part would scan all rows for these few
    train = rows.filter(~low & ~at).select(kept).unionByName(ranked.filter(~F.col("_test")).select(kept))
    test = rows.filter(low).select(kept).unionByName(ranked.filter("_test").select(kept))
    return train, test


def fit(df: DataFrame, t: Thresholds = DEFAULT, kind: str = "logistic") -> CategoryModel:
    """Fit feature pipeline and classifier on labelled ledger rows (Category in the four classes)."""
    labelled = df.filter(F.col("Category").isin(*LABELS)).withColumn("label", category_index("Category")
                                                                     .cast("double"))
    spec = fx.fit_feature_spec(labelled, t)
    pipe = fx.feature_pipeline(spec)
    data = fx.transform(pipe, labelled).select("features", "label")
    if kind == "mlp":
        n_in = len(spec.vocabulary) + 4
        clf = MultilayerPerceptronClassifier(layers=[n_in, 64, len(LABELS)], seed=t.seed, maxIter=t.train_iterations)
    else:
        clf = LogisticRegression(family="multinomial", maxIter=t.train_iterations, regParam=1e-4,
                                 standardization=True)
    return CategoryModel(pipe, clf.fit(data))


def fit_on_features(features: PipelineModel, train: DataFrame, t: Thresholds = DEFAULT,
                    kind: str = "logistic") -> CategoryModel:
    """Fit the classifier on rows that already carry ``features`` (the fitted pipeline is kept)."""
    data = train.filter(F.col("Category").isin(*LABELS)).select(
        "features", category_index("Category").cast("double").alias("label"))
    if kind == "mlp":
        n_in = len(data.first()["features"])
        clf = MultilayerPerceptronClassifier(layers=[n_in, 64, len(LABELS)], seed=t.seed, maxIter=t.train_iterations)
    else:
        clf = LogisticRegression(family="multinomial", maxIter=t.train_iterations, regParam=1e-4, standardization=True)
    return CategoryModel(features, clf.fit(data))


def predict_categories(model: CategoryModel, df: DataFrame, t: Thresholds = DEFAULT,
                       features_ready: bool = False) -> DataFrame:
    """Arg-max class; when the top probability is below the threshold the keyword fallback decides.
    Confidence_pct = round(100 * p, 1) is kept unchanged by the fallback."""
    if not features_ready:
        df = fx.impute_for_inference(df)
    base = df if features_ready else fx.transform(model.features, df)
    keep = [c for c in df.columns if c != "features"] if features_ready else df.columns
    df = df.select(*keep)
    scored = model.classifier.transform(base)
    probs = vector_to_array("probability")
    p_max = F.array_max(probs)
    idx = (F.array_position(probs, p_max) - 1).cast("int")
    ml_label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), idx + 1)
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], *gated(ml_label, p_max, t))


def gated(ml_label, p_max, t: Thresholds = DEFAULT) -> list:
    """Predicted_Category, Confidence_pct and used_fallback from the model's class and its probability."""
    fallback = p_max < t.ml_confidence
    kw = keyword_category(F.col("Description"), F.coalesce(F.col("Amount"), F.lit(0)))
    return [F.when(fallback, kw).otherwise(ml_label).alias("Predicted_Category"),
            F.round(p_max * 100, 1).alias("Confidence_pct"), fallback.alias("used_fallback")]


def fallback_rate(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by if by is not None else (["Company_ID"] if "Company_ID" in pred.columns else [])
    agg = [(F.avg(F.col("used_fallback").cast("double")) * 100).alias("fallback_pct"), F.count(F.lit(1)).alias("n")]
    return pred.groupBy(*by).agg(*agg) if by else pred.agg(*agg)


def prediction_counts(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    from ..operators.rollups import category_distribution
    return category_distribution(pred, by, cat_col="Predicted_Category")


def evaluate(model: CategoryModel, test: DataFrame, t: Thresholds = DEFAULT, features_ready: bool = False) -> DataFrame:
    """Per class precision / recall / F1 / support plus an ``__accuracy__`` row, from the
    (label, prediction) confusion counts (a 4 x 4 table)."""
    test = test.filter(F.col("Category").isin(*LABELS))
    pred = model.classifier.transform(test if features_ready else fx.transform(model.features, test))
    return evaluate_pairs(pred.select(category_index("Category").alias("y"), F.col("prediction").cast("int").alias("p")))


def evaluate_pairs(pairs: DataFrame, averages: bool = False) -> DataFrame:
    """Per class precision / recall / F1 / support of (y, p) pairs plus an ``__accuracy__`` row.

    One aggregation of the pairs counts every class; the rest works on its one row. ``averages`` adds the ``__macro__``
    (plain) and ``__weighted__`` (by support) means of the classes.
    """
    counts = []
    for i in range(len(LABELS)):
        counts += [F.count_if((F.col("y") == i) & (F.col("p") == i)).alias(f"tp{i}"),
                   F.count_if(F.col("y") == i).alias(f"support{i}"), F.count_if(F.col("p") == i).alias(f"predicted{i}")]
    rows = ", ".join(f"'{lab}', tp{i}, support{i}, predicted{i}" for i, lab in enumerate(LABELS))
    m = pairs.agg(*counts).selectExpr(f"stack({len(LABELS)}, {rows}) AS (label, tp, support, predicted)")
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    m = m.select("label", prec.alias("precision"), rec.alias("recall"), "support", "tp")
    m = m.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall")
                                  / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    acc = m.agg(F.try_divide(F.sum("tp").cast("double"), F.sum("support").cast("double")).alias("precision"),
                F.sum("support").alias("support"))
    out = m.select("label", "precision", "recall", "f1", "support").unionByName(acc.select(
        F.lit("__accuracy__").alias("label"), "precision", F.col("precision").alias("recall"),
        F.col("precision").alias("f1"), "support"))
    if not averages:
        return out
    macro = m.agg(F.lit("__macro__").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
                  F.sum("support").alias("support"))
    total = F.sum("support")
    weighted = m.agg(F.lit("__weighted__").alias("label"), *[F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(c)
                                                             for c in ("precision", "recall", "f1")],
                     total.alias("support"))
    return out.unionByName(macro).unionByName(weighted)


def confusion_matrix(model: CategoryModel, test: DataFrame) -> DataFrame:
    pred = model.classifier.transform(fx.transform(model.features, test.filter(F.col("Category").isin(*LABELS))))
    return full_matrix(pred.select(category_index("Category").alias("label"), F.col("prediction").cast("int")
                                   .alias("prediction")))


def full_matrix(pairs: DataFrame) -> DataFrame:
    """(label, prediction, count) with all 16 cells, zeros included; one aggregation of the pairs."""
    cells = [F.count_if((F.col("label") == i) & (F.col("prediction") == j)).alias(f"c{i}{j}")
             for i in range(len(LABELS)) for j in range(len(LABELS))]
    rows = ", ".join(f"{i}, {j}, c{i}{j}" for i in range(len(LABELS)) for j in range(len(LABELS)))
    return pairs.agg(*cells).selectExpr(f"stack({len(LABELS) ** 2}, {rows}) AS (label, prediction, count)")


def low_confidence_rows(pred: DataFrame, below: float = 60.0) -> DataFrame:
    """Predictions whose confidence is under ``below`` percent (for review)."""
    return pred.filter(F.col("Confidence_pct") < below)


def save_category_model(model: CategoryModel, path: str) -> None:
    """Persist features + classifier as one standard ``PipelineModel`` (Spark ML persistence)."""
    PipelineModel(stages=[*model.features.stages, model.classifier]).write().overwrite().save(path)


def load_category_model(path: str) -> CategoryModel | None:
    """Load a saved model; None when the folder holds none (like the reference's missing artifacts)."""
    from ..sources.io import load_model
    pm = load_model(path)
    if pm is None:
        return None
    return CategoryModel(PipelineModel(stages=pm.stages[:-1]), pm.stages[-1])


def metrics_table(evaluation: DataFrame) -> DataFrame:
    """The evaluation rows shaped for ``write_metrics`` (one JSON object per class plus accuracy)."""
    return evaluation.select("label", "precision", "recall", "f1", "support")
