"""Feature matrix: TF-IDF of the cleaned description (uni+bigrams) || amount_scaled || mode || month || weekend.

Built from Spark ML transformers: the vocabulary (top 500 terms by corpus
count, min document frequency 2) and the smoothed idf come from one
distributed aggregation; only the 500 chosen terms and their weights reach
the driver. ``CountVectorizerModel.from_vocabulary`` + ``ElementwiseProduct``
(idf + 1) + ``Normalizer(p=2)`` then give the same weighting as a smoothed,
L2-normalised TF-IDF; vectors stay sparse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer,
                                StringIndexerModel, VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, DESCRIPTION_DEFAULT, PAYMENT_MODE_DEFAULT, Thresholds
from ..functions.scalars import is_weekend, month_or_one
from ..operators.common import attach_row


#: Different payment modes that a feature pipeline may hold as labels.
MAX_MODES = 100_000


def _tokens(desc: Column) -> Column:
    # clean_text changes only what is between tokens, so they are the same runs of the text in lower case
    return F.regexp_extract_all(F.lower(F.coalesce(desc, F.lit(DESCRIPTION_DEFAULT))), F.lit(r"[a-z0-9]{2,}"), 0)


def _pairs(toks: Column) -> Column:
    return F.split(F.regexp_replace(F.array_join(toks, " "), r"([a-z0-9]+) (?=([a-z0-9]+))", "$1 $2,"), ",")


def _with_bigrams(toks: Column, pairs: Column) -> Column:
    return F.concat(toks, F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))))


def description_terms(desc: Column) -> Column:
    """Unigrams (tokens of 2+ characters of the cleaned text) followed by the bigrams of those tokens.

    Built without lambda functions so it stays in generated code: tokens are
    ``regexp_extract_all`` of ``[a-z0-9]{2,}``; bigrams come from one
    ``regexp_replace`` that rewrites "a b c" as "a b,b c,c" (look-ahead keeps
    the next token), split on ',' and the trailing single token sliced off.
    """
    return _with_bigrams(_tokens(desc), _pairs(_tokens(desc)))


def with_terms(df: DataFrame, keep: list[str] | None = None, name: str = "_terms") -> DataFrame:
    """``df`` (or its columns ``keep``) with ``description_terms`` of Description as ``name``.

    Each step is a column of its own: one that the next step reads twice is computed once a row.
    """
    cols = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    out = df.select(*cols, _tokens(F.col("Description")).alias("_tokens"))
    out = out.select(*cols, "_tokens", _pairs(F.col("_tokens")).alias("_pairs"))
    return out.select(*cols, _with_bigrams(F.col("_tokens"), F.col("_pairs")).alias(name))


def term_document_frequency(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Vocabulary table: term, corpus count, document frequency, smoothed idf, rank (top-N by count).

    One scan: a document's terms are sorted, and each explodes once with a flag on the first of equal neighbours, which
    stands for the document. One aggregate per term (map-side combined) sums both. The top N is a distributed limit.
    """
    from pyspark.sql import Window
    docs = with_terms(df, keep=[]).select(F.sort_array("_terms").alias("term"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("term", F.lit(1), F.greatest(F.size("term") - 1, F.lit(0))))
    each = docs.select("term", before.alias("before")).select(F.inline(F.arrays_zip("term", "before")))
    each = each.filter(F.col("term").isNotNull())  # a document without terms leaves one empty pair
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("tf"),
                                      F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("df"))
    n = df.agg(F.count(F.lit(1)).alias("n_docs"))
    j = attach_row(counts.filter(F.col("df") >= t.tfidf_min_df), n)  # n: one global count
    order = [F.col("tf").desc(), F.col("term").asc()]
    j = j.orderBy(*order).limit(t.tfidf_max_features)  # a distributed top-k at any size; only its rows are ranked
    j = j.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    idf = F.log((F.col("n_docs") + 1).cast("double") / (F.col("df") + 1).cast("double")) + 1.0
    return j.select("term", "tf", "df", "n_docs", F.round(idf, 9).alias("idf"), "rank")


def payment_mode_index(df: DataFrame) -> DataFrame:
    """Sorted distinct payment modes (null -> the default mode) with their index: a written dimension table.

    The modes are sorted by range and numbered in two phases (offsets of the ranges, places inside), so a dirty column with
    any number of different values never meets in one task.
    """
    from ..session import written
    from ..sources.lines import BLOCK, FILE, ID, numbered
    m = df.select(F.coalesce(F.col("Payment_Mode"), F.lit(PAYMENT_MODE_DEFAULT)).alias("payment_mode")).distinct()
    m = m.repartitionByRange("payment_mode").sortWithinPartitions("payment_mode")
    m = m.select("payment_mode", F.lit("").alias(FILE), F.spark_partition_id().alias(BLOCK), F.monotonically_increasing_id().alias(ID))
    m = numbered(written(df.sparkSession, m, "payment-modes"), "_n")
    return m.select("payment_mode", (F.col("_n") - 1).cast("int").alias("mode_index"))


def log_amount(amount: Column) -> Column:
    """log1p of the amount; a null or negative amount counts as 0 (log1p has no value from -1 down)."""
    return F.log1p(F.greatest(F.coalesce(amount, F.lit(0)).cast("double"), F.lit(0.0)))


def impute_for_inference(df: DataFrame) -> DataFrame:
    """A raw ledger made ready for a fitted pipeline: absent columns are null, a null Amount is the ledger's median."""
    from ..operators.clean import group_median_amount
    absent = {"Amount": "decimal(18,2)", "Date": "date", "Description": "string", "Payment_Mode": "string"}
    df = df.withColumns({c: F.lit(None).cast(k) for c, k in absent.items() if c not in df.columns})
    if df.filter(F.col("Amount").isNull()).isEmpty():
        return df
    median = group_median_amount(df, []).first()[0]
    return df.withColumn("Amount", F.coalesce(F.col("Amount"), F.lit(median).cast(df.schema["Amount"].dataType)))


def amount_scaling(df: DataFrame) -> DataFrame:
    """Mean and population standard deviation of log1p(Amount) (null and negative amounts -> 0)."""
    la = log_amount(F.col("Amount"))
    return df.agg(F.avg(la).alias("mean"), F.stddev_pop(la).alias("std"), F.count(F.lit(1)).alias("n"))


@dataclass
class FeatureSpec:
    vocabulary: list[str]
    idf: list[float]
    modes: list[str]
    mean: float
    std: float


def fit_feature_spec(df: DataFrame, t: Thresholds = DEFAULT) -> FeatureSpec:
    """Fit vocabulary/idf, payment-mode labels and amount scaling (small results only reach the driver)."""
    voc = term_document_frequency(df, t).orderBy("rank").select("term", "idf").collect()  # <= max_features rows
    modes = [r[0] for r in payment_mode_index(df).orderBy("mode_index").select("payment_mode").limit(MAX_MODES + 1).collect()]
    if len(modes) > MAX_MODES:  # the fitted pipeline holds the labels
        raise ValueError(f"Payment_Mode holds more than {MAX_MODES} different values: it is no category")
    s = amount_scaling(df).first()
    std = s["std"] if s["std"] and s["std"] > 0 else 1.0
    return FeatureSpec([r["term"] for r in voc], [float(r["idf"]) for r in voc], modes, float(s["mean"] or 0.0),
                       float(std))


def text_pipeline(spec: FeatureSpec) -> PipelineModel:
    """``_terms`` to the sparse, L2-normalised vector ``tfidf``."""
    cv = CountVectorizerModel.from_vocabulary(spec.vocabulary or ["__none__"], inputCol="_terms", outputCol="_tf")
    idf = ElementwiseProduct(scalingVec=Vectors.dense(spec.idf or [1.0]), inputCol="_tf", outputCol="_tfidf_raw")
    return PipelineModel(stages=[cv, idf, Normalizer(p=2.0, inputCol="_tfidf_raw", outputCol="tfidf")])


def feature_pipeline(spec: FeatureSpec) -> PipelineModel:
    """A fitted PipelineModel producing ``features`` (tfidf || amount_scaled || mode || month || weekend)."""
    prep = SQLTransformer(statement=(
        "SELECT *, coalesce(Payment_Mode, '" + PAYMENT_MODE_DEFAULT + "') AS _mode, "
        f"(log1p(greatest(CAST(coalesce(Amount, 0) AS DOUBLE), 0D)) - {spec.mean!r}D) / {spec.std!r}D AS amount_scaled "
        "FROM __THIS__"))
    pm = StringIndexerModel.from_labels(spec.modes or [PAYMENT_MODE_DEFAULT], inputCol="_mode",
                                        outputCol="_mode_idx", handleInvalid="keep")
    n_modes = len(spec.modes or [PAYMENT_MODE_DEFAULT])
    clamp = SQLTransformer(statement=(
        f"SELECT *, CASE WHEN _mode_idx >= {n_modes} THEN 0D ELSE _mode_idx END AS mode_index FROM __THIS__"))
    asm = VectorAssembler(inputCols=["tfidf", "amount_scaled", "mode_index", "month", "is_weekend"],
                          outputCol="features")
    return PipelineModel(stages=[prep, *text_pipeline(spec).stages, pm, clamp, asm])


def with_inputs(df: DataFrame) -> DataFrame:
    """Columns the pipeline reads: terms, month, weekend flag."""
    d = F.col("Date")
    return with_terms(df).withColumns({"month": month_or_one(d).cast("double"), "is_weekend": is_weekend(d).cast("double")})


def term_weights(df: DataFrame, vector: str = "tfidf") -> DataFrame:
    """``df`` with ``term_weights`` in place of a TF-IDF vector: its entries (rank, weight), rank 1 being the most frequent term.

    The entries are read off the sparse vector as it is (no dense array, no Python).
    """
    v = F.unwrap_udt(vector)
    rank = F.when(v["indices"].isNotNull(), v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    entries = F.zip_with(rank, v["values"], lambda i, w: F.struct((i + 1).alias("rank"), w.alias("weight")))
    rest = [c for c in df.columns if c != vector]
    return df.select(*[F.col(f"`{c}`") for c in rest], F.filter(entries, lambda e: e["weight"] != 0).alias("term_weights"))


def tfidf_weights(df: DataFrame, keys: list[str], corpus: DataFrame | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """Per row of ``df`` and term of the vocabulary in its description: the keys, term and L2-normalised TF-IDF weight.

    The vocabulary is fitted on ``corpus`` (``df`` itself without one). A row without any such term has no row here.
    """
    vocabulary = term_document_frequency(df if corpus is None else corpus, t).orderBy("rank").select("rank", "term", "idf").collect()  # <= max_features rows
    spec = FeatureSpec([r["term"] for r in vocabulary], [float(r["idf"]) for r in vocabulary], [], 0.0, 1.0)
    rows = text_pipeline(spec).transform(with_terms(df, keys))
    # outer: no filter on the vector is inferred and pushed below a grouping of ``df``, where it would be computed for every row
    each = term_weights(rows.select(*keys, "tfidf")).select(*keys, F.inline_outer("term_weights")).filter(F.col("rank").isNotNull())
    if not vocabulary:
        return each.select(*keys, F.lit("").alias("term"), "weight").limit(0)
    names = df.sparkSession.createDataFrame([(r["rank"], r["term"]) for r in vocabulary], "rank int, term string")
    return each.join(F.broadcast(names), "rank").select(*keys, "term", "weight")


def transform(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    out = pipeline.transform(with_inputs(df))
    return out.drop("_terms", "_tf", "_tfidf_raw", "_mode", "_mode_idx")
