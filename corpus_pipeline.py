"""Corpus pipeline: language ID, near-dedup, benchmark decontamination, secret redaction, sequence packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``docs``. ``run``
writes each stage's rows as Parquet to the shared checkpoint folder and reads them back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.decontam import leaks
from sheaf.llm.langid import keep_identified, train_model
from sheaf.llm.neardup import near_duplicates
from sheaf.llm.packing import pack
from sheaf.llm.secrets import redacted, secret_spans
from sheaf.llm.store import bounded_broadcast, table, written

#: SQL can express neither the fitted language model nor the packing search; tests compare with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose text is null or has no letter, or where no language has 30 % of the words."""
    return keep_identified(docs, train_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id; five-word shingles, 0.8.

    Of rows that repeat a doc_id one stays (the first by text). Rows without a doc_id stay.
    """
    out = written(spark, near_duplicates(spark, docs).where("doc_id is not null"), "pipeline-neardup")
    drop = written(spark, out.where("not kept").select("doc_id").distinct(), "pipeline-drop")
    again = written(spark, out.groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    left = docs.join(bounded_broadcast(drop), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    once = left.join(bounded_broadcast(again), "doc_id", "left_anti").select(*docs.columns)
    first = Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    repeated = left.join(bounded_broadcast(again), "doc_id", "left_semi").select(
        *docs.columns, F.row_number().over(first).alias("__row")).where("__row = 1").drop("__row")
    return once.unionByName(repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers and names, go."""
    found = leaks(spark, docs, table(spark, sf_dir, "benchmark"))
    drop = written(spark, found.select("doc_id").distinct(), "pipeline-leaks")
    return docs.join(bounded_broadcast(drop), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked, and n_chars follows the new text."""
    kept = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id"), F.col("text"))
    out = secret_spans(kept, keep=["__row"])
    # a name of its own: inside lambdas a select's new column would hide the old one of the same name
    out = out.withColumn("__new", redacted(F.col("text"), F.col("found")))
    cols = []
    for f in docs.schema.fields:
        old = F.col("__row")[f.name]
        if f.name == "text":
            old = F.when(old.isNotNull(), F.col("__new"))
        elif f.name == "n_chars":
            old = F.when(F.size("found") > 0, F.length("__new").cast(f.dataType)).otherwise(old)
        cols.append(old.alias(f.name))
    return out.select(*cols)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
