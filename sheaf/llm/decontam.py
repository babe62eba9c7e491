"""Benchmark decontamination by template canonicalisation.

Numbers, the units behind them and names inside a sentence become typed placeholders, the other words are lower-cased.
Windows of ``width`` template words of every benchmark item are hash-joined with the windows of every whole document.
An item leaks into a document when at least ``coverage`` of its windows are found there and its slots are filled
consistently: each value of a slot in the item stands for one value of the same type in the document. So a question
with other numbers and names is still caught. Both are judged for every occurrence by itself (windows at about one shift
between document and item, in bands of half an item) and for the whole document; the best counts. Only built-in functions
run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_broadcast, table, written

WIDTH = 5
COVERAGE = 0.5
CONSISTENT = 0.8
#: A window joins only with this many words that are no placeholders.
LITERALS = 3
#: The band of all a document's windows together.
WHOLE = -(1 << 62)

#: Units that count as a slot behind a number.
UNITS = ("kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles?|feet|ft|inch(?:es)?|yards?|l|ml|liters?|litres?|gallons?|h|hrs?|hours?|"
         "min|minutes?|s|sec|seconds?|days?|weeks?|months?|years?|dollars?|cents?|euros?|pounds?|usd|eur|percent|degrees?")
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"


def template_words(text: Column) -> Column:
    """Words of a text; a slot's word begins with its type's mark, other words are lower case. Null: none."""
    t = F.translate(text, NAME + NUMBER + UNIT, "   ")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;:] )(?=\p{Lu})", NAME)
    t = F.regexp_replace(t, rf"(?<=\p{{N}})[\x20-]?(?=(?i:{UNITS})(?![\p{{L}}\p{{N}}]))", f" {UNIT}")
    t = F.regexp_replace(t, r"(?<!\p{N})(?=\p{N})", f" {NUMBER}")
    words = F.split(F.lower(t), r"[^\p{L}\p{M}\p{N}\x01-\x03]+")
    return F.coalesce(F.array_remove(words, ""), F.array().cast("array<string>"))


def _template(word: Column) -> Column:
    return F.when(word < "\x04", F.substring(word, 1, 1)).otherwise(word)


def _with_windows(df: DataFrame, width: int) -> DataFrame:
    """Adds ``windows``: (place, key, its words) of every window of ``words``; a shorter text is one window."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(_template(w))))
    mixed = F.col("h")
    for k in range(1, width):  # each window's hash mixes its words' hashes in order
        shifted = F.slice("h", k + 1, F.greatest(F.size("h") - k, F.lit(0)))
        mixed = F.zip_with(mixed, shifted, lambda a, b: F.xxhash64(a, b))
    keys = F.slice(mixed, 1, F.greatest(F.size("h") - width + 1, F.lit(1)))
    return df.withColumn("keys", keys).drop("h")


def _placed(df: DataFrame, width: int) -> DataFrame:
    """A row per window: id columns, place q, key and the window's words."""
    window = F.transform("keys", lambda k, i: F.struct(i.alias("q"), k.alias("key"), F.slice("words", i + 1, width).alias("own")))
    ids = [c for c in df.columns if c not in ("keys", "words")]
    return df.select(*ids, F.explode_outer(window).alias("w")).select(*ids, "w.q", "w.key", "w.own").where("q is not null")


def _item_windows(benchmark: DataFrame, width: int, literals: int) -> DataFrame:
    words = benchmark.select(F.col("item_id"), template_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    at = _placed(_with_windows(words, width), width).withColumnRenamed("own", "item_words")
    kept = at.withColumn("plain", F.size(F.filter("item_words", lambda w: w >= "\x04")))
    # an item with no window of enough plain words joins by all its windows
    most = kept.groupBy("item_id").agg(F.max("plain").alias("most"))
    return kept.join(most, "item_id").where(F.col("plain") >= F.least(F.col("most"), F.lit(literals))).select(
        "item_id", "q", "key", "item_words")


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, coverage: float = COVERAGE,
          consistent: float = CONSISTENT, literals: int = LITERALS) -> DataFrame:
    """Per leaked item of a document: doc_id, item_id, windows (of the item), matched, slots, consistent_slots, verbatim.

    ``verbatim`` says that every slot holds the item's own value. Null or empty texts and items match nothing. Rows that
    repeat a doc_id or an item_id count as one document or item (each window place once). Other columns are ignored.
    """
    items = written(spark, _item_windows(benchmark.where("item_id is not null"), width, literals), "decontam-items")
    # two occurrences are an item's length apart: a band of two steps never holds both
    sizes = items.groupBy("item_id").agg(F.countDistinct("q").alias("windows"), F.greatest(
        F.floor((F.max("q") + 1) / 4), F.lit(1)).alias("step"))
    keys = written(spark, items.select("key").distinct(), "decontam-keys")
    words = docs.select("doc_id", F.col("text")).where("text is not null and doc_id is not null").select(
        "doc_id", template_words(F.col("text")).alias("words"))
    # outer: a plain explode lets the planner push a size test of the whole expression down, computing it over again
    places = _with_windows(words, width).select("doc_id", F.explode_outer("keys").alias("key"))
    hits = written(spark, places.join(bounded_broadcast(keys), "key", "left_semi"), "decontam-hits")
    pairs = hits.select("doc_id", "key").distinct().join(items.select("item_id", "q", "key"), "key")
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.countDistinct("q").alias("matched")).join(sizes, "item_id")
    pairs = written(spark, pairs.where(F.col("matched") >= coverage * F.col("windows")), "decontam-pairs")
    # slots of the surviving pairs, read from the documents' own words
    found = written(spark, pairs.select("doc_id").distinct(), "decontam-docs")
    near = words.join(bounded_broadcast(found), "doc_id", "left_semi")
    own = _placed(_with_windows(near, width), width).select("doc_id", F.col("q").alias("p"), "key", F.col("own").alias("doc_words"))
    half = F.floor((F.col("p") - F.col("q")) / F.col("step"))
    bands = F.array(F.lit(WHOLE), half - 1, half)  # neighbouring bands overlap by half
    aligned = pairs.join(items, "item_id").join(own, ["doc_id", "key"]).select(
        "doc_id", "item_id", "q", "item_words", "doc_words", F.explode(bands).alias("band")).distinct()
    aligned = written(spark, aligned, "decontam-aligned")
    matched = aligned.groupBy("doc_id", "item_id", "band").agg(F.countDistinct("q").alias("matched"))
    slots = (aligned.select("doc_id", "item_id", "band", F.explode(F.filter(
        F.arrays_zip("item_words", "doc_words"), lambda z: z["item_words"] < "\x04")).alias("z"))
        .select("doc_id", "item_id", "band", F.col("z.item_words").alias("iv"), F.col("z.doc_words").alias("dv")).distinct())
    value = slots.groupBy("doc_id", "item_id", "band", "iv").agg(F.count(F.lit(1)).alias("ways"),
                                                         F.max((F.col("iv") == F.col("dv")).cast("int")).alias("same"))
    judged = value.groupBy("doc_id", "item_id", "band").agg(
        F.count(F.lit(1)).alias("slots"),
        F.sum(((F.col("ways") == 1) | (F.col("same") == 1)).cast("long")).alias("consistent_slots"),
        F.min("same").alias("same"))
    out = pairs.drop("matched").join(matched, ["doc_id", "item_id"]).where(F.col("matched") >= coverage * F.col("windows"))
    out = out.join(judged, ["doc_id", "item_id", "band"], "left").select(
        "doc_id", "item_id", "windows", "matched", F.coalesce("slots", F.lit(0)).alias("slots"),
        F.coalesce("consistent_slots", F.lit(0)).alias("consistent_slots"),
        (F.coalesce("same", F.lit(1)) == 1).alias("verbatim"))
    best = F.max(F.struct("matched", "consistent_slots", "verbatim", "slots")).alias("best")
    return out.where(F.col("consistent_slots") >= consistent * F.col("slots")).groupBy("doc_id", "item_id", "windows").agg(
        best).select("doc_id", "item_id", "windows", "best.matched", "best.slots", "best.consistent_slots", "best.verbatim")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leak into documents."""
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
