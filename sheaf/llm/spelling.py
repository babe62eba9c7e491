"""Spelling variant grouping by PartEnum signatures of letter multisets.

A word's letter multiset is a binary vector with one place for each (letter, how often). Two words of equal length that
differ by one replaced letter have vectors at Hamming distance two; one inserted or deleted letter makes it one. The
places are dealt to ``parts`` parts by letter. Whatever the letters, two differing places leave some ``parts - 2`` parts
equal, and one differing place some ``parts - 1``: every choice of so many parts is enumerated, and the projection of the
vector on the chosen parts is a signature. Words that share one are joined, and every pair is verified by its edit
distance, so the result is exact.

Words with the same letters in another order share every signature. Therefore a signature also holds the length of the
shorter word and the half of the word that the edit leaves whole: the first or the second one, both are enumerated.

Everything is built-in functions and equi-joins; large signature groups are skewed join partitions, which Spark splits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, written

#: Second-level parts of the letters: 2 x 6 signatures for equal lengths, 2 x 2 x 4 for lengths that differ by one.
PARTS = 4
#: So many of the most frequent letters are dealt evenly to the parts; all others share a part. Any deal is exact.
LETTERS = 256
#: Maximal runs of letters. Shorter ones than the least length can be left out: a deletion makes none longer.
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged_words(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): distinct lower-cased letter runs of whole texts, some of them with one letter deleted by a rule.

    A run whose ``crc32("<doc_id>:<run>")`` is a multiple of ``every`` loses the letter at that number modulo its length.
    Words of fewer than ``least`` letters are dropped. Null texts hold no run; a null doc_id counts as an empty one.
    Copies are counted each; columns other than doc_id and text are ignored. Counts are combined before the shuffle.
    """
    runs = F.regexp_extract_all("text", F.lit(RUN + "{%d,}+" % least), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = run.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    run = run.select("run", h.alias("h"), F.pmod(h, F.length("run")).cast("int").alias("at"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    word = F.when(F.pmod("h", F.lit(every)) == 0, cut).otherwise(F.col("run"))
    return run.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _alphabet(words: DataFrame) -> str:
    """The most frequent letters, in order (a bounded string)."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").groupBy("c").count()
    return "".join(r["c"] for r in letters.orderBy(F.desc("count"), "c").limit(LETTERS).collect())


def _signatures(kind: str, chosen: int, parts: int, length: Column, first: Column, second: Column) -> Column:
    """Signatures over every choice of ``chosen`` parts, for either half that may be whole."""
    return F.array(*[F.xxhash64(F.lit(kind), F.lit(half), F.lit(i), length, whole, *[F.col(f"p{p}") for p in own])
                     for half, whole in enumerate((first, second)) for i, own in enumerate(combinations(range(parts), chosen))])


def near_words(spark: SparkSession, words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b), a < b in code-point order or a shorter than b: words that differ by one inserted, deleted or replaced letter.

    ``words``: distinct, not null. The result is a written table.
    """
    if parts < 3:
        raise ValueError("parts must be at least 3")
    alphabet = F.lit(_alphabet(words))
    letters = F.split("word", "")
    of = lambda p: F.array_join(F.array_sort(F.filter(
        letters, lambda c: (F.length(c) > 0) & (F.pmod(F.instr(alphabet, c), F.lit(parts)) == p))), "")
    base = written(spark, words.select("word", F.length("word").alias("l"), *[of(p).alias(f"p{p}") for p in range(parts)]),
                   "spelling-parts")
    w, size = F.col("word"), F.col("l")
    half = F.floor(size / 2).cast("int")
    equal = _signatures("equal", parts - 2, parts, size, F.substring(w, F.lit(1), half), F.substring(w, half + 1, size))
    short = _signatures("longer", parts - 1, parts, size, F.substring(w, F.lit(1), half), F.substring(w, half + 1, size))
    less = size - 1  # as the longer word: length and halves of the shorter one
    cut = F.floor(less / 2).cast("int")
    long = _signatures("longer", parts - 1, parts, less, F.substring(w, F.lit(1), cut), F.substring(w, cut + 2, size))
    a = base.select(F.explode(equal).alias("sig"), F.col("word").alias("a"))
    b = base.select(F.explode(equal).alias("sig"), F.col("word").alias("b"))
    same = a.join(b, "sig").where((F.col("a") < F.col("b")) & (F.length("a") == F.length("b")))
    a = base.select(F.explode(short).alias("sig"), F.col("word").alias("a"))
    b = base.where("l > 0").select(F.explode(long).alias("sig"), F.col("word").alias("b"))
    other = a.join(b, "sig").where(F.length("a") + 1 == F.length("b"))
    near = F.levenshtein("a", "b", 1) == 1
    return written(spark, same.where(near).select("a", "b").unionByName(other.where(near).select("a", "b")).distinct(),
                   "spelling-pairs")


def _roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: pointers are doubled until they stand still.

    A form is much more frequent than its word, so chains have no cycle and are short.
    """
    now = written(spark, forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(spark, now.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def spelling_variants(spark: SparkSession, words: DataFrame, *, ratio: int = 10, parts: int = PARTS) -> DataFrame:
    """Per distinct word of ``words`` (word, n): word, form, root, n, n_near and form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of the largest n
    (ties: the smallest in code-point order) if that n is at least ``ratio`` times the word's, else null; ``root`` follows
    forms to the last. Null words and null counts are left out, the counts of repeated words are added up.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: chains of forms must rise")
    words = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(spark, words, "spelling-words")
    pairs = near_words(spark, words.select("word"), parts)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                       F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("top"))
    out = words.join(best, "word", "left")
    enough = -F.col("top.m") >= ratio * F.col("n")
    out = written(spark, out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                    F.when(enough, F.col("top.near")).alias("form"),
                                    F.when(enough, -F.col("top.m")).alias("form_n")), "spelling-forms")
    roots = _roots(spark, out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                  "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant groups of all words of documents with at least 7 letters and 2 occurrences."""
    words = damaged_words(table(spark, sf_dir, "documents")).where("n >= 2")
    return spelling_variants(spark, words)
