"""Spelling variants against brute force, on odd words and skewed signatures."""

import random
import re
import zlib

import pytest

from sheaf.llm.spelling import damaged_words, near_words, spelling_variants


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [x for x in counts if edit_one(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def python_words(rows, least=7, every=31):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] = counts.get(run, 0) + 1
    return counts


@pytest.mark.parametrize("parts", [3, 4, 6])
def test_forms_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    counts = {"a": 1, "b": 200, "ab": 15, "": 3, "ba": 4, "éa": 1, "漢字": 9, "漢": 100, "𝒳𝒴": 3, "𝒳": 40}
    for _ in range(300):  # few letters: anagrams and repeated letters share signatures
        counts["".join(rng.choice("aabcé") for _ in range(rng.randrange(1, 9)))] = rng.choice([1, 2, 9, 10, 30, 100, 1000])
    for _ in range(40):  # chains of ever more frequent spellings
        w, n = "".join(rng.choice("nopqrst") for _ in range(9)), 2
        for _ in range(4):
            counts[w] = n
            i = rng.randrange(len(w))
            w, n = w[:i] + rng.choice(["", "x", "yz"]) + w[i + 1:], n * rng.choice([5, 10, 20])
    rows = [(w, n, "clash") for w, n in counts.items()] + [(None, 5, "x"), ("gone", None, "x")]
    df = spark.createDataFrame(rows, "word string, n long, sig string")
    assert result(spelling_variants(spark, df, parts=parts)) == brute(counts)


def test_repeated_words_add_up_and_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("letter", 1), ("letters", 5), ("letters", 5), ("lettera", 10), ("letterb", 9)], "word string, n long")
    got = result(spelling_variants(spark, df))
    assert got["letter"] == ("lettera", "lettera", 1, 3, 10)
    assert got["letters"] == (None, "letters", 10, 3, None)


def test_every_pair_of_a_hot_signature_is_found(spark):
    # one stem holds most words: all variants of one place are near each other
    words = {"prefixed" + c + "suffixed" for c in "abcdefghijklmnopqrstuvwxyz"} | {"prefixedsuffixed"}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {frozenset((r.a, r.b)) for r in near_words(spark, df).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if a < b and edit_one(a, b)}


def test_words_of_texts_equal_python(spark):
    rng = random.Random(1)
    vocab = ["Straße", "Überraschung", "garçonnet", "ÉLÉPHANTESQUE", "letters", "Lettersx", "x" * 50, "naïvement", "ÿÿÿÿÿÿÿÀ"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, "letters letters"), (7, None), (8, ""), (9, "letters" * 30_000), (2 ** 60 + 1, "a-letters_LETTERS9letters×÷")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, run string, h int")
    got = {r.word: r.n for r in damaged_words(df).collect()}
    assert got == python_words(rows)
    assert any(w not in {v.translate({c: c + 32 for c in range(65, 91)}) for v in vocab} for w in got)  # some are damaged


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert damaged_words(docs).count() == 0
    assert spelling_variants(spark, damaged_words(docs)).collect() == []
    one = spelling_variants(spark, spark.createDataFrame([("alone", 3)], "word string, n long"))
    assert result(one) == {"alone": (None, "alone", 3, 0, None)}


def test_query_equals_brute_force_on_a_small_table(spark, tmp_path):
    from sheaf.llm.spelling import op11_spelling_variants

    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeïß") for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab[:1 + rng.randrange(60)]) for _ in range(40))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {w: n for w, n in python_words(rows).items() if n >= 2}
    assert result(op11_spelling_variants(spark, str(tmp_path))) == brute(counts)
