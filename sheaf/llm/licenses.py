"""License scans with a positional index of rare licence words, in built-in functions.

A word is a run of ASCII letters and digits and of any characters beyond ASCII. One pass keeps, of every text, the places
of words that occur in licence templates. Inverse document frequencies come from all texts. Every template is looked up by
its anchor: the rarest word of its mandatory key phrases, however often that word occurs. Each place of an anchor in a text
gives one shift between text and template. The template is reported when the words of its mandatory key phrases stand at
their places under that shift, and ``VOTES`` different words of the template in all.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, written

#: Notices by label: text, then mandatory key phrases (each a part of the text).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0", ["compliance with the license", "licenses license 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this "
     "work", ["waived all copyright"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", ["free software", "terms of the gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ["permission to use copy modify and or distribute"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge",
                                                                                      "deal in the software without restriction"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
#: Phrases whose places are counted, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

VOTES = 3
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()} | {w for p, _ in PHRASES for w in p.split()})


def licence_places(docs: DataFrame, vocab: list[str]) -> DataFrame:
    """Per row: row (a number), doc_id, n_words and places (p, k): word p of the text is vocab[k - 1]."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                        F.array_remove(F.split(lower, BREAK), "").alias("words"))
    known = F.transform("words", lambda w, i: F.when(w.isin(vocab), F.struct(i.alias("p"), w.alias("w"))))
    code = F.array(*[F.lit(w) for w in vocab])
    places = F.transform(F.array_compact(known), lambda x: F.struct(
        x["p"].alias("p"), F.array_position(code, x["w"]).cast("int").alias("k")))
    return words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"))


def _phrase_places(phrase: str, vocab: list[str]) -> Column:
    """Starts of a phrase: the shifted places of its words intersected."""
    out = None
    for i, w in enumerate(phrase.split()):
        k = vocab.index(w) + 1
        at = F.transform(F.filter("places", lambda x: x["k"] == k), lambda x: x["p"] - i)
        out = at if out is None else F.array_intersect(out, at)
    return out


def rarity(places: DataFrame, vocab: list[str]) -> list[tuple[int, int]]:
    """(document frequency, documents) by vocabulary number, over all rows; at most len(vocab) rows reach the driver."""
    total = places.count()
    rows = places.select(F.explode_outer(F.array_distinct(F.transform("places", lambda x: x["k"]))).alias("k")).where(
        "k is not null").groupBy("k").count().collect()
    df = {r["k"]: r["count"] for r in rows}
    return [(df.get(k, 0), total) for k in range(1, len(vocab) + 1)]


def _postings(spark, templates, vocab, idf):
    """The places of all template words; and of each template the label, votes, mass, mandatory places and anchor."""
    rows, needs = [], []
    for t, (label, text, phrases) in enumerate(templates):
        ws = text.split()
        need = set()
        for phrase in phrases:
            p = phrase.split()
            first = next(i for i in range(len(ws)) if ws[i:i + len(p)] == p)
            need |= set(range(first, first + len(p)))
        anchor = max(sorted(need), key=lambda q: idf[vocab.index(ws[q])])
        mass = sum(idf[vocab.index(w)] for w in ws)
        rows += [(t, q, vocab.index(w) + 1, float(idf[vocab.index(w)])) for q, w in enumerate(ws)]
        needs.append((t, label, min(VOTES, len(set(ws))), float(mass), sorted(need), anchor, vocab.index(ws[anchor]) + 1))
    return (spark.createDataFrame(rows, "template int, q int, k int, idf double"), spark.createDataFrame(
        needs, "template int, label string, votes int, mass double, need array<int>, anchor int, anchor_k int"))


def license_matches(places: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per reported template of a row: row, label, shift (word of the text under the template's first) and score."""
    spark, vocab = places.sparkSession, vocabulary(templates)
    idf = [math.log((n + 1) / (df + 1)) + 1e-9 for df, n in rarity(places, vocab)]
    postings, needs = _postings(spark, templates, vocab, idf)
    anchors = sorted({r["anchor_k"] for r in needs.collect()})
    postings, needs = F.broadcast(postings), F.broadcast(needs)  # the templates' own size
    at = F.filter("places", lambda x: x["k"].isin(anchors))
    voted = (places.select("row", F.explode_outer(at).alias("x")).select("row", "x.p", F.col("x.k").alias("anchor_k"))
             .join(needs, "anchor_k").select("row", "template", (F.col("p") - F.col("anchor")).alias("shift")))
    voted = written(spark, voted, "license-candidates")
    near = places.join(voted.select("row").distinct(), "row", "left_semi")
    under = (near.select("row", F.explode("places").alias("x")).select("row", "x.p", "x.k").join(postings, "k")
             .withColumn("shift", F.col("p") - F.col("q")).join(voted, ["row", "template", "shift"])
             .groupBy("row", "template", "shift").agg(F.collect_set("q").alias("qs"), F.collect_set("k").alias("ks"),
                                                      F.sum("idf").alias("got")))
    return (under.join(needs, "template").where((F.size(F.array_except("need", "qs")) == 0) & (F.size("ks") >= F.col("votes")))
            .select("row", "label", "shift", F.least(F.col("got") / F.col("mass"), F.lit(1.0)).alias("score")))


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    The score is the best template's share of matched rarity; a counted phrase makes it 1. Null and empty texts have no
    words and empty labels. Repeated rows are scanned each; other columns are ignored.
    """
    spark, vocab = docs.sparkSession, vocabulary(templates)
    places = written(spark, licence_places(docs, vocab), "license-places")
    found = license_matches(places, templates).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("score").alias("best"))
    out = places
    for i, (phrase, _) in enumerate(PHRASES):
        out = out.withColumn(f"b{i}", _phrase_places(phrase, vocab))
    starts = F.concat(*[F.col(f"b{i}") for i in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)]))
    out = out.select("row", "doc_id", "n_words", starts.alias("starts"), base.alias("base")).join(found, "row", "left")
    labels = F.sort_array(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def words_of(text: str | None) -> list[str]:
    """The word rule in Python, for tests."""
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every whole text of documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
