"""URL filters: host and path rules, and a character language-model ratio for the URLs no rule decides.

URLs that a rule allows or blocks train two variable-order Markov models over characters: a character's probability
mixes its counts behind the longest known context with those of ever shorter contexts. Contexts are known when they make
up ``SHARE`` of their class's characters, so a model has at most ORDER / SHARE of them however many URLs there are. The
score is the mean log-likelihood difference a character; a logistic curve fitted on rule-decided URLs that the
models have not seen (all of them, as a histogram with equal weight for both classes) turns it into a probability.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import arrow_batches, table, written

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER = 6
SHARE = 2e-5
BACKOFF = 4.0
ALPHABET = 256
BINS = 2000
SPAN = 10.0
BEGIN, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.concat(url, F.lit("")), "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), F.translate(
        F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule (the longest that fits; null: none) and decided (its verdict)."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("decided", verdict)


def _grams(order: int):
    def run(batches):
        for batch in batches:
            counts = {True: Counter(), False: Counter()}
            for url, allowed in zip(batch.column("url").to_pylist(), batch.column("allowed").to_pylist()):
                text = BEGIN + url + END
                for n in range(1, order + 2):
                    counts[allowed].update(text[i:i + n] for i in range(len(text) - n + 1))
            for allowed, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([allowed] * len(c), pa.bool_()),
                                                  pa.array(list(c.values()), pa.int64())], names=["gram", "allowed", "n"])
    return run


def fit_models(urls: DataFrame, order: int = ORDER, share: float = SHARE) -> dict:
    """Counts of both models from rows (url, allowed); every row counts. Null urls are ignored."""
    urls = urls.select("url", "allowed").where("url is not null and allowed is not null")
    counts = arrow_batches(urls).mapInArrow(_grams(order), "gram string, allowed boolean, n long").groupBy("gram").agg(
        F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("allowed"), 0).otherwise(F.col("n"))).alias("b"))
    counts = written(urls.sparkSession, counts, "url-grams")
    total = counts.where((F.length("gram") == 1) & (F.col("gram") != BEGIN)).agg(
        F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    often = (F.col("a") >= F.lit(max(total[0] * share, 1))) | (F.col("b") >= F.lit(max(total[1] * share, 1)))
    rows = counts.where(often | (F.length("gram") == 1)).collect()  # at most 2 (ORDER + 1) / SHARE and the characters
    return {"grams": {r["gram"]: (r["a"], r["b"]) for r in rows}, "total": (int(total[0]), int(total[1])),
            "order": order}


def mean_ratio(model: dict, url: str) -> float:
    """Mean over the URL's characters (and its end) of log P(allowed model) - log P(blocked model)."""
    grams, (ta, tb), order = model["grams"], model["total"], model["order"]
    text, none = BEGIN + url + END, (0, 0)
    out = 0.0
    for i in range(1, len(text)):
        ca, cb = grams.get(text[i], none)
        pa_, pb_ = (ca + BACKOFF / ALPHABET) / (ta + BACKOFF), (cb + BACKOFF / ALPHABET) / (tb + BACKOFF)
        for n in range(1, min(order, i) + 1):
            context = grams.get(text[i - n:i])
            if context is None:  # a longer context is unknown too
                break
            ga, gb = grams.get(text[i - n:i + 1], none)
            pa_ = (ga + BACKOFF * pa_) / (context[0] + BACKOFF)
            pb_ = (gb + BACKOFF * pb_) / (context[1] + BACKOFF)
        out += math.log(pa_) - math.log(pb_)
    return out / (len(text) - 1)


def _scorer(model: dict, names: list[str]):
    def run(batches):
        for batch in batches:
            score = [None if u is None else mean_ratio(model, u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score, pa.float64())],
                                             names=[*names, "ratio"])
    return run


def score_urls(pages: DataFrame, model: dict) -> DataFrame:
    """Adds ``ratio`` (null for a null url)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return arrow_batches(pages).mapInArrow(_scorer(model, pages.columns), schema + ", ratio double")


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """Slope and shift of the logistic curve for rows (ratio, allowed): Newton steps on a histogram, classes weighted alike."""
    at = F.round((F.least(F.greatest("ratio", F.lit(-SPAN)), F.lit(SPAN)) + SPAN) * (BINS / (2 * SPAN))).cast("int")
    rows = scored.where("ratio is not null").groupBy("allowed", at.alias("bin")).count().collect()
    if len({r["allowed"] for r in rows}) < 2:
        return 1.0, 0.0
    size = {k: sum(r["count"] for r in rows if r["allowed"] == k) for k in (True, False)}
    x = np.array([r["bin"] * (2 * SPAN / BINS) - SPAN for r in rows])
    y = np.array([float(r["allowed"]) for r in rows])
    w = np.array([r["count"] / size[r["allowed"]] for r in rows])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = np.array([(w * (y - p) * x).sum() - 1e-3 * a, (w * (y - p)).sum() - 1e-3 * b])
        v = w * p * (1 - p)
        hess = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
    return a, b


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict and score (probability of allow from the models).

    Null urls have an empty host and path, no rule and no score, and are blocked. Without rule-decided URLs of both kinds
    the models know nothing and undecided URLs are allowed. Repeated rows are judged each; other columns are ignored.
    """
    judged = with_rule(pages.select("page_id", "url"), rules)
    known = judged.where("decided is not null").select("url", (F.col("decided") == "allow").alias("allowed"))
    unseen = F.crc32(F.col("url").cast("binary")) % 5 == 0  # equal URLs fall on one side
    model = fit_models(known.where(~unseen))
    a, b = calibrate(score_urls(known.where(unseen), model))
    out = score_urls(judged, model).withColumn("score", 1 / (1 + F.exp(-(F.lit(a) * F.col("ratio") + F.lit(b)))))
    own = F.when(F.col("score") >= 0.5, "allow").otherwise("block") if min(model["total"]) else F.when(
        F.col("url").isNotNull(), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", own).alias("verdict"), "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every pages url."""
    return filter_urls(table(spark, sf_dir, "pages"))
