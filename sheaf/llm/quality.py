"""Quality rules: line sequence labelling with a linear-chain conditional random field.

Lines with a word are described by binned shares (symbols, bars, digits, capitals, short words), sizes, ends, repetition
and place. Viterbi decoding marks each as content or boilerplate; a text stays when enough of its words are in content
lines and the fixed counts (too few words, too many repeated word windows) do not fail it. Weights are fitted on a
bounded sample of ``SAMPLE_ROWS`` labelled documents (chosen by hash), whose lines take their document's label. So that the
transitions learn changes too, the sample is doubled by spliced texts: lines of one document, then lines of one of the
other label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crf import posteriors, viterbi
from .store import arrow_batches, bounded_broadcast, table, written
from .words import IS_SPACE, mix64, runs, sequence_hash, slices, span_hashes, text_bytes

#: Bound of the fitting sample, in labelled documents.
SAMPLE_ROWS = 2000
CONTENT_SHARE = 0.5
STEPS = 150
#: Lines that a spliced text takes from each of its two documents, at most.
SPLICE = 12

_U = np.uint64
CASED = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def _members(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


SYMBOL = _members("#*$%&|<>")
_BAR, _DIGIT, _STOP = _members("|"), _members("0123456789"), _members('.!?:;"')
_UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEAD = np.ones(256, dtype=bool)
_HEAD[0x80:0xC0] = False  # first bytes of code points

_SHARES = np.array([0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4])
_WORDS = np.array([2, 3, 5, 8, 13, 21, 34, 55])
_MEAN = np.array([2, 3, 4, 5, 6, 7, 8, 10])
_HALVES = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9])
FEATURES, BINS = 11, 9


def _sums(member, starts, ends):
    total = np.concatenate([[0], np.cumsum(member)])
    return total[ends] - total[starts]


def _again(key):
    """True where an equal key stands earlier."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def _seen_twice(key):
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_counts(buf, offsets):
    """Counts of every text of a slice, and its lines with a word: (counts, line features, line words, line bounds)."""
    n = len(offsets) - 1
    solid = ~IS_SPACE[buf]
    w_from, w_to = runs(solid, offsets)
    w_at = np.searchsorted(w_from, offsets)
    of_word = np.repeat(np.arange(n), np.diff(w_at))
    words = np.diff(w_at)
    chars = _sums(solid & _HEAD[buf], offsets[:-1], offsets[1:])
    symbols = _sums(SYMBOL[buf], offsets[:-1], offsets[1:])
    # windows of five words inside a text that are there twice, and the words they cover
    h = span_hashes(buf, w_from, w_to, CASED)
    grams = sequence_hash(h, 5)
    inside = of_word[:len(grams)] == of_word[4:4 + len(grams)] if len(grams) else np.zeros(0, bool)
    key = mix64(grams[inside] + of_word[:len(grams)][inside].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    twice = np.flatnonzero(inside)[_seen_twice(key)]
    covered = np.zeros(len(h), dtype=bool)
    for k in range(5):
        covered[twice + k] = True
    repeat = np.bincount(of_word[covered], minlength=n)
    # lines
    l_from, l_to = runs(buf != 10, offsets)
    own = _sums(solid, l_from, l_to) > 0
    l_from, l_to = l_from[own], l_to[own]
    l_at = np.searchsorted(l_from, offsets)
    of_line = np.repeat(np.arange(n), np.diff(l_at))
    lh = span_hashes(buf, l_from, l_to, CASED)
    again = _again(mix64(lh + of_line.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    dup = np.bincount(of_line[again], minlength=n)
    counts = np.column_stack([words, chars, symbols, dup, repeat])
    # line features
    size = np.maximum(l_to - l_from, 1)
    first = np.searchsorted(w_from, l_from)
    line_words = np.searchsorted(w_from, l_to) - first
    short = np.concatenate([[0], np.cumsum(w_to - w_from <= 3)])
    last_byte = buf[np.maximum(w_to[np.maximum(first + line_words - 1, 0)] - 1, 0)] if len(w_to) else np.zeros(0, np.uint8)
    head_byte = buf[w_from[np.minimum(first, max(len(w_from) - 1, 0))]] if len(w_from) else np.zeros(0, np.uint8)
    place = np.where(np.arange(len(l_from)) == l_at[of_line], 0, np.where(np.arange(len(l_from)) == l_at[of_line + 1] - 1, 2, 1))
    safe = np.maximum(line_words, 1)
    feats = np.column_stack([
        np.digitize(_sums(SYMBOL[buf], l_from, l_to) / size, _SHARES),
        np.digitize(_sums(_BAR[buf], l_from, l_to) / size, _SHARES),
        np.digitize(_sums(_DIGIT[buf], l_from, l_to) / size, _SHARES),
        np.digitize(_sums(_UPPER[buf], l_from, l_to) / size, _SHARES),
        np.digitize(line_words, _WORDS),
        np.digitize(_sums(solid & _HEAD[buf], l_from, l_to) / safe, _MEAN),
        np.digitize((short[first + line_words] - short[first]) / safe, _HALVES),
        _STOP[last_byte].astype(np.int64), _UPPER[head_byte].astype(np.int64), again.astype(np.int64), place,
    ]) + np.arange(FEATURES) * BINS
    return counts, feats, line_words, l_at


def _emissions(weights, feats):
    return weights[feats].sum(axis=1) if len(feats) else np.zeros((0, 2))


def spliced(texts: list[str], good: list[int], lines: int = SPLICE, seed: int = 11) -> tuple[list[str], list[list[int]]]:
    """For each text one that starts with its lines and goes on with those of a text of the other label; labels by line.

    Only lines with a word count. Either part is a run of up to ``lines`` lines from anywhere in its document.
    """
    rng = np.random.default_rng(seed)
    solid = [[x for x in t.split("\n") if x.strip("\t\n\x0b\x0c\r ")] for t in texts]
    of = {k: [i for i, g in enumerate(good) if g == k and solid[i]] for k in (0, 1)}
    out, labels = [], []
    for i, own in enumerate(solid):
        others = of[1 - good[i]]
        if not own or not others:
            continue
        j = others[int(rng.integers(len(others)))]
        part = []
        for x in (own, solid[j]):
            n = int(rng.integers(1, min(lines, len(x)) + 1))
            at = int(rng.integers(0, len(x) - n + 1))
            part.append(x[at:at + n])
        out.append("\n".join(part[0] + part[1]))
        labels.append([good[i]] * len(part[0]) + [good[j]] * len(part[1]))
    return out, labels


def fit_lines(texts: list[str], good: list[int]) -> dict:
    """Weights and transitions from texts and their labels (1: content). Without both labels every line is content."""
    model = {"weights": np.zeros((FEATURES * BINS, 2)), "step": np.zeros((2, 2)), "start": np.zeros(2)}
    if len(set(good)) < 2:
        model["start"][1] = model["weights"][:, 1] = 1.0
        return model
    mixed, by_line = spliced(texts, good)
    buf, offs = text_bytes(pa.array([*texts, *mixed], pa.large_string()))
    _, feats, _, at = text_counts(buf[offs[0]:offs[-1]], offs - offs[0])
    whole = len(texts)
    label = np.concatenate([np.repeat(np.array(good, dtype=np.int64), np.diff(at[:whole + 1])),
                            np.array([k for x in by_line for k in x], dtype=np.int64)])
    gold = np.eye(2)[label]
    inner = np.setdiff1d(np.arange(len(label) - 1), at[1:] - 1)
    hard = np.zeros((2, 2))
    np.add.at(hard, (label[inner], label[inner + 1]), 1)
    head = at[:-1][np.diff(at) > 0]
    seen = {k: np.full_like(model[k], 1e-6) for k in model}
    for _ in range(STEPS):
        soft = np.zeros((2, 2))
        post = posteriors(_emissions(model["weights"], feats), at, np.exp(model["start"]), np.exp(model["step"]), soft)
        d = gold - post
        grad = {"weights": np.column_stack([np.bincount(feats.ravel(), np.repeat(d[:, c], FEATURES), FEATURES * BINS)
                                            for c in range(2)]) - 0.1 * model["weights"],
                "step": hard - soft - 0.1 * model["step"], "start": d[head].sum(axis=0)}
        for k, g in grad.items():
            seen[k] += g ** 2
            model[k] += 0.3 * g / np.sqrt(seen[k])
    return model


def _judge(model, least):
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in slices(offs):
                counts, feats, line_words, at = text_counts(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                label = viterbi(_emissions(model["weights"], feats), at, model["start"], model["step"])
                inside = np.concatenate([[0], np.cumsum(line_words * label)])
                n = counts[:, 0]
                share = (inside[at[1:]] - inside[at[:-1]]) / np.maximum(n, 1)
                failed = (n < 10) | (100 * counts[:, 4] > 20 * n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).cast(pa.int64()),
                     *[pa.array(counts[:, k], pa.int64()) for k in range(5)], pa.array(failed),
                     pa.array(~failed & (share >= least)), pa.array(share, pa.float64())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept", "content_share"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """At most about ``rows`` (text, quality) of labelled documents, chosen by a hash of the doc_id."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    every = max(1, known.count() // rows)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = written(docs.sparkSession, known.orderBy(F.xxhash64("doc_id")).limit(rows), "quality-sample")
    near = docs.select("doc_id", "text").where("text is not null").join(bounded_broadcast(known), "doc_id")
    return near.select("text", "quality").orderBy(F.xxhash64("text"), "quality").limit(rows).collect()


def quality_rules(docs: DataFrame, model: dict, least: float = CONTENT_SHARE) -> DataFrame:
    """Per row: doc_id, counts, base_failed, kept and content_share (of words in content lines).

    Null and empty texts have no words and fail. Repeated rows are judged each; other columns are ignored.
    """
    return arrow_batches(docs).select("doc_id", "text").mapInArrow(
        _judge(model, least), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    rows = labelled_sample(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, fit_lines([r["text"] for r in rows], [int(r["quality"]) for r in rows]))
