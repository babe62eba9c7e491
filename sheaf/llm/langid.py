"""Language ID by a linear-chain conditional random field over words.

Words are runs of letters (A-Z, a-z and bytes from 0x80). A word's emission sums learned weights of its byte n-grams
(two to four, with word bounds), its affixes (two, three and five bytes) and a lexicon feature (how a word's corpus
count is spread over the languages). Transitions between the languages of neighbouring words are learned too, on
sequences spliced from texts of two languages, so a text that switches languages is labelled word by word. Posterior
label shares come from forward-backward; a text's language is the one with the largest share of its words.

The lexicon counts every word of every labelled text, in ``2^LEXICON_BITS`` hash buckets: words may share a bucket, but none
is left out, and the table has one size for every corpus. A bucket of few words says little, so its spread is drawn towards
none by ``LEXICON_PRIOR`` words. Weights are fitted on a bounded sample: about ``SAMPLE_ROWS``
labelled rows of each language, chosen by a hash of the row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .crf import posteriors
from .store import arrow_batches, table
from .words import mix64, runs, slices, span_hashes, text_bytes

#: Bound of the fitting sample, in labelled rows for each language.
SAMPLE_ROWS = 200
LEXICON_BITS, LEXICON_PRIOR = 18, 20
BUCKETS = 1 << 16
WINDOW = 32
EPOCHS = 3
#: Text bytes of one step of the recursion: a step's arrays take about 25 bytes a text byte.
BATCH_BYTES = 2_000_000
#: Text bytes of the fitting sample whose features are built at a time, on the driver.
FIT_BYTES = 250_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _spaced(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a space before, between and after them; text i is [at[i], at[i + 1] - 1)."""
    data, offs = text_bytes(column)
    n = len(offs) - 1
    out = np.full(int(offs[-1] - offs[0]) + n + 1, 32, dtype=np.uint8)
    length = np.diff(offs)
    spot = np.arange(int(offs[-1] - offs[0])) + np.repeat(np.arange(n), length) + 1
    out[spot] = data[offs[0]:offs[-1]]
    return out, offs - offs[0] + np.arange(n + 1) + 1


def _byte_codes(buf):
    """Codes of the n bytes from every place on, by n."""
    x = np.where(_LETTER[buf], _LOWER[buf], np.uint64(32))
    code, codes = x, {1: x}
    for n in (2, 3, 4, 5):
        code = code[:-1] * np.uint64(257) + x[n - 1:]
        codes[n] = code
    return codes


def _grams(codes, starts, ends):
    """Feature buckets of byte n-grams: (bucket array, first index, end index) per n; a word's features are [first, end)."""
    mask = np.uint64(BUCKETS - 1)
    for n in (2, 3, 4):
        b = (mix64(codes[n] + np.uint64(n << 48)) & mask).astype(np.uint16)
        yield b, starts - 1, np.maximum(starts - 1, ends - n + 2)


def _affixes(codes, starts, ends):
    """Feature buckets of affixes: (buckets, words that have them) per kind, one a word."""
    mask = np.uint64(BUCKETS - 1)
    for n in (2, 3, 5):
        has = np.flatnonzero(ends - starts >= n)
        for where, salt in ((starts[has], 8), (ends[has] - n, 16)):
            yield (mix64(codes[n][where] + np.uint64((n + salt) << 48)) & mask).astype(np.uint16), has


def _features(buf, starts, ends):
    """Feature buckets of words: (bucket array, first index, end index) per kind; a word's features are [first, end)."""
    codes = _byte_codes(buf)
    out = list(_grams(codes, starts, ends))
    for b, has in _affixes(codes, starts, ends):
        first = np.zeros(len(starts), dtype=np.int64)
        first[has] = np.arange(len(has))
        end = first.copy()
        end[has] += 1
        out.append((b, first, end))
    return out


def _range_sums(values, first, end):
    """Sum of values[first:end] per row (rows x labels)."""
    out = np.zeros((len(first), values.shape[1]), dtype=np.float32)
    some = np.flatnonzero(end > first)
    if len(some):
        padded = np.concatenate([values, np.zeros((1, values.shape[1]), values.dtype)])
        edges = np.column_stack([first[some], end[some]]).ravel()
        out[some] = np.add.reduceat(padded, edges, axis=0)[::2]
    return out


def _buckets(hashes):
    return (hashes >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)


def _lexicon_rows(model, hashes):
    return model["shares"][_buckets(hashes)]


def _emissions(model, buf, starts, ends):
    total = np.zeros((len(starts), len(model["labels"])), dtype=np.float32)
    count = np.zeros(len(starts), dtype=np.float32)
    codes = _byte_codes(buf)
    for b, first, end in _grams(codes, starts, ends):
        total += _range_sums(model["weights"].take(b, axis=0), first, end)
        count += end - first
    for b, has in _affixes(codes, starts, ends):  # at most one a word: nothing to sum
        total[has] += model["weights"].take(b, axis=0)
        count[has] += 1
    hashes = span_hashes(buf, starts, ends)
    return total / np.sqrt(np.maximum(count, 1))[:, None] + _lexicon_rows(model, hashes) @ model["mixing"]


def _text_sizes(column):
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])


def _gathered(batches, limit=BATCH_BYTES):
    """Batches joined up to about ``limit`` text bytes: one step of the recursion then serves many texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(_text_sizes(batch.column("text"))[-1])
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _predictor(model):
    def run(batches):
        labels = np.array([*model["labels"], "und"], dtype=object)
        for batch in _gathered(batches):
            texts = batch.column("text")
            if not model["labels"]:
                yield batch, pa.array(["und"] * len(batch), pa.string()), pa.array(np.zeros(len(batch)))
                continue
            for i, j in slices(_text_sizes(texts), BATCH_BYTES):
                part = texts.slice(i, j - i)
                buf, at = _spaced(part)
                starts, ends = runs(_LETTER[buf], np.zeros(1, np.int64))
                bounds = np.searchsorted(starts, at)
                emission = np.concatenate([np.zeros((0, len(labels) - 1), np.float32)] + [
                    _emissions(model, buf[lo:hi], starts[a:b] - lo, ends[a:b] - lo)
                    for a, b, lo, hi in _word_slices(starts, ends)])
                post = posteriors(emission, bounds, model["start"], model["step"])
                words = np.diff(bounds)
                share = np.zeros((j - i, len(labels) - 1))
                some = np.flatnonzero(words)
                if len(some):
                    share[some] = np.add.reduceat(post, bounds[:-1][some], axis=0) / words[some][:, None]
                best, score = share.argmax(axis=1), np.minimum(share.max(axis=1), 1.0)
                none = words == 0
                plain = np.concatenate([[0], np.cumsum(_LETTER[buf] & (buf < 128))])
                for k in np.flatnonzero(~none & (plain[at[1:]] == plain[at[:-1]])):  # no ASCII letter: any other letter?
                    none[k] = not any(c.isalpha() for c in part[int(k)].as_py())
                best = np.where(none, len(labels) - 1, best)
                yield batch.slice(i, j - i), pa.array(labels[best], pa.string()), pa.array(np.where(none, 0.0, score), pa.float64())
    return run


def _word_slices(starts, ends, limit=1_000_000):
    """Groups of words that lie within about ``limit`` bytes, with two spare bytes at each side."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + limit, "right")))
        yield a, b, int(starts[a]) - 1, int(ends[b - 1]) + 4
        a = b


def _digest(predict):
    def run(batches):
        for batch, lang, score in predict(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lang, score],
                                             names=["doc_id", "lang_pred", "score"])
    return run


def _keeper(predict, least):
    def run(batches):
        for batch, lang, score in predict(batches):
            keep = pc.and_(pc.not_equal(lang, "und"), pc.greater_equal(score, least))
            yield batch.filter(keep)
    return run


def _counter(labels):
    def run(batches):
        code = {x: i for i, x in enumerate(labels)}
        for batch in _gathered(batches):
            lang = np.array([code[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            texts = batch.column("text")
            for i, j in slices(_text_sizes(texts), BATCH_BYTES):
                buf, at = _spaced(texts.slice(i, j - i))
                starts, ends = runs(_LETTER[buf], np.zeros(1, np.int64))
                hashes = np.concatenate([np.zeros(0, np.uint64)] + [
                    span_hashes(buf[lo:hi], starts[a:b] - lo, ends[a:b] - lo) for a, b, lo, hi in _word_slices(starts, ends)])
                of = np.repeat(lang[i:j], np.diff(np.searchsorted(starts, at)))
                size = 1 << LEXICON_BITS
                at, n = np.unique(of * size + _buckets(hashes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)),
                                                  pa.array(n, pa.int64())], names=["label", "bucket", "n"])
    return run


def _lexicon(train: DataFrame, labels: list[str]):
    """(buckets x labels): how the corpus counts of each bucket's words are spread over the languages, less the even spread."""
    counts = arrow_batches(train).select("lang", "text").mapInArrow(_counter(labels), "label int, bucket int, n long")
    rows = counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most labels x 2^LEXICON_BITS rows
    total = np.zeros((1 << LEXICON_BITS, len(labels)))
    total[rows.column("bucket").to_numpy(), rows.column("label").to_numpy()] = rows.column("n").to_numpy()
    rate = total / np.maximum(total.sum(axis=0), 1)
    share = rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-300)
    words = total.sum(axis=1, keepdims=True)
    return ((share - 1 / len(labels)) * words / (words + LEXICON_PRIOR)).astype(np.float32)


def _fit(model, texts: list[str], langs: list[int]):
    """Adagrad on the conditional log-likelihood of pure and spliced word windows."""
    k = len(model["labels"])
    if not texts:
        return
    flat, per_word, lexicon, words = [], [], [], []
    column = pa.array(texts, pa.large_string())
    for i, j in slices(_text_sizes(column), FIT_BYTES):  # the sample's features, a few texts at a time
        buf, at = _spaced(column.slice(i, j - i))
        starts, ends = runs(_LETTER[buf], np.zeros(1, np.int64))
        words.append(np.diff(np.searchsorted(starts, at)))
        lexicon.append(_lexicon_rows(model, span_hashes(buf, starts, ends)))
        kinds = _features(buf, starts, ends) if len(starts) else []
        per_word.append(sum((np.maximum(end - first, 0) for _, first, end in kinds), np.zeros(len(starts), np.int64)))
        filled = np.concatenate([[0], np.cumsum(per_word[-1])])
        part, filled = np.empty(filled[-1], dtype=np.uint16), filled[:-1]
        while kinds:  # each kind's features go to their words' places; no list of (feature, word) pairs is held
            b, first, end = kinds.pop()
            n = np.maximum(end - first, 0)
            before, step_in = np.concatenate([[0], np.cumsum(n)[:-1]]), np.arange(n.sum())
            part[np.repeat(filled - before, n) + step_in] = b[np.repeat(first - before, n) + step_in]
            filled = filled + n
        flat.append(part)
    flat, lexicon = np.concatenate(flat), np.concatenate(lexicon)
    words = np.concatenate(words)
    bounds = np.concatenate([[0], np.cumsum(words)])
    label = np.repeat(np.array(langs, dtype=np.int64), words)
    word_at = np.concatenate([[0], np.cumsum(np.concatenate(per_word))])
    scale = 1 / np.sqrt(np.maximum(np.diff(word_at), 1))
    rng = np.random.default_rng(7)
    windows = [np.arange(a, min(a + WINDOW, hi)) for lo, hi in zip(bounds[:-1], bounds[1:]) for a in range(lo, hi, WINDOW)]
    g_w, g_m, g_t = np.full_like(model["weights"], 1e-6), np.full((k, k), 1e-6), np.full((k, k), 1e-6)
    trans = np.zeros((k, k))
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 64):
            seqs = []
            group = order[lo:lo + 64]
            for q, r in zip(group, np.roll(group, 1)):
                w = windows[q]
                if q % 2:  # splice: the head of this window, then the tail of another one
                    cut = int(rng.integers(0, len(w) + 1))
                    w = np.concatenate([w[:cut], windows[r][cut:]])
                if len(w):
                    seqs.append(w)
            words = np.concatenate(seqs)
            pos = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
            n = word_at[words + 1] - word_at[words]
            spot = np.repeat(word_at[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            f, who = flat[spot], np.repeat(np.arange(len(words)), n)
            e = np.zeros((len(words), k))
            for c in range(k):
                e[:, c] = np.bincount(who, model["weights"][f, c], len(words)) * scale[words]
            e += lexicon[words] @ model["mixing"]
            soft = np.zeros((k, k))
            post = posteriors(e, pos, np.full(k, 1 / k), np.exp(trans), soft)
            gold = np.zeros_like(post)
            gold[np.arange(len(words)), label[words]] = 1
            d = gold - post
            inner = np.setdiff1d(np.arange(len(words) - 1), pos[1:] - 1)
            hard = np.zeros((k, k))
            np.add.at(hard, (label[words][inner], label[words][inner + 1]), 1)
            d_t = hard - soft
            grad = np.zeros_like(model["weights"])
            for c in range(k):
                grad[:, c] = np.bincount(f, (d[:, c] * scale[words])[who], BUCKETS)
            grad -= 1e-3 * model["weights"] * (grad != 0)
            d_m = lexicon[words].T @ d
            g_w += grad ** 2
            g_m += d_m ** 2
            g_t += d_t ** 2
            model["weights"] += (0.3 * grad / np.sqrt(g_w)).astype(np.float32)
            model["mixing"] += (0.3 * d_m / np.sqrt(g_m)).astype(np.float32)
            trans += 0.1 * d_t / np.sqrt(g_t)
    model["step"] = np.exp(trans - trans.max()).astype(np.float32)


def train_model(train: DataFrame) -> dict:
    """Fit on rows of (doc_id, text, lang): every row feeds the lexicon, a bounded sample the weights.

    Rows with a null text or lang are ignored. Without any labelled row the model has no label (all texts are `und`).
    """
    train = train.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    labels = sorted(sizes)
    k = len(labels)
    model = {"labels": labels, "weights": np.zeros((BUCKETS, k), np.float32), "mixing": np.eye(k, dtype=np.float32),
             "start": np.full(k, 1 / max(k, 1), np.float32), "step": np.eye(k, dtype=np.float32),
             "shares": np.zeros((1 << LEXICON_BITS, k), np.float32)}
    if not labels:
        return model
    model["shares"] = _lexicon(train, labels)
    every = F.lit(1)
    for x in labels:
        every = F.when(F.col("lang") == x, max(1, sizes[x] // SAMPLE_ROWS)).otherwise(every)
    picked = train.withColumn("h", F.xxhash64("text", "doc_id")).where(F.pmod("h", every) == 0)
    best = Window.partitionBy("lang").orderBy("h", "doc_id")
    rows = picked.withColumn("r", F.row_number().over(best)).where(F.col("r") <= SAMPLE_ROWS).orderBy("lang", "r").collect()
    code = {x: i for i, x in enumerate(labels)}
    _fit(model, [r["text"] for r in rows], [code[r["lang"]] for r in rows])
    return model


def predict_language(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, lang_pred (`und` when the text is null or has no letter) and score, the language's share of the words."""
    return arrow_batches(docs).select("doc_id", "text").mapInArrow(_digest(_predictor(model)), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """Rows whose language is found with a share of at least ``least`` of the words; all columns stay."""
    return arrow_batches(docs).mapInArrow(_keeper(_predictor(model), least), docs.schema)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id: 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; texts of the held-out fold are never learned from."""
    docs = table(spark, sf_dir, "documents")
    model = train_model(docs.where(fold("doc_id", 4) != 2))
    out = predict_language(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
