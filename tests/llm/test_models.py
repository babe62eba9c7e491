"""Language ID, URL filters, quality rules and LM scoring: accuracy, exact counts, normalisation, odd tables."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.llm import langid, lm, quality, urls

SF = "/root/testdata/sf0.001"
LOW = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy_and_odd_texts(spark, docs):
    model = langid.train_model(docs.where(langid.fold("doc_id", 4) != 2))
    want = docs.select("doc_id", "lang", (langid.fold("doc_id", 4) == 2).alias("held"))
    got = langid.predict_language(docs, model).join(want, "doc_id").where("held").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "12 34 !?", 0.0), (4, "— … “”", 0.0), (None, "the of and", 0.0),
                                 (5, "é", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in langid.predict_language(odd, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3, 4))
    assert got[None].lang_pred == "en" and got[5].lang_pred in model["labels"] and 0 < got[5].score <= 1
    kept = langid.keep_identified(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == 2


def test_language_switches_inside_a_text(spark, docs):
    model = langid.train_model(docs)
    halves = docs.where("lang in ('en', 'de')").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()
    both = "\n".join(r.text[:400] for r in halves)
    r = langid.predict_language(spark.createDataFrame([(1, both)], "doc_id long, text string"), model).first()
    assert r.lang_pred in ("en", "de") and r.score < 0.8


def test_language_without_labels(spark):
    none = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert langid.predict_language(none, langid.train_model(none)).first().lang_pred == "und"
    assert langid.predict_language(none.limit(0), langid.train_model(none.limit(0))).count() == 0


def test_url_rules(spark):
    rows = [(1, None), (2, ""), (3, "http://X.Example.com/en/a?x#y"), (4, "https://www.example.com/en/z"), (5, "http://a.com"),
            (6, "a://b://c.net/fr/?"), (7, "HTTP://EXAMPLE.NET:80/es/q"), (8, "http://q.net/es/#"), (9, "http://com/"), (10, "x.com/"),
            (11, "http://notcom/"), (12, "http://ÀB.com/\n?q")]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.decided) for r in urls.with_rule(df.drop("host")).collect()}

    def want(url):
        if not url or "://" not in url:
            return "", "", None, None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOW)
        fit = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best and best[2]

    assert got == {i: want(u) for i, u in rows}
    out = urls.filter_urls(df)
    assert {r.page_id: r.verdict for r in out.collect()}[1] == "block"
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_url_models_are_distributions_and_separate(spark):
    known = [(f"http://good.org/{k}/news", True) for k in range(80)] + [(f"http://spam.biz/{k}?win", False) for k in range(80)]
    model = urls.fit_models(spark.createDataFrame(known, "url string, allowed boolean"))
    assert urls.mean_ratio(model, "http://good.org/999/news") > 0 > urls.mean_ratio(model, "http://spam.biz/999?win")
    counts = collections.Counter()
    for url, ok in known:
        t = urls.BEGIN + url + urls.END
        if ok:
            counts.update(t[i:i + n] for n in range(1, 8) for i in range(len(t) - n + 1))
    assert all(model["grams"][g][0] == counts[g] for g in model["grams"])


def line_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_and_verdicts(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.labelled_sample(docs, labels)
    model = quality.fit_lines([r["text"] for r in rows], [int(r["quality"]) for r in rows])
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\n \n"), (-4, "a b c d e a b c d e\nx\nx\n é# \n"), (-5, "w " * 30),
                                 (None, "y")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    text = {r.doc_id: r.text for r in every.collect()}
    got = {r.doc_id: r for r in quality.quality_rules(every, model).collect()}
    for i, r in got.items():
        n, chars, symbols, dup, repeat = line_counts(text[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.kept and r.base_failed)
    assert quality.quality_rules(docs.limit(0), model).count() == 0
    assert quality.quality_rules(docs, quality.fit_lines([], [])).where("not base_failed and not kept").count() == 0


def test_quality_of_held_out_and_spliced_texts(spark):
    """Fitted without every third labelled document; judged on those, and on texts spliced from two of them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    rows = quality.labelled_sample(docs, labels.where(~out))
    model = quality.fit_lines([r["text"] for r in rows], [int(r["quality"]) for r in rows])
    held = docs.join(labels.where(out), "doc_id").where("text is not null").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    text = {r.doc_id: r.text for r in held}
    judged = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame([(r.doc_id, r.text) for r in held],
                                                                             "doc_id long, text string"), model).collect()}
    clean = [judged[r.doc_id].kept for r in held if r.quality == 1 and not judged[r.doc_id].base_failed]
    junk = [judged[r.doc_id].kept for r in held if r.quality == 0]
    assert len(clean) > 30 and len(junk) > 10 and np.mean(clean) > 0.97 and np.mean(junk) < 0.1
    good, bad = ([r.doc_id for r in held if r.quality == q] for q in (1, 0))
    rng, both, want = np.random.default_rng(3), [], {}
    for k in range(60):  # content then boilerplate, or the other way round
        a, b = text[good[int(rng.integers(len(good)))]], text[bad[int(rng.integers(len(bad)))]]
        both.append((k, a + "\n" + b if k % 2 else b + "\n" + a))
        want[k] = len(a.split()) / len(both[-1][1].split())
    got = {r.doc_id: r.content_share for r in quality.quality_rules(spark.createDataFrame(both, "doc_id long, text string"), model).collect()}
    wrong = [abs(got[k] - want[k]) for k in want]
    assert np.mean(wrong) < 0.03, np.mean(wrong)


def test_spliced_texts_have_a_label_for_every_line():
    texts, good = ["a b\n\nc d\ne", " \n", "x\n\x0b\ny z", "only"], [1, 1, 0, 0]
    mixed, labels = quality.spliced(texts, good, lines=2)
    assert len(mixed) == 3 and all(len(t.split("\n")) == len(x) and set(x) == {0, 1} for t, x in zip(mixed, labels))
    assert quality.spliced(["a"], [1]) == ([], [])


def test_lm_base_scores_and_held_out_gain(spark, docs):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-3, " \n"), (-4, "The THE the")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    held = langid.fold("doc_id", 7) == 2
    tok = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW)) + [None]) for r in every.collect()]
    is_held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter()
    for i, t in tok:
        if not is_held(i):
            c.update(t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, is_held(i), len(t), sum(c[w] > 0 for w in t), n,
                                round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for i, t in tok)
    got = lm.score_texts(spark, every, held).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score_texts(spark, docs.limit(0), held).count() == 0
    nothing = lm.score_texts(spark, odd, F.lit(True)).collect()
    assert len(nothing) == 5 and all(r.train_tokens == 0 and np.isfinite(r.score) for r in nothing)


def test_lm_keeps_large_ids_beside_a_null_id(spark):
    df = spark.createDataFrame([(2 ** 60 + 1, "a b a"), (None, "a b"), (-7, None)], "doc_id long, text string")
    got = lm.score_texts(spark, df, F.lit(False)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted([(2 ** 60 + 1, 4), (None, 3), (-7, 1)], key=str)


def test_lm_scores_follow_every_word_ngram(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{k}" for k in range(3000)]
    lines = [" ".join(vocab[k] for k in rng.integers(0, 3000, 12)) for _ in range(300)]
    texts = [" ".join(lines[k] for k in rng.integers(0, 300, 3)) for _ in range(200)] + ["never seen w1 w2", "", None]
    held = [k % 5 == 0 for k in range(len(texts))]
    two, three, one = collections.Counter(), collections.Counter(), collections.Counter()
    seqs = [["<b>", *(t or "").split(), None] for t in texts]
    for y in (y for y, h in zip(seqs, held) if not h):
        one.update(y[1:])
        two.update(zip(y, y[1:]))
        three.update(zip(y, y[1:], y[2:]))
    after = [collections.defaultdict(list), collections.defaultdict(list)]
    for table, to in ((two, after[0]), (three, after[1])):
        for g, c in table.items():
            to[g[:-1]].append(c)
    n = sum(one.values()) + len(one) + 1

    def chance(g):
        if len(g) == 1:
            return (one[g[0]] + 1) / n
        seen = after[len(g) - 2].get(g[:-1])
        lower = chance(g[1:])
        return ((two, three)[len(g) - 2][g] + len(seen) * lower) / (sum(seen) + len(seen)) if seen else lower

    want = {k: sum(math.log10(chance(tuple(y[max(0, i - 2):i + 1]))) for i in range(1, len(y))) for k, y in enumerate(seqs)}
    df = spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, h boolean")
    got = {r.doc_id: r for r in lm.score_texts(spark, df, F.col("h")).collect()}
    assert {k: r.score for k, r in got.items()} == pytest.approx(want)
    seen = [r for k, r in got.items() if held[k] and texts[k]]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen) / 2  # lines of rare words are learned


def test_lm_stores_words_only_and_pieces_do_not_change_scores(spark, monkeypatch):
    """Only word counts are stored, no n-grams or blocks; pieces of a frequent word and words without a number score alike."""
    rng = np.random.default_rng(3)
    texts = [" ".join("the" if k % 3 == 0 else f"w{int(k ** 1.5)}" for k in rng.integers(0, 60, rng.integers(0, 40))) for _ in range(150)]
    texts += ["the the the the", "the", "", None, "only here the only here"]
    df = spark.createDataFrame([(k, t, k % 6 == 0) for k, t in enumerate(texts)], "doc_id long, text string, h boolean")
    stored = []
    monkeypatch.setattr(lm, "written", lambda *a, _write=lm.written: stored.append(_write(*a)) or stored[-1])
    want = {r.doc_id: tuple(r)[1:] for r in lm.score_texts(spark, df, F.col("h")).collect()}
    kinds = len({w for k, t in enumerate(texts) if k % 6 for w in (t or "").split()})
    assert sum(x.count() for x in stored) == kinds + 3  # the end, the numbers of texts and of tokens
    for bounds in ((2000, 400, 20), (500, 40, 3), (300, 30, 0)):
        got = {r.doc_id: tuple(r)[1:] for r in lm.score_texts(spark, df, F.col("h"), *bounds).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def automaton(seed=0, size=5, length=400):
    """An automaton over symbols 0..size-1 (the last one RARE) from one random sequence, and its kept n-grams."""
    rng = np.random.default_rng(seed)
    seqs = [rng.integers(0, size, rng.integers(1, 30)) for _ in range(length)]
    s = size + 1
    uni = np.bincount(np.concatenate(seqs), minlength=size).astype(float)
    two, three = collections.Counter(), collections.Counter()
    for x in seqs:
        y = [size, *x]
        two.update(a * s + b for a, b in zip(y, y[1:]))
        three.update((a * s + b) * s + c for a, b, c in zip(y, y[1:], y[2:]))
    totals = collections.Counter()
    for k, n in two.items():
        totals[k // s] += n
    for k, n in three.items():
        totals[k // s + s] += n
    keep = lambda c, least: tuple(np.array(z) for z in zip(*sorted((k, float(n)) for k, n in c.items() if n >= least)))
    return lm.Automaton(uni, keep(two, 40), keep(three, 25), totals), size


def test_automaton_is_a_distribution_and_segments_agree():
    a, size = automaton()
    for state in range(len(a.fail)):
        w, _ = a.step(np.full(size, state), np.arange(size))
        assert np.sum(10 ** w) == pytest.approx(1.0)
    rng = np.random.default_rng(9)
    x = rng.integers(0, size, 3000)
    at = np.array([0, 1, 700, 3000])
    want = []
    for lo, hi in zip(at[:-1], at[1:]):
        state, total = np.array([a.begin]), 0.0
        for sym in x[lo:hi]:
            w, state = a.step(state, np.array([sym]))
            total += w[0]
        want.append(total)
    assert np.allclose(a.score(x, at), want)


def test_automaton_follows_the_longest_context():
    a, size = automaton(1)
    s = size + 1
    contexts = list(a.contexts)
    for seq in itertools.product(range(size), repeat=4):
        state = np.array([0])
        for sym in seq:
            _, state = a.step(state, np.array([sym]))
        two, one = seq[-2] * s + seq[-1] + s, seq[-1]
        want = 1 + contexts.index(two) if two in contexts else 1 + contexts.index(one) if one in contexts else 0
        assert state[0] == want


def test_sampled_rows_are_bounded(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert len(quality.labelled_sample(docs, labels, 20)) <= 20
    assert isinstance(pd.DataFrame(quality.labelled_sample(docs, labels, 20)), pd.DataFrame)
