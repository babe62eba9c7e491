"""Byte-level words, hashes, the chain model's inference and token ids against plain Python."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sheaf.llm import crf, tokens, words


def test_words_equal_the_regular_expression():
    texts = ["Hello  hello\x0bWORLD\n", None, "", " \t ", "a\x1cb\u00a0c é", "x" * 1000]
    buf, offs = words.text_bytes(pa.array(texts))
    h, at = words.words(buf[offs[0]:offs[-1]], offs - offs[0])
    ids = {}
    for i, t in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        got = h[at[i]:at[i + 1]].tolist()
        assert len(got) == len(want)
        for w, x in zip(want, got):
            assert ids.setdefault(w, x) == x
    assert len(set(ids.values())) == len(ids)


def test_slices_cover_everything_whole():
    offs = np.array([0, 5, 5, 30, 31, 90])
    parts = list(words.slices(offs, 10))
    assert parts[0][0] == 0 and parts[-1][1] == 5
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_forward_backward_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths, k = [3, 0, 1, 4], 3
    at = np.concatenate([[0], np.cumsum(lengths)])
    e, start, step = rng.normal(size=(at[-1], k)), rng.random(k) + 0.1, rng.random((k, k)) + 0.1
    pairs = np.zeros((k, k))
    got = crf.posteriors(e.copy(), at, start, step, pairs)
    best = crf.viterbi(e.copy(), at, np.log(start), np.log(step))
    want_pairs = np.zeros((k, k))
    for a, b in zip(at[:-1], at[1:]):
        if a == b:
            continue
        ways = {}
        for path in itertools.product(range(k), repeat=b - a):
            s = start[path[0]] * np.prod([step[x, y] for x, y in zip(path, path[1:])])
            ways[path] = s * np.exp(sum(e[a + i, y] for i, y in enumerate(path)))
        z = sum(ways.values())
        for i in range(b - a):
            marginal = [sum(v for p, v in ways.items() if p[i] == y) / z for y in range(k)]
            assert np.allclose(got[a + i], marginal)
        for p, v in ways.items():
            for x, y in zip(p, p[1:]):
                want_pairs[x, y] += v / z
        assert tuple(best[a:b]) == max(ways, key=ways.get)
    assert np.allclose(pairs, want_pairs)


def test_token_ids_are_the_tokenizers_own():
    public = pytest.importorskip("public_tokenizers")
    counter = tokens.TokenCounter(public.path("word_bpe_49k.json"))
    rng = random.Random(5)
    bits = [*"abcXYZ'0123.,!?\n\t é²ª–“İ漢", "'s", "'re", "'LL", " the ", "<|endoftext|>", "\u0301"]
    texts = ["", "I'm WE'LL they've ''s .'s a'sb 1's's"] + [
        "".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(800)]
    for text, ids in zip(texts, counter.encode(texts)):
        assert ids.tolist() == counter.tokenizer.encode(text, add_special_tokens=False).ids


def test_affixes_are_added_without_a_sum_and_emissions_stay(monkeypatch):
    from sheaf.llm import langid

    rng = np.random.default_rng(4)
    model = {"labels": ["a", "b", "c"], "weights": rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32),
             "mixing": np.eye(3, dtype=np.float32), "shares": rng.normal(size=(1 << langid.LEXICON_BITS, 3)).astype(np.float32)}
    buf, _ = langid._spaced(pa.array(["a Grande of the casas e x", None, "niñas abcde Z"]))
    starts, ends = langid.runs(langid._LETTER[buf], np.zeros(1, np.int64))
    kinds = langid._features(buf, starts, ends)
    sums = sum(langid._range_sums(model["weights"][b], first, end) for b, first, end in kinds)
    count = sum(end - first for _, first, end in kinds)
    want = sums / np.sqrt(np.maximum(count, 1))[:, None] + langid._lexicon_rows(model, langid.span_hashes(buf, starts, ends))
    calls, plain = [], langid._range_sums
    monkeypatch.setattr(langid, "_range_sums", lambda *a: calls.append(1) or plain(*a))
    assert np.allclose(langid._emissions(model, buf, starts, ends), want, atol=1e-5)
    assert len(calls) == 3  # the byte n-grams of two to four


@pytest.mark.parametrize("labels", [1, 4, 9])
def test_posteriors_of_many_lengths_equal_one_sequence_at_a_time(labels):
    rng = np.random.default_rng(labels)
    at = np.concatenate([[0], np.cumsum([3, 0, 40, 1, 7, 0])])
    e, start = rng.normal(size=(at[-1], labels)), rng.random(labels) + 0.1
    step = rng.random((labels, labels)) + 0.1
    got = crf.posteriors(e, at, start, step)
    for a, b in zip(at[:-1], at[1:]):
        assert np.allclose(got[a:b], crf.posteriors(e[a:b], np.array([0, b - a]), start, step))
    assert np.allclose(got.sum(axis=1), 1)
