"""Secrets, licences, decontamination and chat formatting against plain Python."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sheaf.llm import chat, decontam, licenses, secrets

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def entropy(s, w=secrets.WINDOW):
    bits = lambda z: -sum(v / len(z) * math.log2(v / len(z)) for v in collections.Counter(z).values())
    return max(bits(s[i:i + w]) for i in range(max(1, len(s) - w + 1))) if s else 0.0


def texts():
    rng = random.Random(2)
    bits = ["secret=token: abcdefghijk", "API_KEY = 'Zx9-Kd83_hQ1'", "password:", " short", "AKIA" + "Q" * 12, "AKIAQ",
            "0123456789abcdef" * 2, "deadbeef", "é漢", "\n", "aB3dE5gH7jK9mN1pQ3sT5vW7", "passwd=\"x\"", "😀", "AKIAsecret=abcdefgh1"]
    return [None, "", *bits] + [" ".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(60)]


def test_base_spans_and_redaction(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    out = secrets.secret_spans(df)
    got = out.withColumn("red", secrets.redacted(out.text, out.found)).collect()
    for r in got:
        text = rows[r.doc_id][1] or ""
        spans = [(s.start, s.ord, s.end) for s in r.found]
        assert [s for s in spans if s[1] < 3] == base_spans(text)
        assert spans == sorted(spans)
        want, pos = "", 0
        for a, _, b in spans:
            if not (a < pos and pos > 0):
                want += text[pos:a] + "[SECRET]"
            pos = max(pos, b)
        assert r.red == want + text[pos:]
    assert any(s.ord == 4 for r in got for s in r.found)


def test_window_entropy_equals_direct_computation(spark):
    rng = random.Random(3)
    words = ["", "a", "ab" * 30, "é" * 25] + ["".join(rng.choice("abcDEF0123+/=") for _ in range(rng.randrange(1, 70)))
                                              for _ in range(40)]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for r in df.select("s", secrets.window_entropy(df.s).alias("e")).collect():
        assert r.e == pytest.approx(entropy(r.s), abs=1e-9)


@pytest.mark.parametrize("value", ["123e4567-e89b-12d3-a456-426614174000", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NM",
                                   "abcdefghijklmnopqrstuvwxyz0123456789", "loweieiekeitheitungschenpfverbe1"])
def test_allow_list(spark, value):
    df = spark.createDataFrame([(1, f"see {value} here")], "doc_id long, text string")
    assert secrets.secret_spans(df).first().found == []


@pytest.mark.parametrize("part", ["abc/", "ab1/", "abc-", "ab1_", "Ab=", "abcdef", "1234567-", "example-", "x1+", "abcdefgh-"])
def test_values_of_100_000_parts(spark, part):
    long = part * 100_000
    texts = [long, "password=" + long, "A" + long + "Zz9Kd83hQ1pLx7Wm"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.ord, s.end) for s in r.found] for r in secrets.secret_spans(df).collect()}
    assert [s for s in got[1] if s[1] < 3] == base_spans(texts[1])


@pytest.mark.parametrize("value,allowed", [
    ("my-example-key-1234-abcd", True), ("your_api_key_goes_here_1", True), ("xxxxxxxxxxxxxxxxxxxx1234", True),
    ("abcdefghij0123456789--", True), ("src/main/java/App2/Util1", True), ("/usr/lib/x86/ab12/Tool3", True),
    ("example-aB3dE5gH7jK9mN1p", False), ("aB3dE5gH7jK9mN1pQ3sT5vW7", False), ("src/aB3dE5gH7jK9mN1pQ3s", False)])
def test_allow_list_explains_whole_values(spark, value, allowed):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(df.v.rlike(secrets.ALLOWED)).first()[0] is allowed


def test_random_secrets_are_reported(spark):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for alphabet, size in ((letters + "+/", 20), (letters + "+/", 32), (letters, 20)):
        made = ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(1500)]
        made = [v for v in made if re.search("[0-9]", v) and re.search("[A-Za-z]", v)]
        df = spark.createDataFrame([(i, f"see {v} here") for i, v in enumerate(made)], "doc_id long, text string")
        missed = sum(not r.found for r in secrets.secret_spans(df).collect())
        assert missed <= 0.03 * len(made)
    inside = "aB3dE5gH7jK9-sample-mN1pQ3sT5vW7", "Zx9Kd83hQ112345678Lw0Rt5Yv2"
    df = spark.createDataFrame([(i, f"see {v} here") for i, v in enumerate(inside)], "doc_id long, text string")
    assert all(r.found for r in secrets.secret_spans(df).collect())
    clean = "your_example_value_1234", "usr/local/share/Docs/page12", "/2024/01/15/some-long-title-42", "A-Sample-Value-For-2024-Use"
    df = spark.createDataFrame([(i, f"see {v} here") for i, v in enumerate(clean)], "doc_id long, text string")
    assert not any(r.found for r in secrets.secret_spans(df).collect())


def test_license_places_and_labels(spark):
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.",
               "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
               "the license of the apache", "general public", "License Apache the under licensed"]
    rng = random.Random(4)
    rows = [(0, None), (1, "")] + [(2 + i, n) for i, n in enumerate(notices)]
    for i in range(60):
        rows.append((100 + i, " ".join(rng.choice(["foo", "bar,", "öl", "by", "all", *notices[:5]][: 5 + 5 * (i % 12 == 0)])
                                       for _ in range(20))))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, labels int")
    want_label = {"mit license": "mit", "apache license": "apache-2.0", "gnu general public license version 3": "gpl-3.0",
                  "cc by nc": "cc-by-nc"}
    for r in licenses.scan_licenses(df).collect():
        w = licenses.words_of(dict(rows)[r.doc_id])
        places, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels))
        if r.doc_id in range(2, 10):
            text = " ".join(w)
            assert set(r.labels.split(",")) - {""} == labels | {v for k, v in want_label.items() if k in text}
        assert 0 <= r.score <= 1


def test_license_notices_in_hot_sources_and_small_tables(spark):
    notice = "Released under the MIT License."
    rows = [(i, f"page {i} {notice}" if i % 3 == 0 else f"page {i} of other text") for i in range(60)]
    for table in (rows, [(0, notice)]):
        df = spark.createDataFrame(table, "doc_id long, text string")
        got = {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()}
        assert got == {i: "mit" if notice in t else "" for i, t in table}


def test_every_license_notice_of_a_file_is_found(spark):
    whole = {label: text for label, text, _ in licenses.TEMPLATES}  # the longest notice of each label
    rows = [(0, " ".join(whole.values()))] + [(1 + k, f"{a} and {b}") for k, (a, b) in enumerate(
        (whole[x], whole[y]) for x, y in (("bsd", "mit"), ("apache-2.0", "mit"), ("gpl-notice", "mit")))]
    rows += [(10 + i, "some text without any notice") for i in range(40)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == {*whole, "gpl", "cc-by"}
    assert [got[k] for k in (1, 2, 3)] == [{"bsd", "mit"}, {"apache-2.0", "mit"}, {"gpl", "gpl-notice", "mit"}]


def test_variants_of_one_item_in_one_text(spark):
    item = "the farmer sold 12 baskets of ripe apples to his neighbour and kept 5 baskets for the long winter at home"
    variants = [item.replace("12", str(7 + k)).replace("5", str(20 + k)) for k in range(3)]
    docs = [(1, " ".join(variants[:2])), (2, " some words between ".join(variants)), (3, variants[0]), (4, item + " " + variants[0])]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert [got[k].verbatim for k in (1, 2, 3, 4)] == [False, False, False, True]


def test_reparameterised_questions_are_caught(spark):
    item = ("Tom has 12 apples and his friend Anna Lee gives 12 more apples, so how many kilos of fruit does he carry home "
            "after 3 days")
    swapped = item.replace("12", "7").replace("Anna", "Maria").replace("3 days", "9 weeks")
    mixed = swapped.replace("7 more", "8 more").replace("Lee", "Kim").replace("9", "4")
    docs = [(1, "foo bar " + item + " baz"), (2, "foo bar " + swapped + " baz"), (3, None), (4, ""), (5, "Tom has 12 apples"),
            (6, "some other text without any of these questions in it"), (7, item), (7, item)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, key int")
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, words string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(spark, df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 1)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim
    assert got[2, 1].slots == got[2, 1].consistent_slots
    strict = decontam.leaks(spark, spark.createDataFrame([(8, mixed)], "doc_id long, text string"), bench, consistent=0.0)
    r = strict.first()
    assert r.consistent_slots < r.slots  # 12 stands for 7 and for 8
    assert decontam.leaks(spark, df.limit(0), bench).count() == 0
    assert decontam.leaks(spark, df, bench.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<a>", "\\", "<", "/", "a b", "\n", " ", "é😀", "$1", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to\\n\nol", "", "<s>r\\"]),
             "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for c in range(120) for t in range(rng.randrange(1, 5))]
    rows += [(900, None, None, None), (None, 1, "user", "x"), (901, 1, "user", "x"), (901, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, source string")
    got = chat.format_conversations(df)
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for r in got.collect():
        turns = [(x[2], x[3]) for x in sorted(want[r.conv_id])]
        assert r.identical and [(t.role, t.text) for t in r.turns] == turns
    for r in chat.digest(got).collect():
        turns = [(x[2], x[3]) for x in sorted(want[r.conv_id])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_turns_that_do_not_come_back_are_an_error(spark):
    got = chat.format_conversations(spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string"))
    broken = got.withColumn("identical", F.lit(False))
    with pytest.raises(Exception, match="did not come back identical"):
        chat.digest(broken).collect()
