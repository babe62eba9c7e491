"""Near-duplicate classes against exact brute force, on skewed and odd tables."""

import random
import re

import numpy as np
import pytest

from sheaf.llm.graph import components
from sheaf.llm.neardup import near_duplicates

SCHEMA = "doc_id long, text string, rep string, component string"


def brute(rows, width=5, percent=80):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        s = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[i] = s
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_classes_equal_brute_force(spark, width):
    rng = random.Random(width)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (5, "x " * 3000)]
    for _ in range(60):  # near copies of one text: some under, some over the threshold
        t = list(base)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = "edit%d" % rng.randrange(1000)
        rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + k, " ".join(base)) for k in range(40)]  # exact copies
    for _ in range(60):  # texts that only share a passage
        rows.append((len(rows), " ".join(passage + [rng.choice(vocab) for _ in range(rng.randrange(20, 80))])))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, df, width=width, small=8).collect()}
    assert got == brute(rows, width)


def test_large_family_of_edited_copies_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    n, m = 2000, 300
    kept = np.ones((n, m), dtype=np.float32)
    for row in kept:
        row[rng.choice(m, rng.integers(10, 31), replace=False)] = 0
    rows = [(i, " ".join(f"b{k}" if on else f"e{i}x{k}" for k, on in enumerate(row))) for i, row in enumerate(kept)]
    both = kept @ kept.T
    linked = 100 * both >= 80 * (2 * m - both)
    want = np.arange(n)
    while True:
        low = np.min(np.where(linked, want[None, :], n), axis=1)
        if (low == want).all():
            break
        want = low
    got = {r.doc_id: r.component_id for r in near_duplicates(
        spark, spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()}
    assert 100 < len(set(want)) < n and got == dict(enumerate(want.tolist()))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f")],
                               "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(spark, df).collect())
    assert got == [(False, 3, 3, True), (False, 7, 3, False), (False, 7, 3, False), (True, 0, None, True)]
    assert near_duplicates(spark, df.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 200), (301, 300), (300, 302)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + k: 100 for k in range(40)}, 300: 300, 301: 300, 302: 300}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_branch_once_a_level(spark, monkeypatch):
    from sheaf.llm import neardup

    seen, plain = {}, neardup.written

    def written(s, df, name):
        seen.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return plain(s, df, name)

    monkeypatch.setattr(neardup, "written", written)
    shared = [" ".join(f"p{k}" for k in range(30))] * 60  # texts alike in half of their words: no family
    rows = [(i, f"{t} " + " ".join(f"x{i}y{k}" for k in range(25))) for i, t in enumerate(shared)]
    out = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), small=4)
    assert out.where("kept").count() == len(rows)
    assert len(seen["neardup-mixed"]) > 1 and not any("Generate" in plan for plan in seen["neardup-mixed"][1:])
    assert len(seen["neardup-branches"]) == len(seen["neardup-mixed"]) - 1
