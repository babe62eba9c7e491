"""Range join and vector codes against brute force, on copies, clusters and odd vectors."""

import hashlib

import numpy as np
import pytest

from sheaf.llm.codes import compressed, hilbert_keys, nearest, op13_vector_codes, shortlists
from sheaf.llm.ranges import similar_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, node string, home string"
NAN, INF = float("nan"), float("inf")


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return a @ b / np.sqrt((a @ a) * (b @ b))


def fine(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows, least=0.93):
    links = {i: set() for i in range(len(rows))}
    for i, (a, v, la) in enumerate(rows):
        for j, (b, w, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and a is not None and b is not None and fine(v) and fine(w) and (
                    len(v) == len(w) and any(v) and any(w)) and (v == w or cosine(v, w) >= least):
                links[i].add(j)
    out = []
    for i, (a, _, _) in enumerate(rows):
        seen, open_ = {i}, [i]
        while open_:
            new = links[open_.pop()] - seen
            seen |= new
            open_ += new
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((a, len(links[i]), low, a is None or a == low))
    return sorted(out, key=str)


def clusters(rng, n, dim, spread):
    centre = rng.normal(size=dim)
    return (centre + spread * rng.normal(size=(n, dim))).tolist()


@pytest.mark.parametrize("cell,block,values", [(1000, 1000, 10 ** 6), (20, 7, 10 ** 6), (10, 50, 40)])
def test_links_equal_brute_force(spark, cell, block, values):
    rng = np.random.default_rng(cell)
    vectors = []
    for spread in (0.05, 0.2, 0.3, 0.35, 0.5):  # from near copies to pairs around the threshold and beyond
        vectors += [(v, 1) for v in clusters(rng, 40, 8, spread)]
        vectors += [(v, 2) for v in clusters(rng, 10, 8, spread)]
    vectors += [(vectors[0][0], 1)] * 60 + [(vectors[0][0], 2)] * 3  # a hot vector, and the same under another label
    vectors += [([2 * x for x in vectors[1][0]], 1), ([-x for x in vectors[1][0]], 1), (vectors[2][0], None)]
    vectors += [(None, 1), ([], 1), ([0.0] * 8, 1), ([NAN] + [1.0] * 7, 1), ([INF] + [1.0] * 7, 1), ([None] + [1.0] * 7, 1),
                ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e300] * 8, 3), ([1e-300] * 8, 3), ([1e300] * 8, 3), ([-0.0] * 7 + [1.0], 4), ([0.0] * 7 + [1.0], 4)]
    ids = rng.permutation(len(vectors)).tolist()
    rows = [(i + 100, v, label) for i, (v, label) in zip(ids, vectors)] + [(None, vectors[0][0], 1), (2 ** 60 + 1, vectors[3][0], 1)]
    rows.append(rows[5])  # a repeated row
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = similar_vectors(spark, df, cell=cell, block=block, pivot_values=values)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_links(rows)


def test_chain_of_links_over_many_cells(spark):
    turn = np.linspace(0, 2 * np.pi, 60, endpoint=False)  # neighbours 6 degrees apart: linked to three on each side
    rows = [(59 - i, [float(np.cos(t)), float(np.sin(t))], "x") for i, t in enumerate(turn)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = similar_vectors(spark, df, cell=5, block=4).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(6, 0)}
    assert sorted(r.vec_id for r in got if r.kept) == [0]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar_vectors(spark, empty).collect() == []
    rows, books = compressed(spark, empty)
    assert rows.collect() == [] and books.shape[1] == 0
    odd = spark.createDataFrame([(1, None, None, "", ""), (None, [NAN], 2, "", "")], SCHEMA)
    assert sorted((tuple(r) for r in similar_vectors(spark, odd).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]
    assert compressed(spark, odd)[0].collect() == []


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        keys = [k.tobytes() for k in hilbert_keys(grid, bits)]
        assert len(set(keys)) == len(grid)
        path = grid[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    entries = rng.integers(-50, 50, size=(40, 4))
    for _ in range(50):
        x = rng.integers(-60, 60, size=4) + rng.integers(-8, 9, size=(20, 4))
        d = ((x[:, None] - entries) ** 2).sum(axis=2)
        short = shortlists(x.min(axis=0)[None], x.max(axis=0)[None], entries)[0]
        ties = (d == d.min(axis=1, keepdims=True)).any(axis=0)
        assert short[ties].all()
    far = 1 << 26  # beyond exact doubles: 64-bit integers
    x, e = np.array([[far, -far], [far, far]]), np.array([[far, -far + 1], [-far, far], [far, -far]])
    assert nearest(x, e, far)[0].tolist() == [2, 0]
    assert nearest(x, e, far)[1].tolist() == [0, (2 * far - 1) ** 2]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [max(-(1 << 26), min(1 << 26, int(np.floor(float(x) * 1024)))) for x in v], label) for i, v, label in rows if fine(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    of = lambda v, p: v[p * size:(p + 1) * size]
    books = [[of(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(of(v, p), e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
                for _, v, _ in kept]
    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [of(v, p) for (_, v, _), b in zip(kept, best) if b[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], {}
    for (i, _, label), b in zip(kept, assign()):
        out.append((i, label, [k for _, k in b], sum(d for d, _ in b)))
        by_label[label] = by_label.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(out, key=str), by_label, digest


def vectors(rng, n, dim=8):
    out = [(i, v.round(3).tolist(), int(rng.integers(3))) for i, v in enumerate(rng.normal(size=(n, dim)) * 0.3)]
    out += [(n + k, out[0][1], 1) for k in range(30)]  # a hot vector
    out += [(n + 50, None, 1), (n + 51, [NAN] * dim, None), (n + 52, [None] * dim, 1), (n + 53, [INF] * dim, 1), (n + 54, [], 1),
            (n + 55, [0.0] * dim, None), (n + 56, [-0.0005] * dim, None), (None, [0.25] * dim, 0), (3, out[4][1], 2)]
    return out


@pytest.mark.parametrize("entries,block", [(16, 8), (256, 32)])
def test_codes_equal_brute_force(spark, entries, block):
    rows = vectors(np.random.default_rng(entries), 150)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got, books = compressed(spark, df, entries=entries, block=block)
    want, _, digest = brute_codes(rows, entries=entries)
    assert sorted(((r.vec_id, r.label, r.codes, r.error) for r in got.collect()), key=str) == want
    assert hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() == digest


def test_extreme_components_and_other_lengths(spark):
    rows = [(1, [1e300, -1e300, 70000.0, 0.1], 1), (2, [0.1, 0.2, 0.3, 0.4], 1), (3, [1e300, -1e300, 60000.0, 0.1], 1)]
    df = spark.createDataFrame([(*r, "", "") for r in rows + [(4, [1.0, 2.0], 1)]], SCHEMA)
    got = compressed(spark, df, entries=2)[0].collect()  # a vector of another length than the first is not kept
    assert sorted((r.vec_id, r.label, r.codes, r.error) for r in got) == brute_codes(rows, entries=2)[0]
    five = spark.createDataFrame([(i, [0.1 * i] * 5, 1, "", "") for i in range(6)], SCHEMA)  # filled up to eight
    got, books = compressed(spark, five, entries=3)
    assert books.shape == (4, 3, 2) and got.count() == 6 and (books[3] == 0).all()


def test_query_equals_brute_force_on_a_small_table(spark, tmp_path):
    rows = vectors(np.random.default_rng(9), 300, 16)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    want, by_label, digest = brute_codes(rows)
    want = sorted((str(i), "".join(f"{k:02x}" for k in c), e, by_label[label], digest) for i, label, c, e in want)
    assert sorted((str(r[0]), *r[1:]) for r in op13_vector_codes(spark, str(tmp_path)).collect()) == want
