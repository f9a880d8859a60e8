"""Near-duplicates and vector neighbours against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from corvella.llm import near_duplicates as nd
from corvella.llm import vector_join as vj

NOUNS = [f"word{i}" for i in range(3000)]


def shingles(t, width):
    w = re.findall(r"[^\W_]+", t.lower())
    return set(zip(*(w[k:] for k in range(width))))


def brute(texts, width, threshold):
    sets = {k: shingles(t, width) for k, t in texts.items() if t}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def family(rng, n):
    base = [rng.choice(NOUNS) for _ in range(rng.randint(60, 200))]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = base[:]
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[i] = rng.choice(NOUNS)
            else:
                w.insert(i, rng.choice(NOUNS))
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [t for _ in range(40) for t in family(rng, rng.randint(1, 6))]
    out += [out[0], out[0].upper(), out[3]]  # equal word sequences
    rng.shuffle(out)
    return dict(enumerate(out))


def test_near_duplicate_pairs(spark, texts):
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(0, texts[0], 1)], "id int, body string, key int")
    got = {tuple(r) for r in nd.near_duplicate_pairs(df, "id", "body", width=3, threshold=0.6).collect()}
    want = brute(texts, 3, 0.6)
    assert got <= want
    assert len(got & want) >= 0.99 * len(want)


def test_near_duplicate_groups_at_defaults(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "id int, body string")
    rows = {r.key: r for r in nd.near_duplicate_groups(df, "id", "body").collect()}
    want = brute(texts, 5, 0.8)
    words = {k: " ".join(re.findall(r"[^\W_]+", t.lower())) for k, t in texts.items()}
    assert set(rows) == set(texts)
    for k, r in rows.items():
        same = [j for j in words if words[j] == words[k]]
        assert r.class_key == min(same) and r.copies == len(same)
        others = {words[b if a == k else a] for a, b in want if k in (a, b)} - {words[k]}
        assert r.links == len(others)


def test_near_duplicates_only(spark, texts):
    df = spark.createDataFrame([(k, t, k % 2) for k, t in texts.items()], "id int, body string, side int")
    only = spark.createDataFrame([(1,)], "side int")
    got = {tuple(r) for r in nd.near_duplicate_pairs(df, "id", "body", width=3, threshold=0.6, only=("side", only)).collect()}
    assert got == {p for p in brute({k: t for k, t in texts.items() if k % 2}, 3, 0.6)}
    assert nd.near_duplicate_groups(df, "id", "body", only=("side", only)).where("key % 2 = 0").count() == 0


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (None, long, "x"), (4, long, None), (5, long + " tail", None), (5, long + " tail", None)]
    df = spark.createDataFrame(rows, "id int, body string, same string")
    assert [tuple(r) for r in nd.near_duplicate_pairs(df, "id", "body").collect()] == [(4, 5)]
    assert nd.near_duplicate_pairs(df.limit(0), "id", "body").count() == 0
    assert nd.near_duplicate_groups(df.limit(0), "id", "body").count() == 0


def test_many_copies_become_a_star(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.range(300).selectExpr("id", f"'{t}' AS body").unionByName(spark.createDataFrame([(1000, t + " more")], "id long, body string"))
    got = {tuple(r) for r in nd.near_duplicate_pairs(df, "id", "body").collect()}
    # 300 copies make 44,850 pairs: each is tied to the first, and the class to its neighbour by all 300 pairs
    assert {(0, i) for i in range(1, 300)} <= got
    assert got - {(0, i) for i in range(1, 300)} == {(i, 1000) for i in range(300)}


def test_register_share_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) for n in (600, 200, 200))
    items = np.concatenate([common, a, common, b])
    owner = np.concatenate([np.zeros(800, np.int64), np.ones(800, np.int64)])
    r = nd.registers(items, owner, 2)
    packed = r.view("<i8")
    assert abs(nd.register_share(packed[:1], packed[1:])[0] - 0.6) < 0.15


def vectors(rng, n, groups):
    centres = rng.standard_normal((n // 4, 16))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + 0.25 * rng.standard_normal(16)
        rows.append((int(i), int(rng.integers(groups)), [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)]))
    for i in range(20):  # equal vectors and scaled ones
        rows.append((n + i, rows[3][1], rows[3][2]))
    return rows


def brute_neighbours(rows, k, threshold):
    want = {}
    for i, g, v in rows:
        v = np.array(v)
        near = []
        for j, h, w in rows:
            if j != i and h == g:
                w = np.array(w)
                c = float(v @ w / np.linalg.norm(v) / np.linalg.norm(w))
                if c >= threshold:
                    near.append((-round(c, 9), j))
        want[i] = {j for _, j in sorted(near)[:k]}
    return want


def neighbour_sets(df, **options):
    got = {}
    for r in vj.neighbours(df, "id", "grp", "vec", 16, **options).collect():
        got.setdefault(r.key, set()).add(r.neighbour)
    return got


def test_neighbours_exact_and_by_cells(spark):
    rows = vectors(np.random.default_rng(2), 700, 2)
    df = spark.createDataFrame(rows + rows[:5], "id int, grp int, vec array<float>")
    want = brute_neighbours(rows, 5, 0.85)
    exact = neighbour_sets(df)
    assert all(exact.get(i, set()) == w for i, w in want.items())
    cells = neighbour_sets(df, block=40, visits=4)
    total = sum(map(len, want.values()))
    assert sum(len(cells.get(i, set()) & w) for i, w in want.items()) >= 0.9 * total


def test_neighbours_are_exact_with_every_cell(spark):
    rows = vectors(np.random.default_rng(7), 600, 2)
    df = spark.createDataFrame(rows, "id int, grp int, vec array<float>")
    assert neighbour_sets(df, k=5, threshold=0.5, block=16, visits=vj.EVERY_CELL) == {i: w for i, w in brute_neighbours(rows, 5, 0.5).items() if w}


def test_merging_holds_few_offers():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    cos, other = np.round(rng.random(5000), 2), np.arange(5000)
    batch = lambda s: pa.RecordBatch.from_arrays([pa.array([1] * len(s)), pa.array([7] * len(s)), pa.array(other[s]), pa.array(cos[s])], ["grp", "cls", "other", "similarity"])
    out = pa.Table.from_batches(list(vj._merged(iter([batch(np.arange(i, i + 500)) for i in range(0, 5000, 500)]), 5)))
    want = sorted(zip(-cos, other))[:5]
    assert list(zip(out["similarity"].to_pylist(), out["other"].to_pylist())) == [(-c, int(o)) for c, o in want]


def test_neighbours_edges(spark):
    rows = [(1, 1, [1.0] * 16, 7), (2, 1, None, 7), (3, 1, [0.0] * 16, 7), (4, 1, [1.0] * 15, 7), (5, None, [1.0] * 16, 7), (None, 1, [1.0] * 16, 7), (6, 1, [float("nan")] * 16, 7), (7, 1, [2.0] * 16, 7), (8, 2, [1.0] * 16, 7)]
    df = spark.createDataFrame(rows, "id int, grp int, vec array<float>, key int")
    assert neighbour_sets(df) == {1: {7}, 7: {1}}
    assert neighbour_sets(df.limit(0)) == {}
    ties = spark.createDataFrame([(i, 1, [1.0] * 16) for i in range(9)], "id int, grp int, vec array<float>")
    got = neighbour_sets(ties)
    assert got[0] == {1, 2, 3, 4, 5} and got[3] == {0, 1, 2, 4, 5} and got[8] == {0, 1, 2, 3, 4}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = vj.quantise(x)
    est, slack = vj.tile_bounds(q, s, e, q, s, e)
    assert (np.abs(est - x @ x.T) <= slack[:, None]).all()


def test_hot_slots_are_cut_into_tiles(spark, texts, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 2)
    df = spark.createDataFrame(list(texts.items()), "id int, body string")
    got = {tuple(r) for r in nd.near_duplicate_pairs(df, "id", "body", width=3, threshold=0.6).collect()}
    want = brute(texts, 3, 0.6)
    assert got <= want and len(got & want) >= 0.99 * len(want)


def test_texts_repeated_in_themselves_stay_linked(spark):
    rng = random.Random(7)
    bases = [" ".join(rng.sample(NOUNS, 60)) for _ in range(6)]
    # at five words 56 and 60 different shingles, at three words 58 and 60, however often the text is repeated
    df = spark.createDataFrame([(10 * i + k, " ".join([t] * k)) for i, t in enumerate(bases) for k in (1, 2, 3)], "id int, body string")
    want = {(10 * i + a, 10 * i + b) for i in range(6) for a, b in combinations((1, 2, 3), 2)}
    assert {tuple(r) for r in nd.near_duplicate_pairs(df, "id", "body", width=3, threshold=0.6).collect()} == want
    assert {r.key: r.links for r in nd.near_duplicate_groups(df, "id", "body").collect()} == {10 * i + k: 2 for i in range(6) for k in (1, 2, 3)}
