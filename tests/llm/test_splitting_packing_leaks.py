"""Splitting, packing and leaks: invariants, exact round trips and brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvella.llm import leakage, packing, splitting
from corvella.llm.queries import QUERIES, SQL
from tests.compare import same
from tests.conftest import DATA

# splitting


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n\ré😀", max_size=400), st.integers(-2, 90), st.integers(-3, 100))
def test_piece_spans(text, limit, overlap):
    spans = splitting.piece_spans(text, limit, overlap)
    limit, overlap = max(1, limit), max(0, overlap)
    overlap = limit // 2 if overlap >= limit else overlap
    assert bool(spans) == bool(text)
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in spans)
        assert all(c == b - overlap and d > b for (_, b), (c, d) in zip(spans, spans[1:]))


def test_cut_is_the_strongest_and_rightmost():
    text = "one two. three four\n\nfive six. seven eight"
    strengths = splitting.cut_strengths(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert strengths[text.index("five")] == 5 and strengths[text.index("three")] == 3 and strengths[text.index("four")] == 1
    for limit in range(8, 40):
        start, cut = splitting.piece_spans(text, limit, 3)[0]
        lo, hi = max(4, (limit + 1) // 2), limit
        window = strengths[lo : hi + 1]
        assert cut == lo + max(i for i, s in enumerate(window) if s == window.max())


def test_range_index_is_brute_force():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 6, 200)
    index = splitting.StrongestCut(s.astype(np.int64), 50, 64)
    for _ in range(300):
        lo = int(rng.integers(50, 200))
        hi = int(min(249, lo + rng.integers(0, 60)))
        part = s[lo - 50 : hi - 49]
        assert index.query(lo, hi) == lo + max(i for i, x in enumerate(part) if x == part.max())


def test_split_edges(spark):
    long = "word " * 100_000
    rows = [(1, None, 10, 2, "x"), (2, "", 10, 2, "x"), (3, "short", 10, 2, "x"), (4, "a" * 1700, None, None, "x"), (5, "a b c d e f", 0, -1, "x"), (6, long, 1000, 100, "x"), (3, "short", 10, 2, "x")]
    df = spark.createDataFrame(rows, "id int, body string, size int, lap int, piece string")
    got = {}
    for r in splitting.split_oversized(df, "body", "size", "lap", ["id"]).collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {3, 4, 5, 6} and len(got[3]) == 2
    assert [(r.start_at, r.end_at) for r in sorted(got[4], key=lambda r: r.piece_no)] == [(0, 800), (600, 1400), (1200, 1700)]
    pieces = sorted(got[6], key=lambda r: r.piece_no)
    assert pieces[0].piece + "".join(r.piece[100:] for r in pieces[1:]) == long
    assert splitting.split_oversized(df.limit(0), "body", "size", "lap", ["id"]).count() == 0


# packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan(counts):
    slots, containers = packing.plan(counts, 50)
    load = [0] * containers
    for length, n in counts.items():
        taken = sorted((first, last) for size, first, last, _, _ in slots if size == length)
        assert taken[0][0] == 0 and taken[-1][1] == n - 1 and all(b[0] == a[1] + 1 for a, b in zip(taken, taken[1:]))
    for size, first, last, container, each in slots:
        for rank in range(first, last + 1):
            load[container + (rank - first) // each] += size
    assert all(0 < x <= 50 for x in load)
    # best fit decreasing one by one needs as many
    rooms = []
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((r for r in range(len(rooms)) if rooms[r] >= size), key=lambda r: rooms[r], default=None)
        if fit is None:
            rooms.append(50 - size)
        else:
            rooms[fit] -= size
    assert containers == len(rooms)


def test_pack(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([0, 1, 5, 7, 9, 30, 33, 64, 65, 200]) for i in range(500)}
    items = spark.createDataFrame(list(sizes.items()), "key long, tokens long")
    kinds = spark.createDataFrame([(1, 64), (2, 1000), (3, 0), (4, None)], "bin_kind int, capacity int")
    rows = packing.pack(items, kinds).collect()
    for kind, capacity in ((1, 64), (2, 1000)):
        mine = [r for r in rows if r.bin_kind == kind]
        load, by_key = {}, {}
        for r in mine:
            load[r.container_no] = load.get(r.container_no, 0) + r.size
            by_key.setdefault(r.key, []).append(r)
        assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
        for k, n in sizes.items():
            parts = sorted(by_key.get(k, []), key=lambda r: r.piece_no)
            assert sum(r.size for r in parts) == n and [r.start_at for r in parts] == list(range(0, n, capacity))
            assert len(parts) <= 1 or n > capacity
        assert sum(load.values()) / (len(load) * capacity) > 0.9
    assert {r.bin_kind for r in rows} == {1, 2}
    assert packing.pack(items.limit(0), kinds).count() == 0
    assert packing.pack(items, kinds.limit(0)).count() == 0


def test_pack_texts_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "some words here", 1), (3, "some words here", 1), (None, "lost", 1), (4, "word " * 50_000, 1), (5, "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "id int, body string, tokens int")
    kinds = spark.createDataFrame([(1, 256)], "bin_kind int, capacity int")
    got = {}
    for r in packing.pack_texts(df, "id", "body", kinds).collect():
        got[r.key] = got.get(r.key, 0) + r.size
    coder = packing.tokenizer()
    assert got == {k: len(coder.encode_ordinary(t)) for k, t in ((3, "some words here"), (4, "word " * 50_000), (5, "x" * 100_000))}


# leaks


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_leaks_are_all_found(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(40)) for i in range(20)] + [(20, "too short"), (21, None)]
    items.append((22, items[0][1]))
    docs = [(i, text(80)) for i in range(60)]
    for i in range(60, 100):
        src = words(items[i % 20][1])
        a = rng.randrange(20)
        part = src[a : a + rng.choice([11, 12, 13, 14, 20])]
        docs.append((i, f"{text(9)} {' '.join(part).upper()}; {text(9)}"))
    docs += [(100, None), (101, ""), (102, "one two"), (103, text(40_000) + " " + items[3][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs + docs[60:62]], "id int, body string, item string")
    queries = spark.createDataFrame([(*i, "x") for i in items], "item_id int, body string, key string")
    want = set()
    for i, t in items:
        if t:
            w = words(t)
            grams = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
            for d, u in docs:
                v = words(u or "")
                if any(tuple(v[k : k + 13]) in grams for k in range(len(v) - 12)):
                    want.add((d, i))
    got = {(r.key, r.item) for r in leakage.leaked_items(df, "id", "body", queries, "item_id", "body").collect()}
    assert got == want and len(want) > 20
    bits, rows = leakage.MOST_BITS, leakage.SHARE_ROWS
    try:
        leakage.MOST_BITS, leakage.SHARE_ROWS = 64, 3  # a bitmap that is full keeps nothing back; hot windows are dealt out
        assert {(r.key, r.item) for r in leakage.leaked_items(df, "id", "body", queries, "item_id", "body").collect()} == want
    finally:
        leakage.MOST_BITS, leakage.SHARE_ROWS = bits, rows
    assert leakage.leaked_items(df.limit(0), "id", "body", queries, "item_id", "body").count() == 0
    assert leakage.leaked_items(df, "id", "body", queries.limit(0), "item_id", "body").count() == 0


def test_edited_leaks_reach_the_recall(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(i, [rng.choice(vocabulary) for _ in range(20)]) for i in range(60)]
    docs = []
    for i, w in items:
        edited = w[:]
        edited[rng.randrange(3, 17)] = "changed"
        del edited[rng.randrange(3, 17)]
        docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(15)) + " " + " ".join(edited) + " " + " ".join(rng.choice(vocabulary) for _ in range(15))))
    queries = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id int, body string")
    df = spark.createDataFrame(docs, "id int, body string")
    # a deletion shifts a word of the document into the window: 20 words are then 3 edits away
    got = {(r.key, r.item) for r in leakage.leaked_items(df, "id", "body", queries, "item_id", "body", window=20, edits=3, recall=0.95).collect()}
    assert all(k == i for k, i in got) and len(got) >= 0.9 * len(items)


def test_planted_edits_reach_the_recall(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, draw(30)) for i in range(300)]
    docs = []
    for i, w in items:
        edited = w[5:25]
        for _ in range(i % 3):  # none, one or two words changed
            edited[rng.randrange(20)] = rng.choice(vocabulary)
        docs.append((i, " ".join(draw(20) + edited + draw(20))))
    df = spark.createDataFrame(docs, "id int, body string")
    queries = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id int, body string")
    got = {(r.key, r.item): r.edits for r in leakage.leaked_items(df, "id", "body", queries, "item_id", "body", window=20, edits=2).collect()}
    assert all(k == i for k, i in got)
    for n in range(3):
        cases = [i for i in range(n, 300, 3)]
        assert sum((i, i) in got for i in cases) >= (0.95 if n else 1) * len(cases)
        assert all(got[i, i] <= n for i in cases if (i, i) in got)


def test_window_keys_follow_the_embedding():
    rng = np.random.default_rng(2)
    codes = rng.integers(1, 1 << 63, 200, dtype=np.int64).astype(np.uint64)
    again = np.concatenate([codes[50:90], codes])
    a, b = leakage.window_keys(codes, np.arange(50, 70), 20, 3), leakage.window_keys(again, np.arange(0, 20), 20, 3)
    assert (a == b).all() and len(set(a.tolist())) > 5
    many = leakage.window_keys(np.tile(codes, 100), np.arange(0, 19_000), 20, 3)
    assert (many[:150] == leakage.window_keys(codes, np.arange(150), 20, 3)).all() and (many[200 * 45 : 200 * 45 + 150] == many[:150]).all()


def test_few_edits_are_edit_distances():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 4, (3000, 7)).astype(np.uint64)
    b = np.where(rng.random(a.shape) < 0.15, rng.integers(0, 4, a.shape).astype(np.uint64), np.where(rng.random((len(a), 1)) < 0.5, a, np.roll(a, 1, axis=1)))
    want = [min(3, leakage.edit_distance(x.tolist(), y.tolist(), 3)) for x, y in zip(a, b)]
    assert leakage.few_edits(a, b, 2).tolist() == want and set(want) == {0, 1, 2, 3}


def test_edit_distance():
    assert leakage.edit_distance(list("kitten"), list("sitting"), 3) == 3
    assert leakage.edit_distance(list("kitten"), list("sitting"), 2) == 3
    assert leakage.edit_distance([], list("ab"), 2) == 2


# queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, oracle, name):
    same(QUERIES[name](spark, str(DATA)), oracle, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    rows = QUERIES[name](spark, str(DATA))
    assert rows.count() >= 0 and rows.columns
