"""Passages of test items inside a corpus, by CGK embedding and bit-sampling LSH.

Every window of ``window`` words of an item and of a document walks through the CGK embedding: three steps a word, at
each the current word is put out and a random bit of that word decides whether to move on (walked as far as positions are sampled).  Windows at a small edit
distance come out at a small Hamming distance; equal windows come out equal.  A repetition samples some positions of the output and hashes
them; windows that share a hash in any repetition are candidates and are verified word by word, by an edit
distance within the allowed number of edits.

The documents are read once, however many items there are.  Bitmaps of bounded size, of the items' hashes and of their word triples, keep nearly all
windows of the documents from leaving the task: one within e edits of an item's window shares all of its triples but 3 e.  The rest meet the
items' windows in a join.  Windows that are equal are compared once, wherever they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.words import WORD, WordCodes, mix, shingle_codes
from corvella.runtime import materialise

STEPS_PER_WORD = 3
#: Positions of the embedding in a hash: where windows must be equal, more of them cost no case.
SAMPLED, SAMPLED_EQUAL = 4, 12
#: Steps a word among which positions are sampled: later on most walks have come to their end, and all windows look alike.
TELLING_STEPS = 2
GRAM = 3
#: Bits in the bitmap of the items' hashes: BITS_PER_KEY for each, a power of two between these bounds.  Beyond them it lets more windows pass, and loses none.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 22, 1 << 28
#: Rows of a hash or window beyond which they are dealt into shares, so that one that a third of all documents hold is no single task's.
SHARE_ROWS = 10_000
_SLICE_WORDS = 300_000
_WALKED, _ROWS = 8_192, 20_000


def repetitions(window: int, edits: int, recall: float) -> int:
    """How often to sample so that a window at ``edits`` edits is met with the given probability.

    The embeddings of texts at edit distance e differ in O(e*e) places, about 2 e (e + 1) on average over the walks, nearly all of them before the walks' end;
    equal windows need one repetition.
    """
    if edits == 0:
        return 1
    differ = min(0.9, 2 * edits * (edits + 1) / (TELLING_STEPS * window))
    hit = (1 - differ) ** SAMPLED
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def window_keys(codes: np.ndarray, starts: np.ndarray, window: int, repetition: int, sampled: int = SAMPLED) -> np.ndarray:
    """The sampled hash of the embedding of each window ``codes[s : s + window]``."""
    rng = np.random.default_rng(1000 + repetition)
    chosen = sorted(rng.choice(TELLING_STEPS * window, min(sampled, TELLING_STEPS * window), replace=False).tolist())
    # 64 random bits of each word at a time: bit j says whether a walk moves on from it at step j
    seeds = rng.integers(1, 1 << 63, STEPS_PER_WORD * window // 64 + 1, dtype=np.int64).astype(np.uint64)
    padded = np.concatenate([codes, np.zeros(1, np.uint64)])
    steps = chosen[-1] + 1
    moves = np.empty((steps, len(padded)), np.uint8)
    for j in range(steps):
        if j % 64 == 0:
            bits = mix(padded ^ seeds[j // 64])
        np.copyto(moves[j], (bits >> np.uint64(j % 64)) & np.uint64(1), casting="unsafe")
    out = np.full(len(starts), repetition + 1, np.uint64)
    for i in range(0, len(starts), _WALKED):
        at = starts[i : i + _WALKED].astype(np.int64)
        end = at + window
        key = out[i : i + _WALKED]
        for j in range(steps):
            if j in chosen:
                word = np.where(at < end, padded[at], np.uint64(0))
                key[:] = mix(key ^ (word + np.uint64(j)))
            at += moves[j].take(at)
            np.minimum(at, end, out=at)
    return out


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Edits (words put in, left out or changed) between two lists; ``most + 1`` if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j in range(1, len(b) + 1):
            if abs(i - j) > most:
                last, row[j] = row[j], most + 1
                continue
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != b[j - 1]))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def within_reach(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, window: int, edits: int) -> np.ndarray:
    """Whether pairs of windows can be within ``edits`` edits: all but so many words must recur at most that far away."""
    span = np.arange(window)
    mine = a[at[:, None] + span]
    found = np.zeros(mine.shape, bool)
    for shift in range(-edits, edits + 1):
        lo, hi = max(0, -shift), window - max(0, shift)
        found[:, lo:hi] |= mine[:, lo:hi] == b[bt[:, None] + span[lo + shift : hi + shift]]
    return found.sum(axis=1) >= window - edits


class Bitmap:
    """Which of many 64-bit hashes may be known: each has two bits."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = np.uint64(64 * len(words) - 1)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        one = keys & self.mask
        maybe = np.flatnonzero((self.words[(one >> np.uint64(6)).astype(np.int64)] >> (one & np.uint64(63))) & np.uint64(1))
        two = (keys[maybe] >> np.uint64(32)) & self.mask
        out = np.zeros(len(keys), bool)
        out[maybe] = ((self.words[(two >> np.uint64(6)).astype(np.int64)] >> (two & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def bitmap(windows: DataFrame) -> Bitmap:
    """The bitmap of the hashes in ``windows``; put together by slots, only words that are not zero come to the driver."""
    keys = windows.count()
    size = max(min(LEAST_BITS, MOST_BITS), min(MOST_BITS, 1 << (max(1, keys * BITS_PER_KEY) - 1).bit_length()))
    one = F.col("hash").bitwiseAND(F.lit(size - 1))
    two = F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(size - 1))
    places = windows.select(F.explode(F.array(one, two)).alias("place"))
    slots = places.select(F.shiftright("place", 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    found = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bitmap(words)


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """hash: the word triples of the texts."""
    coder = WordCodes()
    for pdf in batches:
        texts = [WORD.findall(t.lower()) for t in pdf["text"]]
        found, _ = shingle_codes(coder.codes([x for w in texts for x in w]), np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64), GRAM)
        yield pd.DataFrame({"hash": np.unique(found).view(np.int64)})


def _windows(batches: Iterator[pd.DataFrame], window: int, edits: int, reps: int, sent: object = None) -> Iterator[pd.DataFrame]:
    """key, words, sign, hashes: windows of the texts, each text's equal ones once.  ``sent`` holds the bitmaps of hashes and triples that let a window's hashes pass."""
    sampled = SAMPLED if edits else SAMPLED_EQUAL
    known, grams = sent.value if sent is not None else (None, None)
    coder = WordCodes()

    def run(keys: list[object], texts: list[list[str]]) -> Iterator[pd.DataFrame]:
        words = [x for w in texts for x in w]
        codes = coder.codes(words)
        ends = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        starts = np.flatnonzero(owner[: len(words) - window + 1] == owner[window - 1 :])
        alike = np.ones(len(starts), bool)
        if grams is not None and len(starts):
            met = np.concatenate([[0], np.cumsum(grams.has(shingle_codes(codes, np.array([0, len(codes)]), GRAM)[0]))])
            alike = met[starts + window - GRAM + 1] - met[starts] >= window - GRAM + 1 - GRAM * edits
        bits = np.uint64(1) << (codes & np.uint64(63))
        rows: dict[tuple[int, str], tuple[int, list[int]]] = {}
        for r in range(reps):
            hashes = window_keys(codes, starts, window, r, sampled)
            hit = np.arange(len(starts)) if known is None else np.flatnonzero(known.has(hashes) & alike)
            signs = np.bitwise_or.reduce(bits[starts[hit][:, None] + np.arange(window)], axis=1).view(np.int64) if len(hit) else hit
            for s, h, sign in zip(starts[hit].tolist(), hashes[hit].view(np.int64).tolist(), signs.tolist()):
                own = rows.setdefault((int(owner[s]), " ".join(words[s : s + window])), (sign, []))[1]
                if h not in own:
                    own.append(h)
        found = list(rows.items())
        for at in range(0, len(found), _ROWS):
            part = found[at : at + _ROWS]
            columns = {"key": [keys[d] for (d, _), _ in part], "words": [w for (_, w), _ in part], "sign": [s for _, (s, _) in part], "hashes": [h for _, (_, h) in part]}
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    for pdf in batches:
        keys, texts, n = [], [], 0
        for k, t in zip(pdf["key"], pdf["text"]):
            w = WORD.findall(t.lower())
            if len(w) >= window:
                keys.append(k), texts.append(w)
                n += len(w)
            if n >= _SLICE_WORDS:
                yield from run(keys, texts)
                keys, texts, n = [], [], 0
        if keys:
            yield from run(keys, texts)


def few_edits(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Edit distances of rows of word codes of one length as far as they are at most 2; larger ones as 3 (those above ``edits`` may be too).

    Rows of equal length are 1 apart by one changed word, and 2 apart by two, or by one left out and one put in.
    """
    n = a.shape[1]
    other = a != b
    changed = other.sum(axis=1)
    out = np.minimum(changed, 3)
    if edits >= 2 and n > 1:
        first, last = other.argmax(axis=1), n - 1 - other[:, ::-1].argmax(axis=1)
        for x, y in ((a, b), (b, a)):
            off = np.concatenate([np.zeros((len(a), 1), np.int64), np.cumsum(x[:, 1:] != y[:, :-1], axis=1)], axis=1)
            rows = np.arange(len(a))
            out = np.where((out > 2) & (off[rows, last] == off[rows, first]), 2, out)
    return out


def _verified(batches: Iterator[pd.DataFrame], window: int, edits: int) -> Iterator[pd.DataFrame]:
    coder = WordCodes()
    for pdf in batches:
        if not len(pdf):
            continue
        a, b = [w.split(" ") for w in pdf["words"]], [w.split(" ") for w in pdf["theirs"]]
        x, y = (coder.codes([v for w in part for v in w]).reshape(-1, window) for part in (a, b))
        told = few_edits(x, y, edits)
        if edits > 2:  # the rest word by word
            at = np.arange(len(pdf)) * window
            far = np.flatnonzero(told > 2)
            told[far] = edits + 1
            for i in far[within_reach(x.ravel(), at[far], y.ravel(), at[far], window, edits)]:
                told[i] = edit_distance(a[i], b[i], edits)
        near = np.flatnonzero(told <= edits)
        yield pdf.iloc[near][["words", "item"]].assign(edits=told[near].astype("int32"))


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, window: int = 13, edits: int = 0, recall: float = 0.95) -> DataFrame:
    """key, item, edits: documents with a window of ``window`` words within ``edits`` edits of a window of the item (the fewest found).

    With no edits allowed every case is found; else a case is found with probability ``recall`` or more, by a single pair of windows.
    Null texts, texts and items of fewer than ``window`` words give no rows; a repeated row does not repeat its cases.  Any number of items and
    documents: neither is gathered anywhere.
    """
    reps = repetitions(window, edits, recall)

    def texts(df: DataFrame, name: str, body: str) -> DataFrame:
        return df.select(F.col(f"`{name}`").alias("key"), F.col(f"`{body}`").alias("text")).where(F.length("text") >= 2 * window - 1)

    def windows(source: DataFrame, **sent: object) -> DataFrame:
        return source.mapInPandas(partial(_windows, window=window, edits=edits, reps=reps, **sent), f"key {source.schema['key'].dataType.simpleString()}, words string, sign bigint, hashes array<bigint>")

    asked_for = texts(items, item, item_text)
    theirs = materialise(windows(asked_for).distinct(), "itemwindows")
    held = theirs.select(F.xxhash64("words").alias("iwid"), F.col("words").alias("theirs"), F.col("sign").alias("isign"), F.col("key").alias("item"), F.explode("hashes").alias("hash"))
    grams = bitmap(materialise(asked_for.mapInPandas(_grams, "hash bigint").distinct(), "itemgrams")) if window > GRAM else None
    sent = docs.sparkSession.sparkContext.broadcast((bitmap(held.select("hash").distinct()), grams))
    mine = materialise(windows(texts(docs, key, text), sent=sent), "hits")
    asked = mine.select(F.xxhash64("words").alias("wid"), "words", "sign", F.explode("hashes").alias("hash"))
    # equal windows meet the items once, however many documents hold them
    equal = _dealt(asked.select("hash", "words").distinct(), held.select("hash", "theirs", "item"), "hash").where("words = theirs").select("words", "item").distinct()
    found = equal.withColumn("edits", F.lit(0))
    if edits:
        # hashes meet without their words, but for a sign that has a bit for each: an edit takes out one at most and puts in one at most.
        # A window that an item has as it is needs no other of that item
        equal = materialise(equal, "equal")
        done = equal.select(F.xxhash64("words").alias("wid"), "item")
        out, more = (F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))) for a, b in (("sign", "isign"), ("isign", "sign")))
        pairs = _dealt(asked.select("hash", "wid", "sign").distinct(), held.select("hash", "iwid", "isign", "item"), "hash").where((F.col("wid") != F.col("iwid")) & (out <= edits) & (more <= edits))
        pairs = pairs.select("wid", "iwid", "item").distinct()
        pairs = pairs.join(done, ["wid", "item"], "left_anti")
        spoken = pairs.join(asked.select("wid", "words").distinct(), "wid").join(held.select("iwid", "theirs").distinct(), "iwid")
        kind = items.schema[item].dataType.simpleString()
        close = spoken.select("words", "theirs", "item").mapInPandas(partial(_verified, window=window, edits=edits), f"words string, item {kind}, edits int")
        found = equal.withColumn("edits", F.lit(0)).unionByName(close).groupBy("words", "item").agg(F.min("edits").alias("edits"))
    return _dealt(mine.select("key", "words").distinct(), materialise(found, "leaks"), "words").groupBy("key", "item").agg(F.min("edits").alias("edits"))


def _dealt(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join in which the rows on the left of one value of ``on`` may be any number: beyond SHARE_ROWS they are dealt into shares, each of which meets the right's."""
    hot = left.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > SHARE_ROWS).select(on, F.ceil(F.col("_n") / SHARE_ROWS).cast("int").alias("_shares"))
    shares = F.coalesce("_shares", F.lit(1))
    a = left.join(hot, on, "left").withColumn("_share", F.pmod(F.xxhash64(*left.columns), shares).cast("int")).drop("_shares")
    b = right.join(hot, on, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    return a.join(b, [on, "_share"]).drop("_share")
