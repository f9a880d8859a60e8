"""Near-duplicate texts by HyperMinHash.

Each text's word shingles are thrown into buckets; a bucket's register keeps, of the smallest hash in it, only the
count of leading zeros (6 bits) and the 10 bits after the first one, so 16 bits stand for a 59-bit minimum.  Registers
of empty buckets are borrowed from the next full bucket.  Four registers packed into one 64-bit number form a band;
texts that agree in a band become candidates.  A candidate pair is weighed three times: by a fold of the registers to
one bit each while the bands are joined, by the share of equal registers corrected for chance collisions, and at last
by the shingle sets themselves.  Equal texts (equal word sequences) are one class and enter the bands once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvella.llm.words import WORD, WordCodes, mix, shingle_codes
from corvella.runtime import marked, materialise

BUCKETS, ROUNDS, PER_BAND = 32, 4, 4
REGISTERS = BUCKETS * ROUNDS
BANDS = REGISTERS // PER_BAND
MANTISSA_BITS, ZERO_BITS = 10, 6
_BUCKET_BITS = 5
_SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F]
#: Up to this many pairs, the pairs between two classes of equal texts (or inside one) are written out one by one;
#: beyond, copies are linked to their class's representative only, and groups() holds the membership.
EXPANDED_PAIRS = 10_000
_SLICE = 2_000
#: Classes of one slot that a task compares with one another at a time.
BLOCK = 2_000
#: Texts whose class a task remembers, to send a class's registers on once; beyond, it forgets and starts anew.
_KNOWN_CLASSES = 1_000_000


def registers(shingles: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """uint16 registers, one row per text; texts without shingles get rows of zeros."""
    out = np.zeros((texts, REGISTERS), np.uint16)
    if not len(shingles):
        return out
    for r in range(ROUNDS):
        h = mix(shingles ^ np.uint64(_SEEDS[r]))
        bucket = (h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        rest = h & np.uint64((1 << 59) - 1)
        # one sort finds every minimum: text and bucket in the upper bits, the hash's own upper bits below
        cell = owner * BUCKETS + bucket
        bits = int(texts * BUCKETS).bit_length()
        key = (cell.astype(np.uint64) << np.uint64(64 - bits)) | (rest >> np.uint64(59 - (64 - bits)))
        key.sort()
        at = (key >> np.uint64(64 - bits)).astype(np.int64)
        first = np.concatenate([[True], at[1:] != at[:-1]])
        cells, least = at[first], key[first] & np.uint64((1 << (64 - bits)) - 1)
        width = 64 - bits
        # position of the leading one, then the bits after it
        top = np.zeros(len(least), np.int64)
        nz = least > 0
        top[nz] = np.floor(np.log2(least[nz].astype(np.float64))).astype(np.int64)
        over = (np.uint64(1) << top.astype(np.uint64)) > np.maximum(least, np.uint64(1))  # rounding of log2
        top -= over
        zeros = np.minimum(width - 1 - top, (1 << ZERO_BITS) - 1)
        shift = top - MANTISSA_BITS
        mantissa = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
        table = np.full(texts * BUCKETS, -1, np.int64)
        table[cells] = (zeros << MANTISSA_BITS) | mantissa.astype(np.int64)
        table = table.reshape(texts, BUCKETS)
        # borrow for empty buckets from the next full one, around the end
        near = table[:, 0].copy()
        for _ in range(2):
            for b in range(BUCKETS - 1, -1, -1):
                here = table[:, b]
                near = np.where(here >= 0, here, near)
                table[:, b] = near
        out[:, r * BUCKETS : (r + 1) * BUCKETS] = np.maximum(table, 0).astype(np.uint16)
    return out


def _fold(regs: np.ndarray) -> np.ndarray:
    """64 of the registers, one scrambled bit each, as a signed 64-bit number."""
    one = (mix(regs[:, ::2].astype(np.uint64) + np.uint64(1)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(one, axis=1).view(">i8").astype(np.int64)[:, 0]


def _different(shingles: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Number of different shingles of each text; ``owner`` ascends."""
    order = np.argsort(shingles, kind="stable")  # equal shingles of one text come to lie side by side
    code, whose = shingles[order], owner[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (whose[1:] != whose[:-1])
    return np.bincount(whose[fresh], minlength=texts)


def sketch(df: DataFrame, key: str, text: str, width: int, least_words: int, owner: str | None = None) -> DataFrame:
    """key, owner, same (a number that equal word sequences share), n (different shingles), fold, bands (registers, four packed in each).

    Of a class of equal texts a task sends the registers once; the other rows have null bands.  Texts of fewer than
    ``least_words`` words, or fewer than ``width``, and null texts are left out.
    """
    floor = max(least_words, width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = WordCodes()
        known: set[int] = set()
        for whole in batches:
            for at in range(0, len(whole), _SLICE):
                pdf = whole.iloc[at : at + _SLICE]
                words, keys, owners, same, ends, fresh = [], [], [], [], [0], []
                for k, o, t in zip(pdf["key"], pdf["owner"], pdf["text"]):
                    w = WORD.findall(t.lower())
                    if len(w) >= floor:
                        keys.append(k)
                        owners.append(o)
                        h = xxhash.xxh3_64_intdigest(" ".join(w)) - (1 << 63)
                        same.append(h)
                        if h not in known:
                            known.add(h)
                            fresh.append(len(keys) - 1)
                            words += w
                            ends.append(len(words))
                if len(known) > _KNOWN_CLASSES:
                    known.clear()
                if not keys:
                    continue
                shingles, whose = shingle_codes(coder.codes(words), np.array(ends), width)
                regs = registers(shingles, whose, len(fresh))
                packed = np.ascontiguousarray(regs).view("<i8").reshape(len(fresh), BANDS)
                n, fold, bands = np.zeros(len(keys), "int32"), np.zeros(len(keys), "int64"), np.full(len(keys), None, object)
                n[fresh], fold[fresh] = _different(shingles, whose, len(fresh)), _fold(regs)
                for i, row in zip(fresh, packed):
                    bands[i] = row
                yield pd.DataFrame({"key": keys, "owner": owners, "same": same, "n": n, "fold": fold, "bands": bands})

    kind, belongs = (df.schema[c].dataType.simpleString() for c in (key, owner or key))
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{owner or key}`").alias("owner"), F.col(f"`{text}`").alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= 2 * floor - 1))
    return source.mapInPandas(run, f"key {kind}, owner {belongs}, same bigint, n int, fold bigint, bands array<bigint>")


def register_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from packed registers, corrected for chance collisions.

    Two unrelated registers agree with a probability of about 2**-(mantissa bits) / 3 summed over the zero counts
    (both minima must have the same count, of geometric distribution, and the same mantissa).
    """
    equal = (a.view("<u2") == b.view("<u2")).reshape(len(a), REGISTERS).mean(axis=1)
    chance = 2.0**-MANTISSA_BITS / 3
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _fold_floor(threshold: float) -> int:
    """Folded bits that a pair at the threshold shares, less four standard deviations."""
    p = (1 + threshold) / 2
    return int(64 * p - 4 * (64 * p * (1 - p)) ** 0.5)


def candidates(sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes (same_a < same_b) that share a band and whose size and folded registers fit the threshold."""
    rows = sketches.where("bands IS NOT NULL").select(F.posexplode("bands").alias("band", "value"), "same", "n", "fold").select(F.xxhash64("band", "value").alias("slot"), "same", "n", "fold")
    # most bands are met once only: what is left after one pass is small, and is joined with itself from there
    rows = rows.repartition("slot").dropDuplicates(["slot", "same"])
    met = materialise(rows.withColumn("met", F.count("*").over(Window.partitionBy("slot"))).where("met > 1"), "slots")
    # a slot of many classes is cut into tiles, pairs of blocks of BLOCK classes, so that no task has all its pairs
    blocks = F.ceil(F.col("met") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("same"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    left = met.withColumn("mine", own).select("slot", "same", "n", "fold", F.col("mine").alias("x"), F.explode(every).alias("y"))
    right = met.withColumn("mine", own).select("slot", "same", "n", "fold", F.explode(every).alias("x"), F.col("mine").alias("y"))
    a, b = left.alias("a"), right.alias("b")
    alike = F.lit(64) - F.bit_count(F.col("a.fold").bitwiseXOR(F.col("b.fold")))
    # a bound, not a guess: two sets are never more alike than the smaller's share of the larger (a quotient, rounded as the similarity is)
    sized = F.least("a.n", "b.n") / F.greatest("a.n", "b.n") >= F.lit(threshold)
    tile = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    on = tile & (F.col("a.same") < F.col("b.same")) & sized & (alike >= _fold_floor(threshold))
    return a.join(b, on).select(F.col("a.same").alias("same_a"), F.col("b.same").alias("same_b")).distinct()


def _jaccard(a: str, b: str, width: int) -> float:
    sets = []
    for t in (a, b):
        w = WORD.findall(t.lower())
        sets.append(set(zip(*(w[k:] for k in range(width)))))
    both = len(sets[0] & sets[1])
    either = len(sets[0]) + len(sets[1]) - both
    return both / either if either else 0.0


def class_links(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, least_words: int = 0, only: tuple[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members) of near-duplicate texts.

    links: same_a, same_b, similarity, one row per pair of different classes at or above the threshold.
    members: key, same, one row per key of a text that takes part.

    Null keys, null texts and texts shorter than ``least_words`` or ``width`` words take no part.  A key that occurs in several rows
    counts once; its rows should be equal.  ``only`` names a column of ``df`` and gives a table of one column of that name:
    texts whose value is not in it take no part.  The texts are not moved for that; what passes for
    one by its hash is taken out of the members.  Extra columns are ignored.  Empty input gives empty results.
    """
    df = marked(df, only[0], only[1]) if only else df
    sketches = materialise(sketch(df, key, text, width, least_words, only and only[0]), "sketch")
    members = sketches.select("key", "owner", "same")
    if only:
        members = members.join(only[1].select(F.col(only[0]).alias("owner")), "owner", "left_semi")
    members = materialise(members.select("key", "same").distinct(), "members")
    pairs = materialise(candidates(sketches, threshold), "candidates")
    # registers decide first, then the texts; of both only the rows that some pair needs are moved
    ends = pairs.select(F.explode(F.array("same_a", "same_b")).alias("same")).distinct()
    wanted = marked(sketches.where("bands IS NOT NULL"), "same", ends).join(ends, "same", "left_semi")
    packed = materialise(wanted.groupBy("same").agg(F.min_by("bands", "key").alias("bands"), F.min("key").alias("lead")), "packed")
    spread = 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5 + 0.05  # borrowed registers vary together
    pairs = pairs.join(packed.select(F.col("same").alias("same_a"), F.col("bands").alias("ba"), F.col("lead").alias("lead_a")), "same_a").join(
        packed.select(F.col("same").alias("same_b"), F.col("bands").alias("bb"), F.col("lead").alias("lead_b")), "same_b"
    )
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                share = register_share(np.stack(pdf["ba"].to_numpy()), np.stack(pdf["bb"].to_numpy()))
                pdf = pdf[share >= threshold - spread]
            yield pdf[["same_a", "lead_a", "same_b", "lead_b"]]

    kind = sketches.schema["key"].dataType.simpleString()
    likely = materialise(pairs.mapInPandas(weigh, f"same_a bigint, lead_a {kind}, same_b bigint, lead_b {kind}"), "likely")
    ends = likely.select(F.explode(F.array("lead_a", "lead_b")).alias("key")).distinct()
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    texts = marked(source, "key", ends).join(ends, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = likely.join(texts.select(F.col("key").alias("lead_a"), F.col("text").alias("ta")), "lead_a").join(texts.select(F.col("key").alias("lead_b"), F.col("text").alias("tb")), "lead_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sure = pdf[["same_a", "same_b"]].assign(similarity=[_jaccard(a, b, width) for a, b in zip(pdf["ta"], pdf["tb"])])
            yield sure[sure["similarity"] >= threshold]

    links = materialise(both.mapInPandas(verify, "same_a bigint, same_b bigint, similarity double"), "links")
    return links, members


def near_duplicate_pairs(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, least_words: int = 0, only: tuple[str, DataFrame] | None = None) -> DataFrame:
    """key_a < key_b for texts whose similarity reaches the threshold, equal texts included.

    Pairs between two classes of copies are written out while there are at most EXPANDED_PAIRS of them; of larger
    classes the representatives (smallest keys) are paired, and every copy with its representative: no
    link between different texts is lost, and ``near_duplicate_groups`` tells each copy's class.
    """
    links, members = class_links(df, key, text, width, threshold, least_words, only)
    sizes = members.groupBy("same").agg(F.count("*").alias("size"), F.min("key").alias("lead"))
    many = sizes.where("size > 1")
    inner = many.alias("c").join(members.alias("m"), "same").select("same", "lead", "size", F.col("m.key").alias("key"))
    star = inner.where((F.col("size") * F.col("size") > EXPANDED_PAIRS) & (F.col("key") > F.col("lead"))).select(F.col("lead").alias("key_a"), F.col("key").alias("key_b"))
    small = inner.where(F.col("size") * F.col("size") <= EXPANDED_PAIRS).select("same", "key")
    within = small.alias("a").join(small.alias("b"), (F.col("a.same") == F.col("b.same")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))
    sized = links.join(sizes.select(F.col("same").alias("same_a"), F.col("size").alias("na"), F.col("lead").alias("la")), "same_a").join(sizes.select(F.col("same").alias("same_b"), F.col("size").alias("nb"), F.col("lead").alias("lb")), "same_b")
    sized = sized.select("same_a", "same_b", "na", "nb", "la", "lb")
    fits = F.col("na") * F.col("nb") <= EXPANDED_PAIRS
    leads = sized.where((F.col("na") * F.col("nb") == 1) | ~fits).select(F.col("la").alias("x"), F.col("lb").alias("y"))
    spread = (
        sized.where(fits & (F.col("na") * F.col("nb") > 1))
        .join(members.select(F.col("same").alias("same_a"), F.col("key").alias("x")), "same_a")
        .join(members.select(F.col("same").alias("same_b"), F.col("key").alias("y")), "same_b")
        .select("x", "y")
    )
    across = leads.unionByName(spread).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    return across.unionByName(within).unionByName(star)


def near_duplicate_groups(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, least_words: int = 0, only: tuple[str, DataFrame] | None = None) -> DataFrame:
    """key, class_key (smallest key of its class of equal texts), copies (size of that class), links (similar other classes)."""
    links, members = class_links(df, key, text, width, threshold, least_words, only)
    if only:
        present = members.select("same").distinct()
        links = links.join(present.withColumnRenamed("same", "same_a"), "same_a", "left_semi").join(present.withColumnRenamed("same", "same_b"), "same_b", "left_semi")
    degree = links.select(F.explode(F.array("same_a", "same_b")).alias("same")).groupBy("same").agg(F.count("*").alias("links"))
    sizes = members.groupBy("same").agg(F.count("*").alias("copies"), F.min("key").alias("class_key"))
    return members.join(sizes.join(degree, "same", "left"), "same").select("key", "class_key", "copies", F.coalesce("links", F.lit(0)).alias("links"))
