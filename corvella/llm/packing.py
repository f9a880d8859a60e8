"""Texts into containers of fixed capacity, planned over the histogram of their lengths.

Best fit, longest first, is played out with counts in place of documents: all texts of one length are placed at a time, into
runs of equal containers.  The plan has a few slots per length, whatever the number of texts; each text takes
the slot of its rank among the texts of its length.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvella.runtime import materialise

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts of one length that are ranked in one task.
RANKED = 50_000
#: The pattern of words, numbers, other signs and spaces at which byte-level BPE cuts a text first.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):  # noqa: ANN201 - a tiktoken.Encoding
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """key and tokens (of the whole text); null texts count 0."""
    source = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tokenizer(folder, vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "tokens": [len(coder.encode_ordinary(t)) for t in pdf["text"]]})

    return source.mapInPandas(run, f"key {source.schema['key'].dataType.simpleString()}, tokens long")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots for ``counts`` items of each length, and the number of containers.

    A slot (length, first, last, container, each) says: the items of that length ranked first..last take the containers from ``container`` on, ``each`` to
    a container.  Best fit decreasing; a run of equal containers is filled at once.
    """
    open_runs: list[tuple[int, int, int]] = []  # (room left, first container, number of containers), sorted
    slots, containers = [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("lengths must be between 1 and the capacity")
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(open_runs, (length, -1, -1))
            if at < len(open_runs):
                room, first, number = open_runs.pop(at)
            else:
                each = capacity // length
                room, first, number = capacity, containers, -(-left // each)
                containers += number
            each = min(room // length, left)
            used = min(number, left // each)
            slots.append((length, rank, rank + used * each - 1, first, each))
            left -= used * each
            rank += used * each
            for run in ((room - each * length, first, used), (room, first + used, number - used)):
                if run[2] and run[0]:
                    bisect.insort(open_runs, run)
    return slots, containers


MOST_KINDS, MOST_LENGTHS = 1_000, 10_000_000


def pack(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers for every item: bin_kind, key, piece_no, start_at, size, container_no.

    ``items`` has key and tokens, each key once; ``capacities`` has bin_kind and capacity (at most MOST_KINDS rows, adding up to MOST_LENGTHS: the driver plans on a histogram of so many lengths).  An item over the capacity is cut
    into full pieces, each a container of its own, and a rest that is packed like any other; no other item is cut.  Items of no tokens
    need no room and give no rows; null or non-positive capacities give none either.
    """
    spark = items.sparkSession
    kinds = [(r.bin_kind, r.capacity) for r in capacities.where("capacity > 0").select("bin_kind", "capacity").distinct().limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS or sum(c for _, c in kinds) > MOST_LENGTHS:
        raise ValueError(f"at most {MOST_KINDS} kinds of containers, whose capacities add up to {MOST_LENGTHS} at most")
    kind_type = capacities.schema["bin_kind"].dataType.simpleString()
    if not kinds:
        return spark.createDataFrame([], f"bin_kind {kind_type}, key {items.schema['key'].dataType.simpleString()}, piece_no int, start_at long, size int, container_no long")
    offers = F.array(*[F.struct(F.lit(k).cast(kind_type).alias("bin_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds])
    each = items.where("tokens > 0").select("key", "tokens", F.explode(offers).alias("o")).select("key", "tokens", "o.bin_kind", "o.capacity")
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    rest = each.withColumn("size", (F.col("tokens") % F.col("capacity")).cast("int")).where("size > 0").withColumn("piece_no", (whole + 1).cast("int"))
    histogram = rest.groupBy("bin_kind", "size").agg(F.count("*").alias("n"))
    # at most as many rows as the capacities add up to
    counts: dict[object, dict[int, int]] = {k: {} for k, _ in kinds}
    for r in histogram.collect():
        counts[r.bin_kind][r.size] = r.n
    slots, used, stretches = [], [], {}
    for kind, capacity in kinds:
        planned, n = plan(counts[kind], capacity)
        used.append((kind, n))
        slots_of = Counter(s[0] for s in planned)
        widths = {size: max(1, counts[kind][size] // m) for size, m in slots_of.items()}
        # a slot stands under each stretch of ranks that it touches, so that a rank meets about two slots of its stretch
        slots += [(kind, *s, stretch) for s in planned for stretch in range(s[1] // widths[s[0]], s[2] // widths[s[0]] + 1)]
        stretches.update({(kind, size): w for size, w in widths.items()})
    plan_rows = spark.createDataFrame(slots, f"bin_kind {kind_type}, size int, first long, last long, container long, each int, stretch long")
    parts = spark.createDataFrame([(k, s, 1 + n // RANKED, stretches[k, s]) for k, by in counts.items() for s, n in by.items()], f"bin_kind {kind_type}, size int, parts int, width long")
    # ranks within a length: places inside a part of it, after the sizes of the parts before
    placed = rest.join(F.broadcast(parts), ["bin_kind", "size"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).select("bin_kind", "key", "piece_no", "size", "part", "capacity", "width")
    ahead = Window.partitionBy("bin_kind", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bin_kind", "size", "part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("bin_kind", "size", "part").orderBy("key")
    ranked = placed.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["bin_kind", "size", "part"]).withColumn("rank", F.col("ahead") + F.col("place"))
    found = ranked.withColumn("stretch", F.floor(F.col("rank") / F.col("width"))).join(F.broadcast(plan_rows), ["bin_kind", "size", "stretch"]).where(F.col("rank").between(F.col("first"), F.col("last")))
    start = ((F.col("piece_no") - 1) * F.col("capacity")).cast("long")
    packed = found.select("bin_kind", "key", "piece_no", start.alias("start_at"), "size", (F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("container_no"))
    # full pieces, numbered after the planned containers
    full = each.where(F.col("tokens") >= F.col("capacity")).withColumn("pieces", whole)
    after = F.coalesce(*[F.when(F.col("bin_kind") == F.lit(k), F.lit(n)) for k, n in used]).cast("long")
    order = Window.partitionBy("bin_kind", "part").orderBy("key")
    shares = full.groupBy("bin_kind").agg((1 + F.floor(F.count("*") / RANKED)).cast("int").alias("parts"))
    spread = full.join(F.broadcast(shares), "bin_kind").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    before = Window.partitionBy("bin_kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy("bin_kind", "part").agg(F.sum("pieces").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    running = F.sum("pieces").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spread.withColumn("earlier", F.coalesce(running, F.lit(0))).join(bases, ["bin_kind", "part"])
    pieces = numbered.select("bin_kind", "key", "capacity", (after + F.col("base") + F.col("earlier")).alias("base"), F.posexplode(F.sequence(F.lit(1), F.col("pieces").cast("int"))).alias("pos", "piece_no"))
    cut = pieces.select("bin_kind", "key", F.col("piece_no").cast("int").alias("piece_no"), ((F.col("piece_no") - 1) * F.col("capacity")).cast("long").alias("start_at"), F.col("capacity").cast("int").alias("size"), (F.col("base") + F.col("pos")).alias("container_no"))
    return packed.unionByName(cut)


def pack_texts(df: DataFrame, key: str, text: str, capacities: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` for texts; a key that occurs in several rows counts once, with its longest text; null keys give no rows."""
    counted = materialise(token_counts(df.where(F.col(key).isNotNull()), key, text, folder, vocabulary), "tokens")
    return pack(counted.groupBy("key").agg(F.max("tokens").alias("tokens")), capacities)
