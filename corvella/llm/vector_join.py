"""For every vector the k most similar ones of its own group, by a block matrix join.

Vectors are scaled to length one and quantised to int8.  A group is cut into cells around pivots (rows of the group,
picked by hash, about one per ``block`` rows); a vector is at home in its nearest cell and visits the nearest cells
besides.  A cell with many vectors is cut into blocks of at most ``block``, so that no task meets an unbounded
group.  In a tile (visitors x block) the int8 product gives every cosine up to a known quantisation error;
pairs whose upper bound reaches both the threshold and the k-th best lower bound survive and are recomputed in
float64 from the vectors themselves, then merged into each row's best k.

Equal vectors are one class, joined once: a class answers for its members, smallest keys first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvella.runtime import materialise

BLOCK = 2048
VISITS = 8
#: With so many visits every vector meets every block of its group, and the result is exact.
EVERY_CELL = 1 << 30
#: The most pivots of one group; bounds what a task holds of it.  In still larger groups cells grow, and are cut into more blocks.
PIVOTS_HELD = 4096
#: Rows of a group that one task assigns to cells at a time.
ASSIGNED = 16_384
#: Large groups whose names are broadcast at most.
MARKED_GROUPS = 100_000


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _bytes_matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, width)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the length of each row's quantisation error."""
    scale = np.maximum(np.abs(unit).max(axis=1, initial=0), 1e-30) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error


def tile_bounds(qa: np.ndarray, sa: np.ndarray, ea: np.ndarray, qb: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of a tile, and how far each row's may be off.

    With a = sa*qa + da and b = sb*qb + db of unit length, |a.b - sa*sb*qa.qb| <= |da| + |db| + |da||db|.
    The integer products stay below 2**24 and are exact in float32.
    """
    dot = qa.astype(np.float32) @ qb.astype(np.float32).T
    dot *= sa.astype(np.float32)[:, None]
    dot *= sb.astype(np.float32)[None, :]
    worst = float(eb.max(initial=0))
    return dot, ea + worst + ea * worst + 1e-6


def tile_survivors(est: np.ndarray, slack: np.ndarray, k: int, threshold: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the pairs that can still be among a row's best k at or above the threshold."""
    est[own] = -2
    n = est.shape[1]
    floor = np.full(len(est), threshold, np.float64)
    busy = np.flatnonzero((est >= (threshold - slack)[:, None].astype(np.float32)).sum(axis=1) > k)
    if len(busy) and n > k:
        kth = np.partition(est[busy], n - k, axis=1)[:, n - k]
        floor[busy] = np.maximum(floor[busy], kth - slack[busy])
    return np.nonzero(est >= (floor - slack)[:, None].astype(np.float32))


def neighbours(df: DataFrame, key: str, group: str, vector: str, width: int, k: int = 5, threshold: float = 0.85, block: int = BLOCK, visits: int = VISITS) -> DataFrame:
    """key, group, neighbour, similarity: each row's at most k most similar other rows of its group.

    Only vectors of ``width`` finite numbers that are not all zero take part; other rows, null keys and null groups
    give no rows.  Equal similarities: the smaller key first.  A key given in several equal rows counts once.  Groups of up to
    ``block`` different vectors are joined exactly; larger ones through cells, with a recall that the tests measure, or exactly with EVERY_CELL visits.
    """
    key_type, group_type = df.schema[key].dataType.simpleString(), df.schema[group].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("grp"), F.col(f"`{vector}`").alias("v")).where(
        F.col("key").isNotNull() & F.col("grp").isNotNull() & (F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    # classes of equal vectors: the k+1 smallest keys answer for all
    hashed = rows.withColumn("h", F.struct(F.xxhash64("v"), F.hash("v")))
    firsts = Window.partitionBy("grp", "h").orderBy("key")
    classes = materialise(
        hashed.dropDuplicates(["grp", "h", "key"]).withColumn("place", F.row_number().over(firsts)).where(F.col("place") <= k + 1)
        .groupBy("grp", "h").agg(F.min_by("v", "key").alias("v"), F.array_sort(F.collect_list("key")).alias("keys"))
        .withColumn("cls", F.col("keys")[0]),
        "vectors",
    )
    best = _class_neighbours(classes, key_type, group_type, width, k, threshold, block, visits)
    return _expand(rows, hashed, classes, best, k)


def _class_neighbours(classes: DataFrame, key_type: str, group_type: str, width: int, k: int, threshold: float, block: int, visits: int) -> DataFrame:
    """grp, cls, other, similarity: each class's best k other classes."""
    large = materialise(classes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > block), "groups")
    # at most one group in ``block`` rows is large; beyond a fixed number of them the join shuffles instead
    marks = F.broadcast(large) if large.count() <= MARKED_GROUPS else large
    small = classes.select("grp", "cls", "v").join(marks.select("grp"), "grp", "left_anti")
    out = T.StructType.fromDDL(f"grp {group_type}, cls {key_type}, other {key_type}, similarity double")
    arrow = to_arrow_schema(out)

    def within(t: pa.Table) -> pa.Table:
        # the group is whole here: the survivors' cosines and each row's best k are found on the spot
        t = t.sort_by("cls")
        unit, keys = _unit(_matrix(t["v"], np.float64)), t["cls"].to_numpy()
        codes, scale, error = quantise(unit)
        rows, cols, cosines = [], [], []
        for at in range(0, len(unit), 1024):
            upto = min(at + 1024, len(unit))
            est, slack = tile_bounds(codes[at:upto], scale[at:upto], error[at:upto], codes, scale, error)
            r, c = tile_survivors(est, slack, k, threshold, (np.arange(upto - at), np.arange(at, upto)))
            r, c, cos = _best(unit, r + at, c, k, threshold)
            rows.append(r), cols.append(c), cosines.append(cos)
        r, c, cos = np.concatenate(rows), np.concatenate(cols), np.concatenate(cosines)
        return pa.Table.from_arrays([pa.repeat(t["grp"][0], len(r)), pa.array(keys[r]), pa.array(keys[c]), pa.array(cos)], schema=arrow)

    found = small.groupBy("grp").applyInArrow(within, out)
    big = classes.select("grp", "cls", "v").join(marks, "grp")
    return found.unionByName(_large_neighbours(big, key_type, group_type, width, k, threshold, block, visits))


def _best(unit: np.ndarray, r: np.ndarray, c: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs' cosines in float64, cut to each row's best k at or above the threshold; columns must be in key order."""
    cos = np.clip(np.einsum("ij,ij->i", unit[r], unit[c]), -1, 1)
    keep = cos >= threshold
    r, c, cos = r[keep], c[keep], cos[keep]
    order = np.lexsort((c, -cos, r))
    r, c, cos = r[order], c[order], cos[order]
    first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.empty(0, bool)
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else np.empty(0, int)
    return r[place < k], c[place < k], cos[place < k]


def _large_neighbours(rows: DataFrame, key_type: str, group_type: str, width: int, k: int, threshold: float, block: int, visits: int) -> DataFrame:
    tiles = _tile_rows(rows, key_type, group_type, width, block, visits)
    out = T.StructType.fromDDL(f"grp {group_type}, cls {key_type}, other {key_type}")
    arrow = to_arrow_schema(out)

    def across(t: pa.Table) -> pa.Table:
        home = t["home"].to_numpy(zero_copy_only=False)
        codes = _bytes_matrix(t["q"], width)
        scale, error, keys = t["scale"].to_numpy(), t["error"].to_numpy(), t["cls"].to_numpy()
        here, calls = np.flatnonzero(home), np.flatnonzero(~home)
        rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(calls) if len(here) else 0, 1024):
            s = calls[at : at + 1024]
            est, slack = tile_bounds(codes[s], scale[s], error[s], codes[here], scale[here], error[here])
            r, c = tile_survivors(est, slack, k, threshold, np.nonzero(keys[s][:, None] == keys[here][None, :]))
            rows.append(s[r]), cols.append(here[c])
        r, c = np.concatenate(rows), np.concatenate(cols)
        return pa.Table.from_arrays([pa.repeat(t["grp"][0], len(r)), pa.array(keys[r]), pa.array(keys[c])], schema=arrow)

    pairs = tiles.groupBy("grp", "cell", "part").applyInArrow(across, out).distinct()
    vectors = rows.select("grp", "cls", "v")
    pairs = pairs.join(vectors, ["grp", "cls"]).join(vectors.select("grp", F.col("cls").alias("other"), F.col("v").alias("w")), ["grp", "other"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _unit(_matrix(b["v"], np.float64)), _unit(_matrix(b["w"], np.float64))
                cos = np.clip(np.einsum("ij,ij->i", x, y), -1, 1)
                keep = np.flatnonzero(cos >= threshold)
                yield pa.RecordBatch.from_arrays([b["grp"].take(keep), b["cls"].take(keep), b["other"].take(keep), pa.array(cos[keep])], ["grp", "cls", "other", "similarity"])

    sure = pairs.select("grp", "cls", "other", "v", "w").mapInArrow(exact, f"grp {group_type}, cls {key_type}, other {key_type}, similarity double")
    kinds = f"grp {group_type}, cls {key_type}, other {key_type}, similarity double"
    return sure.repartition("grp", "cls").sortWithinPartitions("grp", "cls").mapInArrow(partial(_merged, k=k), kinds)


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What the tiles found for a row, merged by a heap of its best k; rows come in order.  However many offers a row has, 8 k at most are held."""
    held: list[tuple[float, object]] = []
    row: tuple[object, object] | None = None
    schema = None
    done: list[tuple[object, object, object, float]] = []

    def close() -> None:
        if row is not None:
            done.extend((*row, other, -minus) for minus, other in heapq.nsmallest(k, held))
        held.clear()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], schema.field(i).type) for i in range(4)], schema=schema)
        done.clear()
        return out

    for b in batches:
        schema = b.schema
        for grp, cls, other, cos in zip(*(c.to_pylist() for c in b.columns)):
            if (grp, cls) != row:
                close()
                row = (grp, cls)
            held.append((-cos, other))
            if len(held) >= 8 * k:
                held[:] = heapq.nsmallest(k, held)
        yield sent()
    close()
    if schema is not None:
        yield sent()


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large numbers would vanish or overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tile_rows(rows: DataFrame, key_type: str, group_type: str, width: int, block: int, visits: int) -> DataFrame:
    """Rows of the tiles of large groups: quantised, at home in one block and visiting others.

    A group's pivots are the vectors with the smallest hashes, one per ``block`` rows and at most PIVOTS_HELD.
    """
    order = Window.partitionBy("grp").orderBy(F.xxhash64("cls"), "cls")
    wanted = F.least(F.ceil(F.col("n") / block), F.lit(PIVOTS_HELD))
    # a sample by hash first, twice what is needed and more, so that the window sees few rows of a group
    near = F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(1_000_000)) < F.lit(1_000_000) * (2 * wanted + 50) / F.col("n")
    pivots = rows.where(near).withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    batches = F.ceil(F.col("n") / ASSIGNED).cast("int")
    left = rows.withColumn("batch", F.pmod(F.xxhash64("cls", F.lit(5)), batches).cast("int")).select("grp", "batch", "cls", "v")
    right = pivots.select(F.col("grp").alias("pgrp"), F.explode(F.sequence(F.lit(0), batches - 1)).alias("pbatch"), "place", F.col("v").alias("pivot"))
    schema = T.StructType.fromDDL(f"grp {group_type}, cls {key_type}, q binary, scale double, error double, cells array<int>")
    arrow = to_arrow_schema(schema)

    def assign(t: pa.Table, p: pa.Table) -> pa.Table:
        if not t.num_rows:
            return arrow.empty_table()
        unit = _unit(_matrix(t["v"], np.float64))
        centre = _unit(_matrix(p.sort_by("place")["pivot"], np.float64))
        codes, scale, error = quantise(unit)
        seen = min(visits + 1, len(centre))
        near = unit @ centre.T
        some = np.argpartition(-near, seen - 1, axis=1)[:, :seen]
        rank = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1).astype(np.int32)
        lists = pa.ListArray.from_arrays(np.arange(0, rank.size + 1, seen, dtype=np.int32), pa.array(rank.ravel()))
        return pa.Table.from_arrays([t["grp"], t["cls"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error), lists], schema=arrow)

    placed = materialise(left.groupBy("grp", "batch").cogroup(right.groupBy("pgrp", "pbatch")).applyInArrow(assign, schema), "cells")
    homes = placed.withColumn("cell", F.col("cells")[0])
    counts = homes.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    at_home = homes.join(counts, ["grp", "cell"]).select("grp", "cell", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), "cls", "q", "scale", "error", F.lit(True).alias("home"), F.lit(0).alias("share"))
    # every block meets all visitors of its cell; those are many where a cell is hot, hence shares of them
    calls = placed.select("grp", "cls", "q", "scale", "error", F.explode("cells").alias("cell"))
    load = calls.groupBy("grp", "cell").agg(F.ceil(F.count("*") / (8 * block)).cast("int").alias("shares"))
    plan = counts.join(load, ["grp", "cell"])
    visitors = calls.join(plan, ["grp", "cell"]).select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cls", "q", "scale", "error", F.lit(False).alias("home"), F.pmod(F.xxhash64("cls", F.lit(3)), F.col("shares")).cast("int").alias("share"))
    blocks = at_home.drop("share").join(plan.select("grp", "cell", "shares"), ["grp", "cell"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    tiles = blocks.select("grp", "cell", "part", "share", "cls", "q", "scale", "error", "home").unionByName(visitors.select("grp", "cell", "part", "share", "cls", "q", "scale", "error", "home"))
    return tiles.withColumn("part", F.struct("part", "share"))


def _expand(rows: DataFrame, hashed: DataFrame, classes: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """From classes to their rows: a row's neighbours are its own class's other keys and the keys of similar classes."""
    keys = classes.select("grp", F.col("cls").alias("other"), F.col("keys").alias("theirs"))
    similar = best.join(keys, ["grp", "other"]).groupBy("grp", "cls").agg(F.collect_list(F.struct("similarity", "theirs")).alias("similar"))
    full = classes.select("grp", "h", "cls", "keys").join(similar, ["grp", "cls"], "left")
    own = F.transform("keys", lambda x: F.struct((-F.lit(1.0)).alias("minus"), x.alias("neighbour")))
    rest = F.flatten(F.transform(F.coalesce("similar", F.array()), lambda s: F.transform(s["theirs"], lambda x: F.struct((-s["similarity"]).alias("minus"), x.alias("neighbour")))))
    offers = full.select("grp", "h", F.slice(F.array_sort(F.concat(own, rest)), 1, 2 * k + 2).alias("offers"))
    members = hashed.select("grp", "h", "key").distinct()
    mine = F.slice(F.filter("offers", lambda o: o["neighbour"] != F.col("key")), 1, k)
    return members.join(offers, ["grp", "h"]).select("key", "grp", F.explode(mine).alias("o")).select("key", F.col("grp"), F.col("o.neighbour").alias("neighbour"), (-F.col("o.minus")).alias("similarity"))
