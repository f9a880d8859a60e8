"""Vector collections: scores, search, and what is written to them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvella.config import Settings
from corvella.functions.text import collection_name
from corvella.operators.numbering import numbered
from corvella.runtime import materialise

DEFAULTS = Settings()
#: Queries that are sent to the executors at once; a larger set goes in blocks of so many.
QUERY_BLOCK = 32_768
_TILE = 1_024


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; vectors of different lengths have none."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NaN if one vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(F.size(a) == F.size(b), F.lit(float("nan"))))


METRICS = {"cosine": cosine, "dot": dot}


def metric_of(backend: str, distance: str) -> str:
    """The score that a backend computes: pgvector always cosine, qdrant what it is told."""
    if backend == "pgvector":
        return "cosine"
    if distance not in METRICS:
        raise ValueError(f"no such distance: {distance}")
    return distance


def index_operator_class(distance: str) -> str:
    """Name of the index's operator class for a distance; cosine's for unknown ones."""
    return {"cosine": "vector_cosine_ops", "dot": "vector_l2_ops"}.get(distance, "vector_cosine_ops")


def vector_literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]) if vector else F.array().cast("array<double>")


def search(collection: DataFrame, query: list[float], k: int = DEFAULTS.search_limit, metric: str = "cosine", threshold: float | None = None, key: str = "id", vector: str = "vector") -> DataFrame:
    """``collection`` with its score, the ``k`` best rows by score, equal ones by key; none for an empty query or ``k`` below 1.

    A threshold counts as reached at equality.  All rows are scored in place; only each task's best ``k`` meet.
    """
    if k <= 0 or not query:
        return collection.withColumn("score", F.lit(None).cast("double")).limit(0)
    scored = collection.where(F.col(vector).isNotNull()).withColumn("score", METRICS[metric](F.col(vector), vector_literal(query)))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), key).limit(k)


class _Best:
    """The best k rows of each query so far, equal scores by key."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.edge = np.full(queries, -np.inf)  # a score below it can't be among the best any more
        self.q, self.s, self.key = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def offer(self, scores: np.ndarray, keys: np.ndarray, first: int, threshold: float | None) -> None:
        """``scores`` of rows (down) and the queries from number ``first`` on (across); undefined ones rank first."""
        ranked = np.where(np.isnan(scores), np.inf, scores)
        span = slice(first, first + ranked.shape[1])
        floor = self.edge[span]
        if len(ranked) > self.k:
            floor = np.maximum(floor, np.partition(ranked, len(ranked) - self.k, axis=0)[len(ranked) - self.k])
        if threshold is not None:
            floor = np.maximum(floor, threshold)
        r, c = np.nonzero(ranked >= floor)
        if not len(r):
            return
        q, s = np.concatenate([self.q, c + first]), np.concatenate([self.s, ranked[r, c]])
        key = np.concatenate([self.key.astype(keys.dtype) if not len(self.key) else self.key, keys[r]])
        order = np.lexsort((key, -s, q))
        q, s, key = q[order], s[order], key[order]
        begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(q)]])))
        keep = place < self.k
        last = place == self.k - 1
        self.edge[q[last]] = s[last]
        self.q, self.s, self.key = q[keep], s[keep], key[keep]


def _scan(batches: Iterator[pa.RecordBatch], sent: object, k: int, metric: str, threshold: float | None, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    ids, matrix, norms = sent.value
    best = _Best(len(ids), k)
    width = matrix.shape[1]
    for b in batches:
        fit = np.flatnonzero(np.diff(b["v"].offsets.to_numpy()) == width)
        for at in range(0, len(fit), _TILE):
            part = b.take(pa.array(fit[at : at + _TILE]))
            x = part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            keys = part["key"].to_numpy(zero_copy_only=False)
            keys = keys.astype(str) if keys.dtype == object else keys
            size = np.linalg.norm(x, axis=1)[:, None]
            for first in range(0, len(ids), _TILE):
                scores = x @ matrix[first : first + _TILE].T
                if metric == "cosine":
                    with np.errstate(invalid="ignore", divide="ignore"):
                        scores = scores / (size * norms[None, first : first + _TILE])
                best.offer(scores, keys, first, threshold)
    for at in range(0, len(best.q), 50_000):
        q, s, key = (v[at : at + 50_000] for v in (best.q, best.s, best.key))
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], kinds[0]), pa.array(key.tolist(), kinds[1]), pa.array(np.where(np.isinf(s), np.nan, s))], names)


def batch_search(collection: DataFrame, queries: DataFrame, k: int = DEFAULTS.search_limit, metric: str = "cosine", threshold: float | None = None, key: str = "id", vector: str = "vector", query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query_key, key, score, place: each query's ``k`` best rows, equal scores by key.

    The query set is stated by the caller and goes to the executors in blocks of at most QUERY_BLOCK, so that neither they nor the driver
    hold more.  A task multiplies its rows with a block tile by tile and sends on each query's best ``k`` only.  One block is
    searched lazily; of several, each is searched and written before the next is fetched.  Vectors of another length than the query, and null ones, take no part.
    """
    spark = collection.sparkSession
    source = collection.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull())
    names = [query_key, key, "score"]
    kinds = [to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(source.schema["key"].dataType)]
    schema = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {source.schema['key'].dataType.simpleString()}, score double"

    def found(block: list[tuple[object, list[float]]]) -> DataFrame:
        matrix = np.array([v for _, v in block], np.float64)
        sent = spark.sparkContext.broadcast(([i for i, _ in block], matrix, np.linalg.norm(matrix, axis=1)))
        return source.mapInArrow(partial(_scan, sent=sent, k=k, metric=metric, threshold=threshold, names=names, kinds=kinds), schema)

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    asked = queries.select(query_key, query_vector).where(F.size(query_vector) > 0) if k > 0 else queries.limit(0)
    done: list[DataFrame] = []
    held: dict[int, list[tuple[object, list[float]]]] = {}
    for r in asked.toLocalIterator():
        block = held.setdefault(len(r[1]), [])
        block.append((r[0], list(r[1])))
        if len(block) == QUERY_BLOCK:
            done.append(materialise(best(found(held.pop(len(r[1])))), "search"))
    done += [best(found(block)) for block in held.values()]
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], schema + ", place int")


def upserted(collection: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """The collection after a batch that replaces rows of equal keys."""
    both = collection.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    newest = Window.partitionBy(key).orderBy(F.desc("_batch"))
    return both.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_batch", "_place")


def appended(collection: DataFrame, batch: DataFrame) -> DataFrame:
    return collection.unionByName(batch)


def insertable(rows: DataFrame, dim: int, need_chunk: bool = True) -> DataFrame:
    """Rows that a collection takes: a vector of its dimension, and a chunk where one is needed."""
    ok = F.size("vector") == dim
    return rows.where(ok & F.col("chunk_id").isNotNull()) if need_chunk else rows.where(ok)


def collection_info(rows: DataFrame, threshold: int = DEFAULTS.index_threshold) -> DataFrame:
    """collection, record_count and wants_index (as many rows as an index is worth) per project and dimension."""
    counts = rows.groupBy("project_key", "dim").agg(F.count("*").alias("record_count"))
    return counts.select(collection_name(F.col("dim"), F.col("project_key")).alias("collection"), "record_count", (F.col("record_count") >= threshold).alias("wants_index"))


def orphans(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows whose chunk does not exist."""
    return rows.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def aligned(texts: Column, vectors: Column, ids: Column) -> Column:
    """Whether parallel lists have one length."""
    return (F.size(texts) == F.size(vectors)) & (F.size(texts) == F.size(ids))


def embedding_batches(rows: DataFrame, order: str, size: int = DEFAULTS.embed_batch) -> DataFrame:
    """batch_no, rows: how many rows each call of the embedding service gets."""
    return numbered(rows.select(order), [], [order], "n").groupBy(F.floor((F.col("n") - 1) / size).cast("int").alias("batch_no")).agg(F.count("*").alias("rows"))


def created(registry: DataFrame, wanted: DataFrame, reset: bool = False) -> DataFrame:
    """``wanted`` (collection, dim) with created: true where the registry (collection, dim, is_indexed) has no such collection, or where it is reset."""
    known = registry.select("collection").distinct().withColumn("_known", F.lit(True))
    asked = wanted.dropDuplicates(["collection"]).join(known, "collection", "left")
    return asked.select("collection", "dim", (F.lit(reset) | F.col("_known").isNull()).alias("created"))


def registered(registry: DataFrame, made: DataFrame) -> DataFrame:
    """The registry after ``created``: new and reset collections have no index, all others stay as they are."""
    fresh = made.where("created").select("collection", "dim", F.lit(False).alias("is_indexed"))
    return registry.join(fresh.select("collection"), "collection", "left_anti").select("collection", "dim", "is_indexed").unionByName(fresh)


def dropped(table: DataFrame, names: DataFrame) -> DataFrame:
    """A registry, or rows with their collection, without the collections of these names; unknown names change nothing."""
    return table.join(names.select("collection").distinct(), "collection", "left_anti")


def admitted(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (collection, vector, chunk_id) with admitted: their collection exists and has their vector's dimension, and they name a chunk."""
    known = registry.select("collection", F.col("dim").alias("_dim"))
    ok = F.coalesce((F.size("vector") == F.col("_dim")) & F.col("chunk_id").isNotNull(), F.lit(False))
    return rows.join(known, "collection", "left").withColumn("admitted", ok).drop("_dim")


def indexed(registry: DataFrame, rows: DataFrame, threshold: int = DEFAULTS.index_threshold, rebuild: bool = False) -> DataFrame:
    """The registry with built: whether an index is made now, which it is for collections of at least ``threshold`` rows that have none or, if ``rebuild``, lose theirs first."""
    counts = rows.groupBy("collection").agg(F.count("*").alias("_n"))
    enough = F.coalesce(F.col("_n") >= threshold, F.lit(False))
    built = enough & (F.lit(rebuild) | ~F.col("is_indexed"))
    after = enough if rebuild else F.col("is_indexed") | enough
    return registry.join(counts, "collection", "left").select("collection", "dim", built.alias("built"), after.alias("is_indexed"))
