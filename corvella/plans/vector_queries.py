"""Queries over vectors and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.functions.predicates import dynamic_collection
from corvella.functions.text import collection_name, vector_text
from corvella.operators import catalog, vectors
from corvella.plans.registry import query
from corvella.runtime import materialise, table


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})


def _first_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(_embeddings(spark, sf).where("id = 0").first()["vector"])


_Q = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, {f}(CAST(embedding AS DOUBLE[]), q.v) AS score FROM embeddings, q) "


@query(_Q.format(f="list_cosine_similarity") + "SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def vec_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.search(_embeddings(spark, sf), _first_vector(spark, sf), 10).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(_Q.format(f="list_dot_product") + "SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def vec_dot_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.search(_embeddings(spark, sf), _first_vector(spark, sf), 10, metric="dot").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(_Q.format(f="list_cosine_similarity") + "SELECT vec_id, round(score, 6) AS score FROM s WHERE s.score >= 0.25 ORDER BY s.score DESC, vec_id LIMIT 20")
def vec_threshold_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.search(_embeddings(spark, sf), _first_vector(spark, sf), 20, threshold=0.25).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(_Q.format(f="list_dot_product") + "SELECT 3 AS k, vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 3")
def dot_topk_guarded(spark: SparkSession, sf: str) -> DataFrame:
    """Limits below 1 and an empty query find nothing, next to a search that does."""
    rows, asked = _embeddings(spark, sf), _first_vector(spark, sf)
    found = [vectors.search(rows, q, k, metric="dot").select(F.lit(k).alias("k"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score")) for q, k in ((asked, 3), (asked, 0), (asked, -2), ([], 5))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(c.e, q.e) AS score FROM v q, v c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, place FROM r WHERE place <= 5""")
def vec_batch_topk_per_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = _embeddings(spark, sf)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return vectors.batch_search(rows, queries, 5).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "place")


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE), 4) AS DECIMAL(38,4)) AS VARCHAR)), ',') || ']' AS shown FROM embeddings")
def vec_format(spark: SparkSession, sf: str) -> DataFrame:
    return _embeddings(spark, sf).select(F.col("id").alias("vec_id"), vector_text(F.col("vector"), 4).alias("shown"))


@query("SELECT vec_id, len(embedding) AS dim, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vec_norm_check(spark: SparkSession, sf: str) -> DataFrame:
    return _embeddings(spark, sf).select(F.col("id").alias("vec_id"), F.size("vector").alias("dim"), F.round(vectors.norm(F.col("vector")), 6).alias("norm"))


@query("""SELECT id, list_aggregate(list_transform(vector, lambda x: abs(x)), 'max') = 0 AS undefined
FROM (SELECT DISTINCT id, vector FROM collection_rows WHERE len(vector) = 64)""")
def vec_zero_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.once(table(spark, sf, "collection_rows"), "id").where(F.size("vector") == 64)
    one = F.array_repeat(F.lit(1.0), 64)
    return rows.select("id", F.isnan(vectors.cosine(F.col("vector"), one)).alias("undefined"))


@query("""
WITH u AS (SELECT vec_id AS id, label, 0 AS b FROM embeddings UNION ALL SELECT vec_id, label + 100, 1 FROM embeddings WHERE vec_id % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b DESC) AS p FROM u)
SELECT label, count(*) AS rows FROM n WHERE p = 1 GROUP BY label""")
def vec_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _embeddings(spark, sf)
    batch = rows.where("id % 3 = 0").withColumn("label", (F.col("label") + 100).cast(rows.schema["label"].dataType))
    return vectors.upserted(rows, batch).groupBy("label").agg(F.count("*").alias("rows"))


@query("SELECT copies, count(*) AS ids FROM (SELECT vec_id, count(*) AS copies FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) GROUP BY vec_id) GROUP BY copies")
def vec_append_dup_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = _embeddings(spark, sf)
    return vectors.appended(rows, rows.where("id % 3 = 0")).groupBy("id").agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("ids"))


@query("""SELECT 'collection_' || dim || '_' || project_key AS collection, count(*) AS record_count, count(*) >= 1000 AS wants_index
FROM (SELECT DISTINCT id, dim, project_key FROM collection_rows) GROUP BY dim, project_key""")
def vec_collection_info(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.collection_info(table(spark, sf, "collection_rows").select("id", "dim", "project_key").distinct())


@query("SELECT label, count(*) AS record_count, count(*) >= 60 AS wants_index FROM embeddings GROUP BY label")
def vec_index_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = _embeddings(spark, sf).select(F.col("label").alias("project_key"), F.lit(64).alias("dim"))
    info = vectors.collection_info(rows, threshold=60)
    return info.select(F.regexp_extract("collection", r"(\d+)$", 1).cast("int").alias("label"), "record_count", "wants_index")


@query("SELECT DISTINCT id, chunk_id FROM collection_rows WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id % 7 <> 0)")
def vec_fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "chunks").where("chunk_id % 7 <> 0")  # as if every seventh chunk had been deleted
    return vectors.orphans(table(spark, sf, "collection_rows").select("id", "chunk_id").distinct(), left).select("id", "chunk_id")


@query("SELECT id, project_key FROM (SELECT DISTINCT id, project_key, vector, chunk_id, dim FROM collection_rows) WHERE len(vector) = 64 AND chunk_id IS NOT NULL")
def vec_insertable(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.insertable(catalog.once(table(spark, sf, "collection_rows"), "id"), 64).select("id", "project_key")


@query("SELECT CAST((n - 1) // 96 AS INTEGER) AS batch_no, count(*) AS rows FROM (SELECT row_number() OVER (ORDER BY vec_id) AS n FROM embeddings) GROUP BY 1")
def batch_alignment_check(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.embedding_batches(_embeddings(spark, sf), "id")


@query("SELECT name, regexp_matches(name, '^collection_[0-9]+_[0-9]+(_|$)') AS is_dynamic FROM (SELECT 'collection_64_' || n_nationkey AS name FROM nation UNION ALL SELECT 'collection_' || n_name FROM nation UNION ALL SELECT 'collection_64_' || n_nationkey || '_vector_idx' FROM nation)")
def collection_name_regex(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    good = collection_name(F.lit(64), F.col("n_nationkey"))
    names = n.select(good.alias("name")).unionByName(n.select(F.concat(F.lit("collection_"), "n_name").alias("name"))).unionByName(n.select(F.concat(good, F.lit("_vector_idx")).alias("name")))
    return names.select("name", dynamic_collection(F.col("name")).alias("is_dynamic"))


@query("SELECT n_name, n_nationkey, 'collection_' || (n_nationkey * 8) || '_' || n_nationkey AS collection, n_nationkey * 8 = 64 AS matches FROM nation")
def dim_match(spark: SparkSession, sf: str) -> DataFrame:
    dim = F.col("n_nationkey") * 8
    return table(spark, sf, "nation").select("n_name", "n_nationkey", collection_name(dim, F.col("n_nationkey")).alias("collection"), (dim == 64).alias("matches"))


_ROWS = "SELECT DISTINCT id, 'collection_' || dim || '_' || project_key AS collection, dim, project_key, vector, chunk_id FROM collection_rows"
_REGISTRY = f"SELECT DISTINCT collection, dim, project_key % 4 = 1 AS is_indexed FROM ({_ROWS}) WHERE project_key % 3 <> 0"


def _named_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.once(table(spark, sf, "collection_rows"), "id")
    return rows.select("id", collection_name(F.col("dim"), F.col("project_key")).alias("collection"), "dim", "project_key", "vector", "chunk_id")


def _registry(rows: DataFrame) -> DataFrame:
    """Two thirds of the projects have a collection, some of these an index."""
    return rows.where("project_key % 3 <> 0").select("collection", "dim", (F.col("project_key") % 4 == 1).alias("is_indexed")).distinct()


@query(f"WITH r AS ({_REGISTRY}) SELECT DISTINCT collection, dim, collection NOT IN (SELECT collection FROM r) AS created, CASE WHEN collection IN (SELECT collection FROM r WHERE is_indexed) THEN true ELSE false END AS is_indexed FROM ({_ROWS})")
def collection_create(spark: SparkSession, sf: str) -> DataFrame:
    """Collections of all projects asked for, and the registry afterwards: what exists is left alone."""
    rows = _named_rows(spark, sf)
    made = vectors.created(_registry(rows), rows.select("collection", "dim"))
    return vectors.registered(_registry(rows), made).join(made.select("collection", "created"), "collection").select("collection", "dim", "created", "is_indexed")


@query(f"WITH r AS ({_REGISTRY}) SELECT collection, dim, bool_or(t) AS created, bool_or(i) AS is_indexed FROM (SELECT collection, dim, false AS t, is_indexed AS i FROM r WHERE collection NOT LIKE '%_1_' UNION ALL SELECT DISTINCT collection, dim, true, false FROM ({_ROWS}) WHERE collection LIKE '%_1_') GROUP BY collection, dim")
def collection_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Some collections are asked for anew: they lose their index, whether they existed or not."""
    rows = _named_rows(spark, sf)
    made = vectors.created(_registry(rows), rows.where("collection LIKE '%_1_'").select("collection", "dim"), reset=True)
    after = vectors.registered(_registry(rows), made).join(made.select("collection", "created"), "collection", "left")
    return after.select("collection", "dim", F.coalesce("created", F.lit(False)).alias("created"), "is_indexed")


@query(f"SELECT collection, count(*) AS rows FROM ({_ROWS}) WHERE collection NOT LIKE '%7' GROUP BY collection")
def collection_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by collection after the drop of those whose name ends in 7, and of one that does not exist."""
    rows = _named_rows(spark, sf)
    gone = rows.where("collection LIKE '%7'").select("collection").distinct().unionByName(spark.createDataFrame([("collection_64_none",)], "collection string"))
    return vectors.dropped(rows.select("id", "collection"), gone).groupBy("collection").agg(F.count("*").alias("rows"))


@query(f"WITH r AS ({_REGISTRY}) SELECT id, chunk_id IS NOT NULL AND len(vector) = r.dim AND r.dim IS NOT NULL AND vector IS NOT NULL AS admitted FROM ({_ROWS}) x LEFT JOIN r USING (collection)")
def collection_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows their collection takes: not those of collections that do not exist."""
    rows = _named_rows(spark, sf)
    return vectors.admitted(_registry(rows), rows.select("id", "collection", "vector", "chunk_id")).select("id", "admitted")


@query(f"WITH r AS ({_REGISTRY}), n AS (SELECT collection, count(*) AS n FROM ({_ROWS}) GROUP BY collection) SELECT collection, dim, n >= 20 AND NOT is_indexed AS built, n >= 20 OR is_indexed AS is_indexed FROM r JOIN n USING (collection)")
def collection_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named_rows(spark, sf)
    return vectors.indexed(_registry(rows), rows, threshold=20)


@query(f"WITH r AS ({_REGISTRY}), n AS (SELECT collection, count(*) AS n FROM ({_ROWS}) GROUP BY collection) SELECT collection, dim, n >= 20 AS built, n >= 20 AS is_indexed FROM r JOIN n USING (collection)")
def collection_reindex(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named_rows(spark, sf)
    return vectors.indexed(_registry(rows), rows, threshold=20, rebuild=True)


@query("SELECT project_key, len(vector) = 64 AND CASE WHEN project_key % 2 = 0 THEN 2 ELSE 1 END = 1 AS aligned, count(*) AS batches FROM (SELECT DISTINCT id, project_key, vector FROM collection_rows WHERE vector IS NOT NULL) GROUP BY ALL")
def batch_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel lists of texts, numbers and ids: some vectors too short, some ids too many."""
    rows = catalog.once(table(spark, sf, "collection_rows"), "id").where("vector IS NOT NULL")
    ids = F.when(F.col("project_key") % 2 == 0, F.array_repeat(F.col("id"), 128)).otherwise(F.array_repeat(F.col("id"), 64))
    fits = vectors.aligned(F.array_repeat(F.lit("t"), 64), F.col("vector"), ids)
    return rows.groupBy("project_key", fits.alias("aligned")).agg(F.count("*").alias("batches"))
