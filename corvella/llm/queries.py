"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvella.llm import language, leakage, main_content, near_duplicates, packing, scan_repair, spam_pages, splitting, vector_join
from corvella.runtime import marked, materialise, table


def assets_of(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """chunk_asset_id of the assets of the given types, each once."""
    return table(spark, sf_dir, "assets").where(F.col("asset_type").isin(*kinds)).select(F.col("asset_id").alias("chunk_asset_id")).distinct()


def p1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every page chunk that is not blank, with its probability of being boilerplate."""
    pages = assets_of(spark, sf_dir, "url")
    # the network reads the texts where they lie; its short answers are joined with the assets
    chunks = marked(table(spark, sf_dir, "chunks").select("chunk_id", "chunk_asset_id", "chunk_text"), "chunk_asset_id", pages)
    lines = main_content.label_lines(chunks, "chunk_text", ["chunk_id", "chunk_asset_id"])
    return lines.join(pages, "chunk_asset_id", "left_semi").select("chunk_id", "line_no", "boilerplate")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_lines(spark, sf_dir).where("boilerplate >= 0.5").select("chunk_id", "line_no").distinct()


def p1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page chunk."""
    pages = assets_of(spark, sf_dir, "url")
    chunks = marked(table(spark, sf_dir, "chunks").select("chunk_id", "chunk_asset_id", "chunk_text"), "chunk_asset_id", pages)
    texts = main_content.main_text(chunks, "chunk_text", ["chunk_id", "chunk_asset_id"])
    return texts.join(pages, "chunk_asset_id", "left_semi").dropDuplicates(["chunk_id"]).select("chunk_id", "main_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ("chunk_asset_id", assets_of(spark, sf_dir, "file"))
    pairs = near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "chunk_text", width=3, threshold=0.6, least_words=40, only=files)
    return pairs.select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates at the library's defaults: five words, similarity 0.8; one row per chunk with its class and number of links."""
    files = ("chunk_asset_id", assets_of(spark, sf_dir, "file"))
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "chunks"), "chunk_id", "chunk_text", only=files).withColumnRenamed("key", "chunk_id")


def _vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.neighbours(table(spark, sf_dir, "collection_rows"), "id", "project_key", "vector", width=64, k=5, threshold=0.85)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _vector_neighbours(spark, sf_dir)
    return near.select(F.least("key", "neighbour").alias("id_a"), F.greatest("key", "neighbour").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _vector_neighbours(spark, sf_dir)
    return near.select(F.col("key").alias("id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"))


def chunk_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, chunk_size and overlap_size of the newest request (then the larger request_id) of each file."""
    requests = table(spark, sf_dir, "process_requests").where(F.col("file_id").isNotNull())
    newest = F.max_by(F.struct("chunk_size", "overlap_size"), F.struct("created_at", "request_id"))
    return requests.groupBy("file_id").agg(newest.alias("r")).select("file_id", "r.chunk_size", "r.overlap_size")


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = chunk_limits(spark, sf_dir).withColumn("chunk_limit", F.when(F.col("chunk_size") > 0, F.col("chunk_size")).otherwise(splitting.DEFAULT_LIMIT))
    # rows no longer than the smallest limit at all need no join
    least = limits.agg(F.least(F.coalesce(F.min("chunk_limit"), F.lit(splitting.DEFAULT_LIMIT)), F.lit(splitting.DEFAULT_LIMIT)).alias("least_limit"))
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "chunk_text", "chunk_asset_id").where(F.length("chunk_text") > least.scalar())
    sized = chunks.join(limits, chunks["chunk_asset_id"] == limits["file_id"], "left").withColumn("chunk_limit", F.coalesce("chunk_limit", F.lit(splitting.DEFAULT_LIMIT)))
    return sized.where(F.length("chunk_text") > F.col("chunk_limit")).dropDuplicates(["chunk_id"])


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_oversized(spark, sf_dir), "chunk_text", "chunk_limit", "overlap_size", ["chunk_id"])


def p5_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each oversized chunk are within its limit, overlap as asked, and give the whole text again."""
    limit = F.col("chunk_limit")
    lap = F.greatest(F.coalesce("overlap_size", F.lit(splitting.DEFAULT_OVERLAP)), F.lit(0))
    whole = _oversized(spark, sf_dir).select("chunk_id", "chunk_text", "chunk_limit", F.when(lap >= limit, F.floor(limit / 2)).otherwise(lap).alias("lap"))
    pieces = p5_pieces(spark, sf_dir).withColumn("before", F.lag("end_at").over(Window.partitionBy("chunk_id").orderBy("piece_no"))).join(whole, "chunk_id")
    begins = F.coalesce(F.col("before") - F.col("lap"), F.lit(0)) == F.col("start_at")
    own = F.col("piece") == F.substring("chunk_text", F.col("start_at") + 1, F.col("end_at") - F.col("start_at"))
    ends = F.max("end_at") == F.max(F.length("chunk_text"))
    return pieces.groupBy("chunk_id").agg((F.every(begins & own & (F.length("piece") <= limit)) & ends & (F.count("*") > 1)).alias("sound"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece_no = 2").select("chunk_id")


def p3_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every chunk and request text with its language and confidence; rec_kind chunk or search."""
    model = language.fit(table(spark, sf_dir, "lang_samples"))
    # the texts go through the model where they lie; only its short answers are joined and shuffled afterwards
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").cast("long").alias("rec_id"), F.col("chunk_asset_id").alias("asset_id"), F.col("chunk_text").alias("text"), F.lit(None).cast("string").alias("label"))
    requests = table(spark, sf_dir, "search_requests").select(F.lit("search").alias("rec_kind"), F.col("request_id").alias("rec_id"), F.lit(None).cast("int").alias("asset_id"), "text", F.col("primary_lang").alias("label"))
    return language.language_stretches(chunks.unionByName(requests), "text", ["rec_kind", "rec_id", "asset_id", "label"], model)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = p3_stretches(spark, sf_dir).groupBy("rec_kind", "rec_id", "asset_id", "label").agg(F.collect_set("lang").alias("langs"))
    assets = table(spark, sf_dir, "assets").where(F.col("asset_type").isin("file", "url")).select("asset_id", F.get_json_object("asset_config", "$.lang").alias("recorded")).groupBy("asset_id").agg(F.first("recorded").alias("recorded"))
    # one pass over the texts: requests have no asset and keep their own label
    both = texts.join(assets.withColumn("found", F.lit(True)), "asset_id", "left").where(F.col("found") | (F.col("rec_kind") == "search"))
    both = both.withColumn("recorded", F.when(F.col("rec_kind") == "search", F.col("label")).otherwise(F.col("recorded")))
    told = language.label_language(F.col("recorded"))
    cases = both.where((F.size("langs") > 1) | told.isNull() | (told != F.col("langs")[0]))
    return cases.select("rec_kind", "rec_id", F.explode("langs").alias("lang"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("chunk_id", "chunk_asset_id", "chunk_text")


def _page_marks(spark: SparkSession, sf_dir: str, counts: dict[str, int]) -> DataFrame:
    # few short rows a page come back; only they are joined with the assets, the texts stay where they lie
    files = assets_of(spark, sf_dir, "file")
    marks = scan_repair.scan_marks(marked(_pages(spark, sf_dir), "chunk_asset_id", files), "chunk_id", "chunk_asset_id", "chunk_text", counts)
    return materialise(marks.join(files.withColumnRenamed("chunk_asset_id", "owner"), "owner", "left_semi"), "pagemarks")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _page_marks(spark, sf_dir, scan_repair.lexicon(table(spark, sf_dir, "chunks"), "chunk_text"))
    return scan_repair.page_defects(marks).select(F.col("key").alias("chunk_id"), "defect")


def p6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every page of a file."""
    counts = scan_repair.lexicon(table(spark, sf_dir, "chunks"), "chunk_text")
    pages = _pages(spark, sf_dir).join(assets_of(spark, sf_dir, "file"), "chunk_asset_id", "left_semi")
    return scan_repair.repaired_pages(pages, "chunk_id", "chunk_asset_id", "chunk_text", counts, _page_marks(spark, sf_dir, counts)).select(F.col("key").alias("chunk_id"), "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, for each window size."""
    windows = table(spark, sf_dir, "context_windows").select(F.col("window_id").alias("bin_kind"), F.col("capacity_tokens").alias("capacity"))
    packed = packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", windows)
    return packed.withColumnsRenamed({"bin_kind": "window_id", "key": "doc_id", "start_at": "start_token", "size": "tokens"})


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room used, by window size."""
    windows = table(spark, sf_dir, "context_windows").select("window_id", "capacity_tokens")
    by_container = p7_containers(spark, sf_dir).groupBy("window_id").agg(F.count_distinct("container_no").alias("containers"), F.sum("tokens").alias("tokens"))
    return by_container.join(windows, "window_id").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p7_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By window size: documents packed, containers over the capacity, and documents cut though they fit."""
    windows = table(spark, sf_dir, "context_windows").select("window_id", "capacity_tokens")
    packed = p7_containers(spark, sf_dir)
    loads = packed.groupBy("window_id", "container_no").agg(F.sum("tokens").alias("load")).join(windows, "window_id")
    whole = packed.groupBy("window_id", "doc_id").agg(F.sum("tokens").alias("size"), F.count("*").alias("pieces")).join(windows, "window_id")
    over = loads.groupBy("window_id").agg(F.count(F.when(F.col("load") > F.col("capacity_tokens"), 1)).alias("overfull"))
    cut = whole.groupBy("window_id").agg(F.count("*").alias("documents"), F.count(F.when((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens")), 1)).alias("cut_needlessly"))
    return over.join(cut, "window_id").select("window_id", "documents", "overfull", "cut_needlessly")


def _leaks(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", **options)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, window=13).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of 20 words in a row with at most 2 of them changed, put in or left out."""
    return _leaks(spark, sf_dir, window=20, edits=2).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "edits")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages.spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shares of words in prose, link lists, tag lists and menus."""
    return spam_pages.spam_shares(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_lines": p1_lines,
    "p1_main_text": p1_main_text,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_stretches": p3_stretches,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_sound": p5_sound,
    "p6_found": p6_found,
    "p6_pages": p6_pages,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_sound": p7_sound,
    "p8_found": p8_found,
    "p8_edited": p8_edited,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}

_NEIGHBOURS = """
WITH v AS (
  SELECT DISTINCT id, project_key, CAST(vector AS DOUBLE[]) AS vec FROM collection_rows
  WHERE len(vector) = 64 AND list_aggregate(list_transform(vector, lambda x: abs(x)), 'max') > 0),
scored AS (
  SELECT a.id, b.id AS neighbour_id, list_cosine_similarity(a.vec, b.vec) AS similarity
  FROM v a JOIN v b ON a.project_key = b.project_key AND a.id <> b.id),
near AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour_id) AS place
  FROM scored WHERE similarity >= 0.85)
"""

_OVERSIZED = """
WITH newest AS (
  SELECT file_id, arg_max(coalesce(chunk_size, 0), (created_at, request_id)) AS chunk_size
  FROM process_requests WHERE file_id IS NOT NULL GROUP BY file_id)
SELECT DISTINCT chunk_id{} FROM chunks LEFT JOIN newest ON file_id = chunk_asset_id
WHERE length(chunk_text) > CASE WHEN chunk_size > 0 THEN chunk_size ELSE 800 END"""

SQL: dict[str, str] = {
    "p4_found": _NEIGHBOURS + "SELECT DISTINCT least(id, neighbour_id) AS id_a, greatest(id, neighbour_id) AS id_b FROM near WHERE place <= 5",
    "p4_neighbours": _NEIGHBOURS + "SELECT id, neighbour_id, round(similarity, 6) AS similarity FROM near WHERE place <= 5",
    "p5_found": _OVERSIZED.format(""),
    "p5_sound": _OVERSIZED.format(", true AS sound"),
    "p7_sound": "SELECT window_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS cut_needlessly FROM context_windows",
    "p2_groups": """
WITH texts AS (
  SELECT DISTINCT chunk_id, regexp_extract_all(lower(chunk_text), '[\\p{L}\\p{N}]+') AS w
  FROM chunks WHERE chunk_asset_id IN (SELECT asset_id FROM assets WHERE asset_type = 'file')),
told AS (SELECT chunk_id, w, array_to_string(w, ' ') AS s FROM texts WHERE len(w) >= 5),
classes AS (SELECT s, min(chunk_id) AS class_key, count(*) AS copies, any_value(w) AS w FROM told GROUP BY s),
shingles AS (
  SELECT DISTINCT class_key, hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS g
  FROM (SELECT class_key, w, unnest(range(1, len(w) - 3)) AS i FROM classes)),
sizes AS (SELECT class_key, count(*) AS n FROM shingles GROUP BY class_key),
common AS (SELECT a.class_key AS x, b.class_key AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.class_key <> b.class_key GROUP BY ALL),
linked AS (
  SELECT x, count(*) AS links FROM common JOIN sizes p ON p.class_key = x JOIN sizes q ON q.class_key = y
  WHERE c / (p.n + q.n - c)::DOUBLE >= 0.8 GROUP BY x)
SELECT chunk_id, class_key, copies, coalesce(links, 0) AS links FROM told JOIN classes USING (s) LEFT JOIN linked ON x = class_key""",
    "p8_found": """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
iw AS (SELECT item_id, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)""",
    "p2_found": """
WITH texts AS (
  SELECT DISTINCT chunk_id, regexp_extract_all(lower(chunk_text), '[\\p{L}\\p{N}]+') AS w
  FROM chunks WHERE chunk_asset_id IN (SELECT asset_id FROM assets WHERE asset_type = 'file')),
shingles AS (
  SELECT DISTINCT chunk_id, hash(w[i], w[i + 1], w[i + 2]) AS s
  FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 40)),
sizes AS (SELECT chunk_id, count(*) AS n FROM shingles GROUP BY chunk_id),
common AS (
  SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT x AS chunk_id_a, y AS chunk_id_b
FROM common JOIN sizes p ON p.chunk_id = x JOIN sizes q ON q.chunk_id = y
WHERE c >= 0.6 * (p.n + q.n - c)""",
}
