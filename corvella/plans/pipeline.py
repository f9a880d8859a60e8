"""The steps of ingestion put together: documents to chunks to a collection, in one job each and without driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.config import Settings
from corvella.functions.text import strip
from corvella.operators import catalog, chunking, ledger, retrieval, vectors

DEFAULTS = Settings()


def process(documents: DataFrame, size: Column | int = DEFAULTS.chunk_size, overlap: Column | int = DEFAULTS.overlap_size) -> DataFrame:
    """Documents (asset_id, project_key, page_content, metadata) as chunk records in order."""
    pieces = chunking.chunks_of(documents.where(F.length("page_content") > 0), "page_content", size, overlap)
    ordered = chunking.chunk_records(pieces, "asset_id", ["doc_no", "piece_no"] if "doc_no" in documents.columns else ["piece_no"])
    return ordered.select(F.col("chunk_text"), F.col("metadata").alias("chunk_metadata"), "chunk_order", F.col("project_key").alias("chunk_project_id"), F.col("asset_id").alias("chunk_asset_id"))


def process_counts(chunks: DataFrame) -> DataFrame:
    """inserted_chunks and processed_files by project; files without chunks don't count."""
    return chunks.groupBy("chunk_project_id").agg(F.count("*").alias("inserted_chunks"), F.count_distinct("chunk_asset_id").alias("processed_files"))


def process_and_index(documents: DataFrame, existing_chunks: DataFrame | None = None, reset_project: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of the documents (next to the existing ones, after a reset of one project), and their collection rows."""
    chunks = process(documents)
    if existing_chunks is not None:
        old = existing_chunks if reset_project is None else catalog.without_project(existing_chunks, reset_project)
        chunks = old.select(*chunks.columns).unionByName(chunks)
    keyed = chunks.withColumn("chunk_id", F.xxhash64("chunk_asset_id", "chunk_order", "chunk_text"))
    return keyed, retrieval.indexed(keyed)


def info(collection: DataFrame) -> DataFrame:
    return vectors.collection_info(collection)


def index_tasks(chunks: DataFrame, known: DataFrame, task_name: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(tasks, rows): indexing of each project's chunks as a task, entered in the ledger ``known`` and run unless that forbids it.

    tasks: project_key, run, status and result after it (counts as JSON; of tasks that did not run what the ledger has).  rows: the collection rows of those that ran.
    Project and number of chunks are the task's arguments, so that a project whose chunks changed is a new task.
    """
    state = chunks.groupBy(F.col("chunk_project_id").alias("project_key")).agg(F.count("*").alias("chunks"))
    asked = state.select("project_key", F.lit(task_name).alias("task_name"), ledger.args_hash(F.lit(task_name), {"project_id": F.col("project_key"), "chunks": F.col("chunks")}).alias("task_args_hash"))
    decided = ledger.decisions(asked, known, now)
    run = decided.where("run").select(F.col("project_key").alias("chunk_project_id"))
    rows = retrieval.indexed(chunks.join(run, "chunk_project_id", "left_semi").where(strip(F.col("chunk_text")) != ""))
    counts = rows.groupBy("project_key").agg(F.count("*").alias("inserted"))
    told = F.to_json(F.struct(F.lit("indexed").alias("signal"), F.coalesce("inserted", F.lit(0)).alias("inserted_rows")))
    after = decided.join(counts, "project_key", "left").select("project_key", "run", F.when(F.col("run"), F.lit("SUCCESS")).otherwise(F.col("status")).alias("status"), F.when(F.col("run"), told).alias("result"))
    return after, rows
