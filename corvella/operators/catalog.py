"""Users, projects, assets and chunks: who owns what, and what is added to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvella.functions import predicates
from corvella.functions.text import stable_key, url_file_name
from corvella.operators.numbering import numbered


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows by key, those delivered twice once."""
    return df.dropDuplicates([key])


def authenticated(requests: DataFrame, users: DataFrame) -> DataFrame:
    """``requests`` (api_key and more) with user_id, or null and the status 401 for a missing, unknown or inactive key."""
    active = users.where("is_active AND user_api_key IS NOT NULL").select(F.col("user_api_key").alias("api_key"), "user_id").dropDuplicates(["api_key"])
    return requests.join(active, "api_key", "left").withColumn("status", F.when(F.col("user_id").isNull(), 401).otherwise(200))


def owned_projects(projects: DataFrame, user_id: int) -> DataFrame:
    return projects.where(F.col("user_id") == user_id)


def may_use(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """``requests`` (project_id, user_id) with the project's surrogate key as project_key and allowed."""
    keys = projects.select("project_id", "user_id", F.col("id").alias("project_key")).dropDuplicates(["project_id", "user_id"])
    return requests.join(keys, ["project_id", "user_id"], "left").withColumn("allowed", F.col("project_key").isNotNull())


def with_missing_projects(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """``projects`` (id, project_id, user_id) and one new row for each wanted (project_id, user_id) that has none, with the next surrogate keys."""
    missing = wanted.select("project_id", "user_id").where("project_id IS NOT NULL AND user_id IS NOT NULL").distinct().join(projects, ["project_id", "user_id"], "left_anti")
    start = projects.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(0)).alias("most"))
    fresh = numbered(missing, [], ["project_id", "user_id"], "place").select((start.scalar() + F.col("place")).cast("int").alias("id"), "project_id", "user_id")
    return projects.select("id", "project_id", "user_id").unionByName(fresh)


def next_key(df: DataFrame, key: str) -> DataFrame:
    """The highest key, 1 at least."""
    return df.agg(F.greatest(F.coalesce(F.max(key), F.lit(0)), F.lit(1)).alias("next_from"))


def with_default_owner(projects: DataFrame, owner: int = 1) -> DataFrame:
    return projects.withColumn("user_id", F.coalesce("user_id", F.lit(owner)))


def page_of(df: DataFrame, key: str, page_no: int, page_size: int) -> DataFrame:
    """A page of rows by key, the first being number 1."""
    return df.orderBy(key).offset(max(0, page_no - 1) * page_size).limit(page_size)


def page_after(df: DataFrame, key: str, last: object | None, page_size: int) -> DataFrame:
    """The page of rows that follows the key ``last`` (None: the first page).  Unlike an offset it reads no row before; the filter reaches the scan."""
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(page_size)


def total_pages(df: DataFrame, page_size: int) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select("rows", F.ceil(F.col("rows") / page_size).cast("long").alias("total_pages"))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; more than one is an error when the result is read."""
    found = df.where(F.col(key) == F.lit(value))
    alone = F.count("*").over(Window.partitionBy(key))
    return found.withColumn("_n", F.assert_true(alone == 1, f"several rows for one {key}")).where(F.col("_n").isNull()).drop("_n")


def processing_list(assets: DataFrame) -> DataFrame:
    """Assets in the order in which they are processed: files, pages, tables; one row each."""
    rank = F.when(F.col("asset_type") == "file", 0).when(F.col("asset_type") == "url", 1).when(F.col("asset_type") == "structured_data", 2)
    return once(assets.where(rank.isNotNull()), "asset_id").withColumn("type_rank", rank)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_project_id").agg(F.count("chunk_id").alias("chunks"))


def state_versions(assets: DataFrame, all_types: bool = False) -> DataFrame:
    """Assets by project as their state; files only, unless told otherwise."""
    counted = F.count("*") if all_types else F.count(F.when(F.col("asset_type") == "file", 1))
    return assets.groupBy("asset_project_id").agg(counted.alias("state_version"))


def ownership(chunks: DataFrame, assets: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    """Chunks with their asset, project and user.  The wide chunks are joined once per step on a narrow other side."""
    a = assets.select(F.col("asset_id").alias("chunk_asset_id"), "asset_type", F.col("asset_project_id"))
    p = projects.select(F.col("id").alias("asset_project_id"), "user_id")
    u = users.select("user_id", "is_active")
    return chunks.join(a, "chunk_asset_id").join(p, "asset_project_id").join(u, "user_id")


def new_assets(uploads: DataFrame, project: Column) -> DataFrame:
    """Accepted uploads (name, media, size) as assets of a project: stored name, type and size."""
    ok = uploads.where(predicates.upload_decision(F.col("name"), F.col("media"), F.col("size")) == "accepted")
    key = stable_key(project.cast("string"), F.col("name"), F.col("size").cast("string"))
    return ok.select(project.alias("asset_project_id"), F.concat_ws("_", key, "name").alias("asset_name"), predicates.asset_type(F.col("name")).alias("asset_type"), F.col("size").alias("asset_size"))


def page_assets(pages: DataFrame, project: Column, most: int) -> DataFrame:
    """Fetched pages (url, title, text) as assets: within the size limit, under a name made from the address, with address and title on record."""
    size = F.octet_length("text")
    key = stable_key(project.cast("string"), F.col("url"))
    record = F.to_json(F.struct(F.col("url").alias("source_url"), "title"))
    return pages.where(predicates.within_bytes(F.col("text"), most) & (size > 0)).select(project.alias("asset_project_id"), F.concat_ws("_", key, url_file_name(F.col("url"))).alias("asset_name"), F.lit("url").alias("asset_type"), size.alias("asset_size"), record.alias("asset_config"))


def without_project(chunks: DataFrame, project: int) -> DataFrame:
    """Chunks after a reset of one project."""
    return chunks.where(~F.coalesce(F.col("chunk_project_id") == project, F.lit(False)))


def deleted_counts(chunks: DataFrame, project: int) -> DataFrame:
    """How many chunks a reset of a project deletes."""
    return chunks.agg(F.count(F.when(F.col("chunk_project_id") == project, 1)).alias("deleted"))


def write_chunks(chunks: DataFrame, path: str) -> int:
    """Chunks by project, each project's files replaced as a whole; returns how many were written."""
    seen = Observation()
    chunks.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_project_id").parquet(path)
    return int(seen.get["rows"])


def registered(names: DataFrame, seed: str = "") -> DataFrame:
    """New users (user_id, user_name) with an active key that is reproducible under the seed."""
    return names.select("user_id", F.nullif(F.trim("user_name"), F.lit("")).alias("user_name"), stable_key(F.lit(seed), F.col("user_id").cast("string"), length=32).alias("user_api_key"), F.lit(True).alias("is_active"))
