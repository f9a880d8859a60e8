"""Queries over users, projects, assets, tasks, requests and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.config import Settings
from corvella.functions import html, predicates, text
from corvella.operators import catalog, ledger, metrics, retrieval, services, vectors
from corvella.plans import pipeline
from corvella.plans.registry import query
from corvella.plans.text_queries import _page_html
from corvella.runtime import materialise, table
from corvella.sources import files
from corvella.streaming import ingest

DEFAULTS = Settings()

# users and projects


@query("SELECT id, project_id, user_id FROM (SELECT DISTINCT id, project_id, user_id FROM projects) WHERE user_id = 1")
def own_project_filter(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.owned_projects(catalog.once(table(spark, sf, "projects"), "id"), 1).select("id", "project_id", "user_id")


@query("""WITH u AS (SELECT DISTINCT user_id, user_api_key, is_active FROM users),
r AS (SELECT user_id AS n, CASE user_id % 4 WHEN 0 THEN 'no-such-key' WHEN 1 THEN NULL ELSE user_api_key END AS api_key FROM u)
SELECT n, u.user_id, CASE WHEN u.user_id IS NULL THEN 401 ELSE 200 END AS status FROM r LEFT JOIN u ON u.user_api_key = r.api_key AND u.is_active""")
def auth_active(spark: SparkSession, sf: str) -> DataFrame:
    users = catalog.once(table(spark, sf, "users"), "user_id")
    asked = users.select(F.col("user_id").alias("n"), F.when(F.col("user_id") % 4 == 0, F.lit("no-such-key")).when(F.col("user_id") % 4 != 1, F.col("user_api_key")).alias("api_key"))
    return catalog.authenticated(asked, users).select("n", "user_id", "status")


@query("""WITH p AS (SELECT DISTINCT id, project_id, user_id FROM projects)
SELECT r.project_id, r.user_id, p.id AS project_key, p.id IS NOT NULL AS allowed FROM (SELECT DISTINCT project_id, user_id % 7 + 1 AS user_id FROM p) r LEFT JOIN p USING (project_id, user_id)""")
def project_access(spark: SparkSession, sf: str) -> DataFrame:
    p = catalog.once(table(spark, sf, "projects"), "id")
    asked = p.select("project_id", (F.col("user_id") % 7 + 1).alias("user_id")).distinct()
    return catalog.may_use(asked, p).select("project_id", "user_id", "project_key", "allowed")


@query("""WITH p AS (SELECT DISTINCT id, project_id, user_id FROM projects),
m AS (SELECT DISTINCT project_id + 1 AS project_id, user_id FROM p EXCEPT SELECT project_id, user_id FROM p)
SELECT id, project_id, user_id FROM p UNION ALL
SELECT CAST((SELECT max(id) FROM p) + row_number() OVER (ORDER BY project_id, user_id) AS INTEGER), project_id, user_id FROM m""")
def project_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    p = catalog.once(table(spark, sf, "projects"), "id")
    return catalog.with_missing_projects(p, p.select((F.col("project_id") + 1).alias("project_id"), "user_id"))


@query("SELECT id, project_id FROM (SELECT DISTINCT id, project_id FROM projects) ORDER BY id LIMIT 10 OFFSET 20")
def project_pages(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.page_of(catalog.once(table(spark, sf, "projects"), "id"), "id", 3, 10).select("id", "project_id")


@query("SELECT count(*) AS rows, (count(*) + 9) // 10 AS total_pages FROM (SELECT DISTINCT id FROM projects)")
def project_total_pages(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.total_pages(table(spark, sf, "projects").select("id").distinct(), 10)


@query("SELECT greatest(coalesce(max(c_custkey), 0), 1) AS next_from FROM customer")
def next_surrogate_key(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.next_key(table(spark, sf, "customer"), "c_custkey")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE user_id END AS user_id FROM (SELECT DISTINCT id, user_id FROM projects)")
def backfill_owner(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "projects").select("id", "user_id").distinct().withColumn("user_id", F.when(F.col("id") % 3 != 0, F.col("user_id")))
    return catalog.with_default_owner(p)


@query("SELECT user_id, nullif(trim(user_name), '') AS user_name, substr(sha256('s:' || user_id), 1, 32) AS user_api_key, true AS is_active FROM (SELECT DISTINCT user_id, user_name FROM users)")
def user_create(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.registered(table(spark, sf, "users").select("user_id", "user_name").distinct(), "s")


# assets and chunks


@query("""SELECT asset_id, asset_type, CASE asset_type WHEN 'file' THEN 0 WHEN 'url' THEN 1 ELSE 2 END AS type_rank
FROM (SELECT DISTINCT asset_id, asset_type FROM assets) WHERE asset_type IN ('file', 'url', 'structured_data')""")
def asset_union_types(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.processing_list(table(spark, sf, "assets")).select("asset_id", "asset_type", "type_rank")


@query("SELECT asset_id, max(asset_name) AS asset_name FROM (SELECT DISTINCT asset_id, asset_name, asset_type FROM assets) WHERE asset_type IN ('file', 'url', 'structured_data') GROUP BY asset_id")
def asset_dict_union(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.processing_list(table(spark, sf, "assets")).select("asset_id", "asset_name")


@query("SELECT asset_project_id, count(CASE WHEN asset_type = 'file' THEN 1 END) AS state_version FROM (SELECT DISTINCT asset_id, asset_type, asset_project_id FROM assets) GROUP BY asset_project_id")
def asset_state_version(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.state_versions(catalog.once(table(spark, sf, "assets"), "asset_id"))


@query("""SELECT 7 AS asset_project_id, substr(sha256('7:' || asset_name || ':' || asset_size), 1, 12) || '_' || asset_name AS asset_name,
 CASE WHEN lower(regexp_extract(asset_name, '(\\.[^./\\\\]+)$', 1)) IN ('.csv', '.xlsx', '.xls') THEN 'structured_data' ELSE 'file' END AS asset_type, asset_size FROM (SELECT DISTINCT asset_id, asset_name, asset_size FROM assets) WHERE asset_size <= 10485760""")
def asset_create(spark: SparkSession, sf: str) -> DataFrame:
    ups = table(spark, sf, "assets").select("asset_id", "asset_name", "asset_size").distinct().select(F.col("asset_name").alias("name"), F.lit("text/plain").alias("media"), F.col("asset_size").alias("size"))
    return catalog.new_assets(ups, F.lit(7))


@query("""SELECT 7 AS asset_project_id, strlen(text) AS asset_size, 'url' AS asset_type,
 substr(sha256('7:' || source), 1, 12) || '_' || substr(regexp_replace(regexp_replace(source, 'https?://', '', 'g'), '[^\\p{L}\\p{N}_]', '_', 'g'), 1, 80) || '.txt' AS asset_name
FROM documents WHERE source LIKE 'http%' AND text IS NOT NULL AND strlen(text) BETWEEN 1 AND 2000""")
def page_ingest_assets(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").where("source LIKE 'http%' AND text IS NOT NULL").select(F.col("source").alias("url"), "title", "text")
    return catalog.page_assets(pages, F.lit(7), 2000).select("asset_project_id", F.col("asset_size").cast("long").alias("asset_size"), "asset_type", "asset_name")


@query()
def page_ingest_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole route of a fetched page: HTML to title and text, text to an asset."""
    content = html.page_content(_page_html(F.col("text")))
    pages = table(spark, sf, "documents").where("source LIKE 'http%' AND text IS NOT NULL").select(F.col("source").alias("url"), content.alias("c")).select("url", "c.title", "c.text")
    return catalog.page_assets(pages, F.lit(7), DEFAULTS.file_bytes)


@query("SELECT doc_id, strlen(text) <= 5000 AS accepted FROM documents WHERE text IS NOT NULL")
def size_guard(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", predicates.within_bytes(F.col("text"), 5000).alias("accepted"))


@query("SELECT chunk_project_id, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, chunk_project_id FROM chunks) GROUP BY chunk_project_id")
def chunk_count(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.chunk_counts(table(spark, sf, "chunks").select("chunk_id", "chunk_project_id").distinct())


@query("SELECT chunk_id, chunk_order FROM (SELECT DISTINCT chunk_id, chunk_order FROM chunks WHERE chunk_project_id = 17) ORDER BY chunk_id LIMIT 50 OFFSET 50")
def chunk_page(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "chunks").where("chunk_project_id = 17").select("chunk_id", "chunk_order").distinct()
    return catalog.page_of(own, "chunk_id", 2, 50)


@query("SELECT chunk_id, chunk_order FROM (SELECT DISTINCT chunk_id, chunk_order FROM chunks WHERE chunk_project_id = 17 AND chunk_id > 200) ORDER BY chunk_id LIMIT 50")
def chunk_page_after(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "chunks").where("chunk_project_id = 17").select("chunk_id", "chunk_order").distinct()
    return catalog.page_after(own, "chunk_id", 200, 50)


@query("SELECT chunk_id, chunk_asset_id FROM (SELECT DISTINCT chunk_id, chunk_asset_id FROM chunks) WHERE chunk_id = 100")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.lookup(table(spark, sf, "chunks").select("chunk_id", "chunk_asset_id").distinct(), "chunk_id", 100)


@query("SELECT chunk_project_id, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, chunk_project_id FROM chunks) WHERE chunk_project_id <> 17 GROUP BY chunk_project_id")
def chunk_reset_delete(spark: SparkSession, sf: str) -> DataFrame:
    left = catalog.without_project(table(spark, sf, "chunks").select("chunk_id", "chunk_project_id").distinct(), 17)
    return catalog.chunk_counts(materialise(left, "chunks"))


@query("""SELECT u.user_id, a.asset_type, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, chunk_asset_id FROM chunks) c JOIN (SELECT DISTINCT asset_id, asset_type, asset_project_id FROM assets) a ON a.asset_id = c.chunk_asset_id
JOIN (SELECT DISTINCT id, user_id FROM projects) p ON p.id = a.asset_project_id JOIN (SELECT DISTINCT user_id FROM users) u ON u.user_id = p.user_id GROUP BY u.user_id, a.asset_type""")
def own_graph_join(spark: SparkSession, sf: str) -> DataFrame:
    graph = catalog.ownership(table(spark, sf, "chunks").select("chunk_id", "chunk_asset_id").distinct(), catalog.once(table(spark, sf, "assets"), "asset_id"), catalog.once(table(spark, sf, "projects"), "id"), catalog.once(table(spark, sf, "users"), "user_id"))
    return graph.groupBy("user_id", "asset_type").agg(F.count("*").alias("chunks"))


@query("""SELECT request_id, coalesce(nullif(greatest(coalesce(chunk_size, 800), 0), 0), 800) AS chunk_size FROM (SELECT DISTINCT request_id, chunk_size FROM process_requests)""")
def process_request_defaults(spark: SparkSession, sf: str) -> DataFrame:
    r = ingest.fresh_requests(table(spark, sf, "process_requests"))
    return r.select("request_id", F.when(F.col("chunk_size") > 0, F.col("chunk_size")).otherwise(DEFAULTS.chunk_size).alias("chunk_size"))


# tasks

_AT = "2024-01-10 00:00:00"
_NOW = f"TIMESTAMP '{_AT}'"


def _now() -> Column:
    return F.lit(_AT).cast("timestamp")

_STATES = ["PENDING", "STARTED", "RETRY", "SUCCESS", "FAILURE"]
_LEDGER = """SELECT event_id AS execution_id, event_type AS task_name, CAST(user_id AS VARCHAR) AS task_args_hash, ['PENDING', 'STARTED', 'RETRY', 'SUCCESS', 'FAILURE'][event_id % 5 + 1] AS status,
 CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 5 SECOND END AS started_at, ts AS created_at FROM events"""


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 5 + 1).cast("int"))
    started = F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 5 SECONDS"))
    return e.select(F.col("event_id").alias("execution_id"), F.col("event_type").alias("task_name"), F.col("user_id").cast("string").alias("task_args_hash"), state.alias("status"), started.alias("started_at"), F.col("ts").alias("created_at"))


@query("""SELECT event_id, sha256('{"chunk_size": ' || coalesce(CAST(CASE WHEN event_id % 3 <> 0 THEN event_id % 1000 END AS VARCHAR), 'null') || ', "do_reset": ' || CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END
 || ', "file_id": ' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"k' || event_id || '_caf\\u00e9 \\"a\\" \\ud83d\\ude00.pdf"' END || ', "project_id": ' || user_id || ', "share": ' || CAST(event_id % 8 / 4.0::DOUBLE AS VARCHAR) || ', "task_name": "' || event_type || '"}') AS task_args_hash FROM events""")
def task_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments of every kind: numbers, booleans, nulls, and strings with quotes and letters beyond ASCII."""
    n = F.col("event_id")
    args = {
        "project_id": F.col("user_id"), "do_reset": n % 2 == 1, "chunk_size": F.when(n % 3 != 0, n % 1000), "share": (n % 8 / F.lit(4.0)).cast("double"),
        "file_id": F.when(n % 5 != 0, F.concat(F.lit("k"), n.cast("string"), F.lit('_café "a" 😀.pdf'))),
    }
    return table(spark, sf, "events").select("event_id", ledger.args_hash(F.col("event_type"), args).alias("task_args_hash"))


_LATEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_name, task_args_hash ORDER BY created_at DESC, execution_id DESC) AS p FROM ({_LEDGER})) WHERE p = 1)"


@query(f"SELECT task_name, task_args_hash, execution_id, status FROM {_LATEST}")
def ledger_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.latest(_ledger(spark, sf)).select("task_name", "task_args_hash", "execution_id", "status")


_ASKED = "SELECT DISTINCT event_type AS task_name, CAST(user_id + 10 AS VARCHAR) AS task_args_hash FROM events"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("task_name"), (F.col("user_id") + 10).cast("string").alias("task_args_hash")).distinct()


@query(f"SELECT a.task_name, a.task_args_hash, l.status FROM ({_ASKED}) a LEFT JOIN {_LATEST} l USING (task_name, task_args_hash)")
def ledger_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.decisions(_asked(spark, sf), _ledger(spark, sf), _now()).select("task_name", "task_args_hash", "status")


_AGE = f"(epoch({_NOW}) - epoch(started_at)) > 660"


@query(f"""SELECT a.task_name, a.task_args_hash, CASE WHEN l.status IS NULL THEN true WHEN l.status = 'SUCCESS' THEN false WHEN l.status IN ('PENDING', 'STARTED', 'RETRY') THEN coalesce({_AGE}, false) ELSE true END AS run
FROM ({_ASKED}) a LEFT JOIN {_LATEST} l USING (task_name, task_args_hash)""")
def task_decision(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.decisions(_asked(spark, sf), _ledger(spark, sf), _now()).select("task_name", "task_args_hash", "run")


@query(f"SELECT execution_id, status, coalesce({_AGE}, false) AS stuck FROM ({_LEDGER}) WHERE status IN ('PENDING', 'STARTED', 'RETRY')")
def ledger_age_flags(spark: SparkSession, sf: str) -> DataFrame:
    open_tasks = _ledger(spark, sf).where(F.col("status").isin("PENDING", "STARTED", "RETRY"))
    return open_tasks.select("execution_id", "status", ledger.should_run(F.col("status"), F.col("started_at"), _now()).alias("stuck"))


@query(f"SELECT status, count(*) AS left_over FROM ({_LEDGER}) WHERE NOT (epoch(created_at) < epoch({_NOW}) - 86400 AND status IN ('SUCCESS', 'FAILURE')) GROUP BY status")
def task_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.kept(_ledger(spark, sf), _now()).groupBy("status").agg(F.count("*").alias("left_over"))


@query("""SELECT event_id, CASE WHEN s = 'PENDING' AND event_id % 2 = 0 THEN 'not_found' WHEN s = 'SUCCESS' THEN 'completed' WHEN s IN ('FAILURE', 'REVOKED') THEN 'failed' ELSE 'pending' END AS signal
FROM (SELECT event_id, ['PENDING', 'STARTED', 'RETRY', 'SUCCESS', 'FAILURE', 'REVOKED', 'RECEIVED'][event_id % 7 + 1] AS s FROM events)""")
def task_status_signal(spark: SparkSession, sf: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, [*_STATES, "REVOKED", "RECEIVED"])), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", ledger.status_signal(state, F.col("event_id") % 2 == 1).alias("signal"))


@query("SELECT event_id, 'signal=' || event_type AS public FROM events")
def task_strip_internal(spark: SparkSession, sf: str) -> DataFrame:
    result = F.create_map(F.lit("signal"), F.col("event_type"), F.lit("_db_id"), F.col("event_id").cast("string"))
    shown = F.array_join(F.transform(F.map_entries(ledger.public_result(result)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf, "events").select("event_id", shown.alias("public"))


@query(f"""SELECT execution_id, CASE WHEN execution_id % 11 = 0 THEN 'SUCCESS' ELSE status END AS status, CASE WHEN execution_id % 11 = 0 THEN {_NOW} END AS completed_at FROM ({_LEDGER})""")
def ledger_update(spark: SparkSession, sf: str) -> DataFrame:
    base = _ledger(spark, sf).withColumns({"result": F.lit(None).cast("string"), "completed_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    changes = base.where("execution_id % 11 = 0").select("execution_id", F.lit("SUCCESS").alias("new_status"), F.lit("").alias("new_result"))
    return ledger.updated(base, changes, _now()).select("execution_id", "status", "completed_at")


@query(f"""SELECT task_name, task_args_hash, status, started_at FROM ({_LEDGER}) UNION ALL
SELECT a.task_name, a.task_args_hash, 'PENDING', {_NOW} FROM ({_ASKED}) a WHERE NOT EXISTS (SELECT 1 FROM ({_LEDGER}) l WHERE l.task_name = a.task_name AND l.task_args_hash = a.task_args_hash)""")
def ledger_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Asked tasks without an entry get one: pending, begun now."""
    twice = _asked(spark, sf).unionByName(_asked(spark, sf))
    return ledger.recorded(_ledger(spark, sf), twice, _now()).select("task_name", "task_args_hash", "status", "started_at")


@query("SELECT event_id, (event_id % 700) IN (408, 409, 429) OR (event_id % 700) BETWEEN 500 AND 599 OR event_type LIKE '%click%' AS again FROM events")
def retryable_flag(spark: SparkSession, sf: str) -> DataFrame:
    told = F.when(F.col("event_type").contains("click"), F.lit("Timeout while reading")).otherwise(F.lit("bad request"))
    return table(spark, sf, "events").select("event_id", predicates.retryable(F.col("event_id") % 700, told).alias("again"))


@query("SELECT event_id, least(30.0::DOUBLE, 1.0 * pow(2.0, event_id % 8)) AS most_seconds FROM events")
def backoff_bound(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", predicates.backoff_bound(F.col("event_id") % 8).alias("most_seconds"))


_TASK = "tasks.index"


@query(f"""WITH c AS (SELECT DISTINCT chunk_id, chunk_project_id, chunk_text FROM chunks), s AS (SELECT chunk_project_id AS p, count(*) AS n, count(CASE WHEN regexp_replace(chunk_text, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', '', 'g') <> '' THEN 1 END) AS filled FROM c GROUP BY 1)
SELECT p AS project_key, p % 3 <> 0 AS run, 'SUCCESS' AS status, CASE WHEN p % 3 <> 0 THEN '{{"signal":"indexed","inserted_rows":' || filled || '}}' END AS result FROM s""")
def task_index_gated(spark: SparkSession, sf: str) -> DataFrame:
    """Indexing by project as tasks, a third of which the ledger says are done."""
    chunks = catalog.once(table(spark, sf, "chunks"), "chunk_id")
    state = chunks.groupBy(F.col("chunk_project_id").alias("p")).agg(F.count("*").alias("n")).where("p % 3 = 0")
    done = state.select(F.col("p").cast("long").alias("execution_id"), F.lit(_TASK).alias("task_name"), ledger.args_hash(F.lit(_TASK), {"project_id": F.col("p"), "chunks": F.col("n")}).alias("task_args_hash"), F.lit("SUCCESS").alias("status"), _now().alias("started_at"), _now().alias("created_at"))
    return pipeline.index_tasks(chunks, done, _TASK, _now())[0]


@query("SELECT count(*) AS deleted FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_project_id = 17)")
def chunk_delete_count(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.deleted_counts(catalog.once(table(spark, sf, "chunks"), "chunk_id"), 17)


@query("""SELECT event_id, least(CASE WHEN event_id % 3 = 0 THEN (event_id % 50)::DOUBLE ELSE (event_id % 10) / 10.0::DOUBLE * pow(2.0, event_id % 8) END, 30.0::DOUBLE) AS seconds,
 (event_id % 700) IN (408, 409, 429) AND event_id % 5 < 3 OR (event_id % 700) BETWEEN 500 AND 599 AND event_id % 5 < 3 AS again FROM events""")
def retry_pause(spark: SparkSession, sf: str) -> DataFrame:
    """Pauses by what the service told or by doubling bounds, and whether a failed call is made again."""
    n = F.col("event_id")
    told = F.when(n % 3 == 0, (n % 50).cast("double")).when(n % 3 == 1, F.lit(-1.0))
    seconds = predicates.pause(n % 8, told, (n % 10) / F.lit(10.0))
    return table(spark, sf, "events").select("event_id", seconds.alias("seconds"), predicates.tries_again(n % 700, F.lit(None).cast("string"), n % 5).alias("again"))


@query("SELECT request_id, coalesce(nullif(result_limit, 0), 1000) AS tokens, CASE WHEN score_threshold IS NULL OR score_threshold = 0 THEN 0.1::DOUBLE ELSE score_threshold END AS temperature FROM (SELECT DISTINCT request_id, result_limit, score_threshold FROM search_requests)")
def generation_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of a generation that are null or zero take the defaults."""
    r = catalog.once(table(spark, sf, "search_requests"), "request_id")
    return r.select("request_id", predicates.given_or(F.col("result_limit"), DEFAULTS.answer_tokens).alias("tokens"), predicates.given_or(F.col("score_threshold"), DEFAULTS.temperature).alias("temperature"))


# files


def _as_files(rows: DataFrame, name: Column, body: Column) -> DataFrame:
    return rows.select(name.alias("path"), F.encode(body, "UTF-8").alias("bytes"), predicates.loader(name).alias("loader"))


@query("SELECT n_nationkey || '.txt' AS path, ' ' || n_name || chr(10) || 'é ' AS page_content, NULL::VARCHAR AS error FROM nation UNION ALL SELECT n_nationkey || '.pdf', NULL, 'no parser for pdf' FROM nation")
def load_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text files as they are; files of a kind without a parser leave a row that says so, those of unknown kinds none."""
    n = table(spark, sf, "nation")
    names = [F.concat(F.col("n_nationkey").cast("string"), F.lit(end)) for end in (".txt", ".pdf", ".exe")]
    found = [_as_files(n, name, F.concat(F.lit(" "), "n_name", F.lit("\né "))) for name in names]
    return files.documents(found[0].unionByName(found[1]).unionByName(found[2])).select("path", "page_content", "error")


@query("SELECT n_nationkey || '.exe' AS path FROM nation")
def load_unsupported(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    names = F.explode(F.array(*[F.concat(F.col("n_nationkey").cast("string"), F.lit(end)) for end in (".TXT", ".exe")]))
    listed = n.select(names.alias("name")).withColumn("path", F.col("name")).withColumn("loader", predicates.loader(F.col("name")))
    return files.unsupported(listed).select("path")


@query("SELECT n_nationkey || '.md' AS path, n_name || chr(10) || 'one' || chr(10) || 'two ' || n_name || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'x = 1' AS page_content, 'markdown' AS format FROM nation")
def load_markdown(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("n_name")
    body = F.concat(F.lit("# "), name, F.lit("\n\n- **one**\n- two ["), name, F.lit("](http://x.example)\n\n| a | b |\n|---|---|\n\n```\nx = 1\n```\n"))
    return files.documents(_as_files(table(spark, sf, "nation"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".md")), body)).select("path", "page_content", "format")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer)
SELECT c_mktsegment || '.csv' AS path, ((n - 1) // 50 * 50 + 1) || '-' || max(n) AS row_range, CAST(max(total) AS INTEGER) AS total_rows,
 string_agg('Row ' || n || ':' || chr(10) || 'key: ' || c_custkey || ' | name: ' || CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE c_name END, chr(10) || chr(10) ORDER BY n) AS page_content
FROM r GROUP BY c_mktsegment, (n - 1) // 50""")
def load_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by segment as CSV files with padded names, missing values, lines with a field too many and blank ones."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.lit("")).otherwise(F.col("c_name"))
    line = F.concat(key.cast("string"), F.lit(","), name, F.when(key % 7 == 0, F.lit("\n0,a,b")).when(key % 11 == 0, F.lit("\n,")).otherwise(F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"])
    sheets = c.groupBy("c_mktsegment").agg(F.concat(F.lit("key, name \n"), F.array_join(lines, "\n")).alias("body"))
    found = files.documents(_as_files(sheets, F.concat("c_mktsegment", F.lit(".csv")), F.col("body")))
    return found.select("path", "row_range", "total_rows", F.regexp_replace("page_content", r"key: (\d+)\.0 ", "key: $1 ").alias("page_content"))


# metrics

_SAMPLES = "SELECT CASE event_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, '/' || event_type AS endpoint, 200 + event_id % 3 * 100 AS status, round(value / 50, 2) AS duration_s FROM events"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), "event_type").alias("endpoint"), (200 + F.col("event_id") % 3 * 100).alias("status"), F.round(F.col("value") / 50, 2).alias("duration_s"))


@query(f"SELECT method, endpoint, status, count(*) AS requests FROM ({_SAMPLES}) GROUP BY ALL")
def metric_counter(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.request_counter(_samples(spark, sf))


@query(f"""SELECT method, endpoint, le, count(CASE WHEN le = '+Inf' OR duration_s <= TRY_CAST(le AS DOUBLE) THEN duration_s END) AS cumulative
FROM ({_SAMPLES}), (SELECT unnest(['0.005', '0.01', '0.025', '0.05', '0.075', '0.1', '0.25', '0.5', '0.75', '1.0', '2.5', '5.0', '7.5', '10.0', '+Inf']) AS le) GROUP BY ALL""")
def metric_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latency_histogram(_samples(spark, sf)).select("method", "endpoint", "le", "cumulative")


@query(f"SELECT 'http_requests_total{{method=\"' || method || '\",endpoint=\"' || endpoint || '\",status=\"' || status || '\"}} ' || count(*) AS line FROM ({_SAMPLES}) GROUP BY method, endpoint, status")
def metric_exposition(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.exposition(_samples(spark, sf))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events FROM (SELECT DISTINCT event_id, ts, event_type FROM events) GROUP BY ALL")
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the windowed stream; tests run it as a stream too."""
    return ingest.event_counts(table(spark, sf, "events")).select("window_start", "event_type", "events")


# prompts

_HITS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(c.e, q.e) AS score FROM v q, v c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s),
d AS (SELECT query_id, place, score, coalesce(source, 'unknown') AS source, coalesce(text, '') AS text FROM r JOIN documents ON doc_id = vec_id WHERE place <= 3)
"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    best = vectors.batch_search(rows, asked, 3)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return best.join(docs, "id").withColumn("query_text", F.concat(F.lit("question "), F.col("query_id").cast("string")))


@query(_HITS + "SELECT query_id, place, 'Source ' || place || ': ' || source || chr(10) || 'Passage: ' || text AS doc_prompt FROM d")
def rag_doc_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.document_prompts(_hits(spark, sf)).select("query_id", "place", "doc_prompt")


_PROMPT = """string_agg('Source ' || place || ': ' || source || chr(10) || 'Passage: ' || text, chr(10) ORDER BY place) || chr(10) || chr(10)
 || 'Use only the passages above.' || chr(10) || 'Answer in the language of the question.' || chr(10) || 'Question:' || chr(10) || 'question ' || query_id || chr(10) || chr(10) || 'Answer:'"""


@query(_HITS + f"SELECT query_id, {_PROMPT} AS full_prompt FROM d GROUP BY query_id")
def rag_full_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.full_prompts(_hits(spark, sf)).select("query_id", "full_prompt")


@query(_HITS + f"SELECT query_id, 'system,user' AS roles, length({_PROMPT}) AS prompt_chars FROM d GROUP BY query_id")
def rag_chat_history(spark: SparkSession, sf: str) -> DataFrame:
    chat = retrieval.full_prompts(_hits(spark, sf))
    return chat.select("query_id", F.array_join(F.transform("chat", lambda m: m["role"]), ",").alias("roles"), F.length(F.col("chat")[1]["content"]).cast("long").alias("prompt_chars"))


@query(_HITS + "SELECT query_id, text, round(score, 6) AS score FROM d")
def response_projection(spark: SparkSession, sf: str) -> DataFrame:
    found = _hits(spark, sf).withColumn("metadata", F.struct("source"))
    return retrieval.responses(found).select("query_id", "result.text", F.round("result.score", 6).alias("score"))


def _collection(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.indexed(catalog.once(table(spark, sf, "chunks"), "chunk_id").where("length(trim(chunk_text)) > 0"))


@query()
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.info(_collection(spark, sf))


@query()
def search_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth search request against the chunks of all projects, by the stand-in embedding."""
    asked = catalog.once(table(spark, sf, "search_requests"), "request_id").where("request_id % 50 = 0 AND length(trim(text)) > 0")
    asked = asked.select(F.col("request_id").alias("query_id"), services.embedder("hashed")(text.truncated(F.col("text"), DEFAULTS.input_characters), "query").alias("query_vector"))
    return vectors.batch_search(_collection(spark, sf), asked, 5).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query()
def answer_stub(spark: SparkSession, sf: str) -> DataFrame:
    asked = catalog.once(table(spark, sf, "search_requests"), "request_id").where("request_id % 50 = 0 AND length(trim(text)) > 0")
    return retrieval.answers(_collection(spark, sf), asked.select(F.col("request_id").alias("query_id"), F.col("text").alias("query_text"))).select("query_id", "full_prompt", "answer")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut, chunked, embedded, indexed and searched for one question, with citations."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), "project_key", F.lit(0).alias("doc_no"), text.truncated(F.col("text"), None).alias("page_content"), F.struct("source", F.lit(None).cast("string").alias("format"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("int").alias("table_index"), F.lit(None).cast("string").alias("row_range"), F.lit(None).cast("int").alias("image_index"), F.lit(None).cast("string").alias("sheet_name")).alias("metadata"))
    _, collection = pipeline.process_and_index(docs)
    collection = materialise(collection, "collection")
    question = spark.createDataFrame([(1, "Which cooling loop was replaced before the move?")], "query_id int, query_text string")
    asked = question.select("query_id", services.embedder("hashed")(F.col("query_text"), "query").alias("query_vector"))
    hits = vectors.batch_search(collection, asked, DEFAULTS.search_limit)
    return hits.join(collection, "id").select("place", "id", F.round("score", 6).alias("score"), text.citation_label(F.col("metadata")).alias("source"), "text").orderBy("place")


