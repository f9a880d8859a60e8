"""Queries over text, tables, structured rows, pages and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvella.config import Settings
from corvella.functions import geometry, html, predicates, text
from corvella.operators import catalog, chunking, layout, services, structured, tables
from corvella.plans import pipeline
from corvella.plans.registry import query
from corvella.runtime import table

DEFAULTS = Settings()
#: White space in DuckDB's regular expressions.
S = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
W = r"[\p{L}\p{N}_]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


@query(f"SELECT doc_id, {strip_sql('substr(text, 1, 1024)')} AS cut FROM documents")
def text_process_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.truncated(F.col("text"), DEFAULTS.input_characters).alias("cut"))


@query("SELECT doc_id, substr(text, 1, 40) AS prefix FROM documents")
def truncate_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 40).alias("prefix"))


@query(f"SELECT chunk_id, trim(regexp_replace(coalesce(chunk_text, ''), '{S}+', ' ', 'g')) AS cell FROM (SELECT DISTINCT chunk_id, chunk_text FROM chunks)")
def text_clean_cell(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_id", "chunk_text").distinct().select("chunk_id", text.clean_cell(F.col("chunk_text")).alias("cell"))


@query(f"SELECT chunk_id, regexp_replace(chunk_text, '({W})-\\n({W})', '\\1\\2', 'g') AS joined FROM (SELECT DISTINCT chunk_id, chunk_text FROM chunks)")
def text_dehyphenate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_id", "chunk_text").distinct().select("chunk_id", text.dehyphenated(F.col("chunk_text")).alias("joined"))


@query("""SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(chunk_text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS flat
FROM (SELECT DISTINCT chunk_id, chunk_text FROM chunks)""")
def text_ws_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_id", "chunk_text").distinct().select("chunk_id", text.collapsed(F.col("chunk_text")).alias("flat"))


@query()
def text_clean_full(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.clean_text("text").alias("clean"))


@query()
def text_soft_wrap_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Line counts before and after wraps are undone."""
    lines = lambda c: F.size(F.split(c, "\n"))
    return catalog.once(table(spark, sf, "chunks"), "chunk_id").select("chunk_id", lines(F.col("chunk_text")).alias("before"), lines(text.clean_text("chunk_text")).alias("after"))


_ODD_URL = "CASE doc_id % 4 WHEN 1 THEN source || ' b' WHEN 2 THEN replace(source, '://', '://-') WHEN 3 THEN source || '/?u=http://a.example/b' ELSE source END"


def _odd_url(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with a blank at the end, a hyphen before the host, another address inside, and as they are."""
    kind, source = F.col("doc_id") % 4, F.col("source")
    odd = F.when(kind == 1, F.concat(source, F.lit(" b"))).when(kind == 2, F.replace(source, F.lit("://"), F.lit("://-"))).when(kind == 3, F.concat(source, F.lit("/?u=http://a.example/b"))).otherwise(source)
    return table(spark, sf, "documents").select("doc_id", odd.alias("url"))


@query(f"SELECT doc_id, regexp_matches(coalesce({_ODD_URL}, ''), '^https?://(?:[a-zA-Z0-9-]+\\.)+[a-zA-Z]{{2,}}(?::[0-9]+)?(?:/[^\\s]*)?$') AS is_url FROM documents")
def url_validate(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_url(spark, sf).select("doc_id", predicates.valid_url(F.col("url")).alias("is_url"))


@query(f"SELECT doc_id, substr(regexp_replace(regexp_replace({_ODD_URL}, 'https?://', '', 'g'), '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), 1, 80) || '.txt' AS slug FROM documents WHERE source IS NOT NULL")
def url_slug(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_url(spark, sf).where("url IS NOT NULL").select("doc_id", text.url_file_name(F.col("url")).alias("slug"))


@query(f"SELECT asset_id, regexp_replace({strip_sql('asset_name')}, '[^\\p{{L}}\\p{{N}}_.]', '', 'g') AS stored FROM (SELECT DISTINCT asset_id, asset_name FROM assets)")
def file_clean_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "assets").select("asset_id", "asset_name").distinct().select("asset_id", text.clean_file_name(F.col("asset_name")).alias("stored"))


_ENDS = "lower(regexp_extract(asset_name, '(\\.[^./\\\\]+)$', 1))"


@query(f"SELECT asset_id, CASE WHEN {_ENDS} IN ('.csv', '.xlsx', '.xls') THEN 'structured_data' ELSE 'file' END AS kind FROM (SELECT DISTINCT asset_id, asset_name FROM assets)")
def asset_type_case(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "assets").select("asset_id", "asset_name").distinct().select("asset_id", predicates.asset_type(F.col("asset_name")).alias("kind"))


_MEDIA = "CASE asset_id % 5 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'image/png' ELSE 'application/vnd.ms-excel' END"


@query(f"""SELECT asset_id, CASE WHEN asset_size * 100 > 10485760 THEN 'size_exceeded'
 WHEN m IN ('text/plain', 'application/pdf', 'text/markdown', 'text/csv') OR (e = '.md' AND m IN ('application/octet-stream', 'text/plain'))
  OR (e = '.csv' AND m IN ('text/csv', 'application/csv', 'application/vnd.ms-excel', 'text/plain', 'application/octet-stream'))
  OR (e = '.xlsx' AND m = 'application/octet-stream') OR (e = '.xls' AND m IN ('application/vnd.ms-excel', 'application/octet-stream')) THEN 'accepted'
 ELSE 'type_not_supported' END AS decision
FROM (SELECT DISTINCT asset_id, asset_size, {_MEDIA} AS m, {_ENDS} AS e FROM assets)""")
def upload_validate(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "assets").select("asset_id", "asset_name", "asset_size").distinct()
    media = F.element_at(F.array(*map(F.lit, ["application/octet-stream", "text/plain", "application/pdf", "image/png", "application/vnd.ms-excel"])), (F.col("asset_id") % 5 + 1).cast("int"))
    return a.select("asset_id", predicates.upload_decision(F.col("asset_name"), media, F.col("asset_size") * 100).alias("decision"))


@query(f"""SELECT request_id, CASE WHEN text IS NULL OR {strip_sql('text')} = '' THEN 'text_blank' WHEN length(text) > 500 THEN 'text_too_long'
 WHEN result_limit > 10 THEN 'limit_too_high' WHEN primary_lang IS NOT NULL AND lower({strip_sql('primary_lang')}) NOT IN ('en', 'ar') THEN 'language_not_supported' END AS problem
FROM (SELECT DISTINCT request_id, text, result_limit, primary_lang FROM search_requests)""")
def req_search_validate(spark: SparkSession, sf: str) -> DataFrame:
    r = catalog.once(table(spark, sf, "search_requests"), "request_id")
    return r.select("request_id", predicates.search_problem(F.col("text"), F.col("result_limit"), F.col("primary_lang")).alias("problem"))


def _page_html(c: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit("<p>"), x)), "\n")
    return F.concat(F.lit("<html><head><title> A "), F.col("doc_id").cast("string"), F.lit("</title></head><body><nav><p>menu menu menu menu menu menu</p></nav><article>"), body, F.lit("</article><footer>f</footer></body></html>"))


@query("SELECT doc_id, 'A ' || doc_id AS title FROM documents WHERE text IS NOT NULL")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", html.page_content(_page_html(F.col("text")))["title"].alias("title"))


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: {strip_sql('x')}), lambda x: length(x) > 20), chr(10) || chr(10)) AS page_text
FROM documents WHERE text IS NOT NULL""")
def html_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", html.page_content(_page_html(F.replace(F.col("text"), F.lit("\r"), F.lit("\n"))))["text"].alias("page_text"))


@query("""SELECT doc_id, 'first half' AS title, CASE doc_id % 4 WHEN 0 THEN 'outside the root, long enough' || chr(10) || chr(10) || 'inside a section that says main' ELSE 'inside the root, long enough' END AS page_text FROM documents""")
def html_root(spark: SparkSession, sf: str) -> DataFrame:
    """Only a div can be the root by its role; a section that says main is none."""
    n = F.col("doc_id") % 4
    inside = "<p>inside the root, long enough</p><p>too short</p>"
    body = F.when(n == 0, F.lit("<p>outside the root, long enough</p><div role='main2'><b></b></div><span role='main'><p>inside a section that says main</p></span>")).when(
        n == 1, F.lit(f"<p>outside the root, long enough</p><div role='main'>{inside}</div>")).when(n == 2, F.lit(f"<p>outside the root, long enough</p><main>{inside}</main>")).otherwise(F.lit(f"<main><p>outside the root, long enough</p></main><article>{inside}</article>"))
    page = F.concat(F.lit("<html><head><title> first half </title></head><body>"), body, F.lit("</body></html>"))
    return table(spark, sf, "documents").select("doc_id", html.page_content(page).alias("c")).select("doc_id", "c.title", F.col("c.text").alias("page_text"))


_FILE = "regexp_extract(m.source, '([^/]*)$', 1)"


@query(f"""
WITH b AS (SELECT DISTINCT chunk_id, chunk_metadata AS m FROM chunks), c AS (SELECT chunk_id, m, CASE chunk_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'image' ELSE m.content_type END AS kind, CASE WHEN chunk_id % 3 = 0 THEN 0 WHEN chunk_id % 3 = 1 THEN 4 ELSE m.table_index END AS nth FROM b),
f AS (SELECT *, CASE WHEN regexp_replace({_FILE}, '^[^_]*_', '') = '' THEN {_FILE} ELSE regexp_replace({_FILE}, '^[^_]*_', '') END AS file FROM c)
SELECT chunk_id, CASE WHEN m IS NULL OR m.source IS NULL OR m.source = '' THEN 'unknown'
 WHEN m.page IS NOT NULL THEN file || ' (Page: ' || m.page || coalesce(' | ' || CASE
   WHEN kind = 'table' AND nth <> 0 THEN concat_ws(' | ', 'Table: ' || nth, 'Rows: ' || nullif(m.row_range, ''))
   WHEN kind = 'image' AND m.image_index <> 0 THEN 'Image: ' || m.image_index WHEN kind = 'page_scan' THEN 'Scanned Page' END, '') || ')'
 WHEN m.format = 'structured_data' AND concat_ws(' | ', 'Sheet: ' || nullif(m.sheet_name, ''), 'Rows: ' || nullif(m.row_range, '')) <> ''
  THEN file || ' (' || concat_ws(' | ', 'Sheet: ' || nullif(m.sheet_name, ''), 'Rows: ' || nullif(m.row_range, '')) || ')' ELSE file END AS label FROM f""")
def cite_label(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the chunks, the kind of some and their table's number being changed: an index without its kind is not shown, nor is number 0."""
    meta, n = F.col("chunk_metadata"), F.col("chunk_id")
    kind = F.when(n % 5 == 0, "text").when(n % 5 == 1, "table").when(n % 5 == 2, "image").otherwise(meta["content_type"])
    nth = F.when(n % 3 == 0, 0).when(n % 3 == 1, 4).otherwise(meta["table_index"])
    changed = meta.withField("content_type", kind).withField("table_index", nth)
    return catalog.once(table(spark, sf, "chunks"), "chunk_id").select("chunk_id", text.citation_label(changed).alias("label"))


@query("SELECT chunk_id, m.format AS format, m.page AS page, m.content_type AS content_type, m IS NULL AS bare FROM (SELECT DISTINCT chunk_id, chunk_metadata AS m FROM chunks)")
def meta_struct(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.once(table(spark, sf, "chunks"), "chunk_id").select("chunk_id", *[F.col(f"chunk_metadata.{c}").alias(c) for c in ("format", "page", "content_type")], F.col("chunk_metadata").isNull().alias("bare"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN '{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' END, '{}') AS meta FROM events")
def meta_json(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.when(F.col("event_id") % 4 != 0, F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.lit(None).cast("string").alias("absent")))
    return table(spark, sf, "events").select("event_id", text.metadata_json(meta).alias("meta"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || chr(10) || chr(10) || user_id WHEN 1 THEN event_type END AS answer FROM events")
def ocr_json_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = F.format_string('{"pages":[{"markdown":" %s "},{"text":"%s"},{"text":" "}]}', F.col("event_type"), F.col("user_id").cast("string"))
    top = F.format_string('{"content":" %s "}', F.col("event_type"))
    body = F.when(F.col("event_id") % 3 == 0, pages).when(F.col("event_id") % 3 == 1, top).otherwise(F.lit('{"pages":[]}'))
    return table(spark, sf, "events").select("event_id", text.read_response(body).alias("answer"))


# chunking


@query()
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunks_of(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "piece_no", "chunk_text")


@query()
def chunk_order_stats(spark: SparkSession, sf: str) -> DataFrame:
    pieces = chunking.chunks_of(table(spark, sf, "documents").select("doc_id", "text"), "text")
    ordered = chunking.chunk_records(pieces, "doc_id", ["piece_no"])
    return ordered.groupBy("doc_id").agg(F.max("chunk_order").alias("chunks"), F.max(F.length("chunk_text")).alias("longest"))


_ATOMIC = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[' || p_name || ' | Page: 1] ' || chr(10) || chr(10) || repeat('abcdefghij', 161 + p_size)
 WHEN 1 THEN 'see[1]' || repeat('abcdefghij', 161 + p_size) WHEN 2 THEN '[' || p_name || ']' || repeat('abcdefghij', 161 + p_size) ELSE '[' || p_name || ']' || repeat('abcdefghij', p_size) END AS body FROM part"""


@query(f"""
WITH a AS ({_ATOMIC}),
h AS (SELECT p_partkey, body, length(body) <= 1600 AS whole, CASE p_partkey % 4 WHEN 0 THEN rtrim(split_part(body, chr(10), 1)) WHEN 2 THEN split_part(body, ']', 1) || ']' END AS head,
 CASE p_partkey % 4 WHEN 0 THEN ltrim(substr(body, length(split_part(body, chr(10), 1)) + 1), chr(10)) WHEN 2 THEN substr(body, length(split_part(body, ']', 1)) + 2) ELSE body END AS rest FROM a),
s AS (SELECT *, CASE WHEN head IS NULL THEN 800 ELSE greatest(200, 800 - length(head) - 2) END AS size FROM h),
o AS (SELECT *, CASE WHEN head IS NULL THEN 200 ELSE least(200, size // 2) END AS lap FROM s),
n AS (SELECT *, unnest(range(0, CAST(CASE WHEN whole THEN 1 ELSE 1 + ceil(greatest(length(rest) - size, 0) / (size - lap)::DOUBLE) END AS BIGINT))) AS k FROM o)
SELECT p_partkey, CAST(k AS INTEGER) AS piece_no, CASE WHEN whole THEN body ELSE coalesce(head || chr(10), '') || substr(rest, k * (size - lap) + 1, size) END AS chunk_text,
 CASE WHEN NOT whole AND head IS NOT NULL AND k > 0 THEN true END AS continuation FROM n""")
def chunk_header_split(spark: SparkSession, sf: str) -> DataFrame:
    """Elements with a header line, with a bracket that is none, with a header that no line feed ends, and short ones, through the split that keeps headers."""
    n, name = F.col("p_partkey") % 4, F.col("p_name")
    body = F.repeat(F.lit("abcdefghij"), 161 + F.col("p_size"))
    closed = F.concat(F.lit("["), name, F.lit("]"))
    whole = F.when(n == 0, F.concat(F.lit("["), name, F.lit(" | Page: 1] \n\n"), body)).when(n == 1, F.concat(F.lit("see[1]"), body)).when(n == 2, F.concat(closed, body)).otherwise(F.concat(closed, F.repeat(F.lit("abcdefghij"), F.col("p_size"))))
    return chunking.split_atomic(table(spark, sf, "part").select("p_partkey", whole.alias("body")), "body").select("p_partkey", "piece_no", "chunk_text", "continuation")


@query("SELECT coalesce(m.format = 'pdf', false) AS paged, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, chunk_metadata AS m FROM chunks) GROUP BY 1")
def chunk_router_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog.once(table(spark, sf, "chunks"), "chunk_id").select("chunk_id", F.col("chunk_metadata.format").alias("format"))
    paged, other = chunking.routed(c)
    return paged.select(F.lit(True).alias("paged")).unionByName(other.select(F.lit(False).alias("paged"))).groupBy("paged").agg(F.count("*").alias("chunks"))


@query("SELECT chunk_id, chunk_asset_id, row_number() OVER (PARTITION BY chunk_asset_id ORDER BY chunk_order, chunk_id) AS new_order FROM (SELECT DISTINCT chunk_id, chunk_asset_id, chunk_order FROM chunks)")
def chunk_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").select("chunk_id", "chunk_asset_id", F.col("chunk_order").alias("was")).distinct()
    return chunking.chunk_records(rows, "chunk_asset_id", ["was", "chunk_id"]).select("chunk_id", "chunk_asset_id", F.col("chunk_order").alias("new_order"))


@query()
def process_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), "project_key", F.col("text").alias("page_content"), F.struct("source").alias("metadata"))
    return pipeline.process_counts(pipeline.process(docs))


# structured rows

_ROW = "'Row ' || n || ':' || chr(10) || 'o_orderkey: ' || o_orderkey || ' | o_orderstatus: ' || o_orderstatus || ' | o_orderdate: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
_ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderdate"]


@query(f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey, o_orderstatus, o_orderdate) AS n, count(*) OVER () AS total FROM orders)
SELECT CAST((n - 1) // 50 AS INTEGER) AS bucket, ((n - 1) // 50 * 50 + 1) || '-' || least(((n - 1) // 50 + 1) * 50, max(total)) AS row_range, max(total) AS total_rows,
 string_agg({_ROW}, chr(10) || chr(10) ORDER BY n) AS rows_text FROM r GROUP BY (n - 1) // 50""")
def struct_rows_text(spark: SparkSession, sf: str) -> DataFrame:
    return structured.row_documents(table(spark, sf, "orders").select(*_ORDER_COLUMNS), [], _ORDER_COLUMNS, _ORDER_COLUMNS)


@query("""WITH r AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS t FROM customer)
SELECT c_mktsegment, CAST((n - 1) // 50 AS INTEGER) AS bucket, ((n - 1) // 50 * 50 + 1) || '-' || least(((n - 1) // 50 + 1) * 50, max(t)) AS row_range, max(t) AS total_rows FROM r GROUP BY c_mktsegment, (n - 1) // 50""")
def struct_row_buckets(spark: SparkSession, sf: str) -> DataFrame:
    docs = structured.row_documents(table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_name"), ["c_mktsegment"], ["c_custkey"], ["c_custkey", "c_name"])
    return docs.select("c_mktsegment", "bucket", "row_range", "total_rows")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row_no FROM events WHERE event_id % 3 <> 0")
def struct_dropna_renumber(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.col("event_id") % 3 == 0
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(~blank, F.col("event_type")).alias("a"), F.when(~blank, F.col("event_id")).alias("b"))
    return structured.numbered_rows(e, ["user_id"], ["event_id"], ["a", "b"]).select("user_id", "event_id", "row_no")


@query("SELECT o_orderpriority, count(*) AS total_rows, CAST((count(*) + 49) // 50 AS BIGINT) AS documents FROM orders GROUP BY o_orderpriority")
def sheet_totals(spark: SparkSession, sf: str) -> DataFrame:
    return structured.sheet_totals(table(spark, sf, "orders"), ["o_orderpriority"], _ORDER_COLUMNS)


# tables


def _part_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by brand as tables of pages: five brands a file."""
    cells = F.array(F.col("p_partkey").cast("string"), "p_name", "p_type")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("cells")))), lambda x: x["cells"])
    return table(spark, sf, "part").groupBy("p_brand").agg(rows.alias("rows"))


@query("SELECT p_partkey, '| ' || p_partkey || ' | ' || trim(p_name) || ' | ' || trim(p_type) || ' |' AS line FROM part")
def table_regular_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tables.row_line(F.array(F.col("p_partkey").cast("string"), "p_name", "p_type")).alias("line"))


@query("SELECT s_suppkey, 'Row ' || s_suppkey || ':' || chr(10) || 'key: ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' | name: ' || trim(s_name) ELSE '' END AS line FROM supplier")
def table_irregular_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    cells = F.when(F.col("s_suppkey") % 2 == 0, F.array(key, "s_name", F.lit("beyond"))).otherwise(F.array(key))
    return table(spark, sf, "supplier").select("s_suppkey", tables.row_pairs(key, F.array(F.lit("key"), F.lit("name")), cells).alias("line"))


@query("SELECT p_partkey, '[PDF Table | Page: ' || p_size || ' | Table: 1 | Rows: 1-' || p_size || ' | Columns: ' || CASE WHEN p_partkey % 2 = 0 THEN p_name || ', ' || p_type ELSE p_name || ' | ' || p_type END || ']' AS head FROM part")
def table_preamble(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select("p_partkey", tables.preamble(size, F.lit(1), F.concat(F.lit("1-"), size), F.array("p_name", "p_type"), F.col("p_partkey") % 2 == 0).alias("head"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [trim(p_name), 'col_2'] WHEN 1 THEN [trim(p_type), trim(p_brand)] ELSE ['col_1', trim(p_type)] END AS columns,
 CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 1 END AS body_rows FROM part""")
def table_header_fallback(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    names = F.when(kind == 0, F.array(F.col("p_name"), F.lit(" "))).when(kind == 1, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(F.array(F.lit(""), F.col("p_type")))
    columns, body = tables.header_names(names, F.array(F.array("p_type", "p_brand")))
    return table(spark, sf, "part").select("p_partkey", columns.alias("columns"), F.size(body).alias("body_rows"))


@query("""
WITH RECURSIVE l AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, length('| ' || p_partkey || ' | ' || trim(p_name) || ' | ' || trim(p_type) || ' |') + 1 AS size FROM part),
w AS (SELECT p_brand, n, size AS chars, 1 AS lines, 1 AS batch FROM l WHERE n = 1
 UNION ALL SELECT l.p_brand, l.n, CASE WHEN w.lines < 25 AND w.chars + l.size <= 650 THEN w.chars + l.size ELSE l.size END, CASE WHEN w.lines < 25 AND w.chars + l.size <= 650 THEN w.lines + 1 ELSE 1 END,
 CASE WHEN w.lines < 25 AND w.chars + l.size <= 650 THEN w.batch ELSE w.batch + 1 END FROM w JOIN l ON l.p_brand = w.p_brand AND l.n = w.n + 1)
SELECT p_brand, min(n) || '-' || max(n) AS row_range, CAST(max(chars) - 1 AS INTEGER) AS chars FROM w GROUP BY p_brand, batch""")
def table_greedy_batches(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform("rows", lambda r: tables.row_line(r))
    b = _part_tables(spark, sf).select("p_brand", F.explode(tables.greedy_batches(lines)).alias("b"))
    return b.select("p_brand", F.concat(F.col("b.first"), F.lit("-"), F.col("b.last")).alias("row_range"), F.length("b.text").alias("chars"))


_HEAD = "CASE n % 9 WHEN 1 THEN ['key' || b, 'name'] WHEN 3 THEN ['only' || b] WHEN 5 THEN ['col_1', 'part' || b] WHEN 6 THEN ['col_1', 'col_2', 'col_3'] WHEN 7 THEN ['a', 'col_2', 'c' || b] ELSE ['col_1', 'col_2'] END"


@query(f"""
WITH RECURSIVE p AS (SELECT o_custkey % 40 AS f, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey, o_custkey) AS n FROM orders),
h AS (SELECT f, n, {_HEAD} AS c, n % 9 IN (1, 3) AS real, n % 9 NOT IN (6, 0, 2, 4, 8) AS worth, n % 18 <> 7 AS has_rows FROM (SELECT f, n, n // 9 AS b FROM p)),
w AS (SELECT f, n, c AS used, CASE WHEN worth AND has_rows THEN c END AS held FROM h WHERE n = 1
 UNION ALL SELECT h.f, h.n, CASE WHEN NOT h.real AND len(w.held) = len(h.c) THEN w.held ELSE h.c END,
 CASE WHEN NOT h.real AND len(w.held) = len(h.c) THEN w.held WHEN h.worth AND h.has_rows THEN h.c ELSE w.held END FROM w JOIN h ON h.f = w.f AND h.n = w.n + 1)
SELECT f AS file_id, CAST(n AS INTEGER) AS page, used AS used_columns FROM w""")
def table_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pages of forty files, each with one table: real headers, headers made up in part or as a whole and of other widths, and tables without rows."""
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("o_orderkey", "o_custkey"))
    pages = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("file_id"), "o_orderkey", "o_custkey").withColumn("page", n)
    b, k = F.floor(F.col("page") / 9).cast("string"), F.col("page") % 9
    named = lambda prefix: F.concat(F.lit(prefix), b)
    head = (
        F.when(k == 1, F.array(named("key"), F.lit("name"))).when(k == 3, F.array(named("only"))).when(k == 5, F.array(F.lit("col_1"), named("part"))).when(k == 6, F.array(*map(F.lit, ("col_1", "col_2", "col_3"))))
        .when(k == 7, F.array(F.lit("a"), F.lit("col_2"), named("c"))).otherwise(F.array(F.lit("col_1"), F.lit("col_2")))
    )
    return tables.carried_columns(pages.select("file_id", "page", F.lit(1).alias("table_index"), head.alias("columns"), (F.col("page") % 18 != 7).alias("has_rows"))).select("file_id", "page", "used_columns")


@query("""
WITH p AS (SELECT o_custkey % 40 AS file_id, CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey, o_custkey) AS INTEGER) AS page FROM orders),
h AS (SELECT file_id, page, CASE WHEN page % 4 = 1 THEN ['key' || page // 4, 'name'] END AS real FROM p)
SELECT file_id, page, coalesce(real, last_value(real IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ['col_1', 'col_2']) AS used_columns FROM h""")
def table_latest_header(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("o_orderkey", "o_custkey"))
    pages = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("file_id"), "o_orderkey", "o_custkey").withColumn("page", n)
    head = F.when(F.col("page") % 4 == 1, F.array(F.concat(F.lit("key"), F.floor(F.col("page") / 4).cast("string")), F.lit("name"))).otherwise(F.array(F.lit("col_1"), F.lit("col_2")))
    return tables.latest_header(pages.withColumn("columns", head)).select("file_id", "page", "used_columns")


@query("""SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 5 = 0 AS degenerate, p_partkey % 3 <> 0 AS regular FROM part""")
def table_flags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    header = F.array(F.when(k % 4 == 0, F.lit(" ")).otherwise(F.lit("name")), F.when(k % 5 == 0, F.lit("col_2")).otherwise(F.lit("size")))
    rows = F.when(k % 3 == 0, F.array(F.array("p_name", "p_type"), F.array("p_name"))).otherwise(F.array(F.array("p_name", "p_type")))
    return table(spark, sf, "part").select("p_partkey", predicates.degenerate_header(header).alias("degenerate"), predicates.regular_rows(rows, F.size(header)).alias("regular"))


@query("""
WITH RECURSIVE r AS (SELECT p_brand, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 30 + 1 AS INTEGER) AS page, p_partkey, '| ' || p_partkey || ' | ' || trim(p_name) || ' | ' || trim(p_type) || ' |' AS line FROM part),
x AS (SELECT p_brand, page, 1 AS kind, p_partkey, line FROM r UNION ALL SELECT DISTINCT p_brand, page, 0, 0, '| col_1 | Body text | more |' FROM r WHERE page % 2 = 0
 UNION ALL SELECT DISTINCT p_brand, page, 2, 0, '|  |  |  |' FROM r),
l AS (SELECT p_brand, page, line, row_number() OVER (PARTITION BY p_brand, page ORDER BY kind, p_partkey) AS n FROM x),
w AS (SELECT p_brand, page, n, length(line) + 1 AS chars, 1 AS lines, 1 AS batch, line FROM l WHERE n = 1
 UNION ALL SELECT l.p_brand, l.page, l.n, CASE WHEN w.lines < 25 AND w.chars + length(l.line) + 1 <= 650 THEN w.chars + length(l.line) + 1 ELSE length(l.line) + 1 END, CASE WHEN w.lines < 25 AND w.chars + length(l.line) + 1 <= 650 THEN w.lines + 1 ELSE 1 END,
 CASE WHEN w.lines < 25 AND w.chars + length(l.line) + 1 <= 650 THEN w.batch ELSE w.batch + 1 END, l.line FROM w JOIN l ON l.p_brand = w.p_brand AND l.page = w.page AND l.n = w.n + 1)
SELECT p_brand AS file_id, page, min(n) || '-' || max(n) AS row_range,
 '[PDF Table | Page: ' || page || ' | Table: 1 | Rows: ' || min(n) || '-' || max(n) || ' | Columns: key, name, type]' || chr(10) || '| key | name | type |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS text
FROM w GROUP BY p_brand, page, batch""")
def table_serialize_full(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by brand as files whose table runs on over pages of thirty rows and a blank one: a real header first, then by turns a body row taken for a header and made-up names."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    paged = table(spark, sf, "part").withColumn("page", F.floor((place - 1) / 30).cast("int") + 1)
    cells = F.array(F.col("p_partkey").cast("string"), "p_name", "p_type")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("cells")))), lambda x: x["cells"])
    raw = paged.groupBy(F.col("p_brand").alias("file_id"), "page").agg(F.concat(rows, F.array(F.array(F.lit(" "), F.lit(None).cast("string"), F.lit("")))).alias("rows"))
    names = lambda *n: F.array(*map(F.lit, n))
    header = F.when(F.col("page") == 1, names("key", "name", "type")).when(F.col("page") % 2 == 0, names("col_1", "Body text", "more")).otherwise(names("col_1", "col_2", "col_3"))
    return tables.serialised(raw.select("file_id", "page", F.lit(1).alias("table_index"), header.alias("header"), "rows")).select("file_id", "page", "row_range", "text")


# geometry and layout, on boxes made of order lines

_BOX = """SELECT l_orderkey // 20 AS page, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
 CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0, l_partkey % 500 + 20 + l_quantity AS x1, CAST(l_suppkey * 7 % 700 + 10 + l_linenumber * 3 AS DOUBLE) AS y1 FROM lineitem"""
_INSIDE = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0))"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") * 7 % 700).cast("double")
    bbox = geometry.box(x0, y0, x0 + 20 + F.col("l_quantity"), y0 + 10 + F.col("l_linenumber") * 3)
    return li.select(F.floor(F.col("l_orderkey") / 20).alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", bbox.alias("bbox"), F.lit(560.0).alias("page_w"), F.lit(760.0).alias("page_h"))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(f"bbox.{c}") for c in ("x0", "y0", "x1", "y1")})


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(x0 - 40, 0), 4) AS left_x, round(least(y1, 600), 4) AS bottom FROM ({_BOX})
WHERE least(greatest(x1 - 40, 0), 500) - least(greatest(x0 - 40, 0), 500) > 1 AND least(y1, 600) - least(y0, 600) > 1""")
def geo_bbox_normalize(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    flipped = geometry.box(F.col("bbox.x1") - 40, F.col("bbox.y1"), F.col("bbox.x0") - 40, F.col("bbox.y0"))
    kept = b.withColumn("n", geometry.normalised(flipped, F.lit(500), F.lit(600))).where("n IS NOT NULL")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", F.round("n.x0", 4).alias("left_x"), F.round("n.y1", 4).alias("bottom"))


@query(f"""WITH v AS ({_BOX}) SELECT a.page, count(*) AS pairs, round(sum({_INSIDE}), 4) AS share
FROM v a JOIN v b ON a.page = b.page AND a.l_linenumber % 2 = 1 AND b.l_linenumber % 2 = 0 WHERE {_INSIDE} > 0 GROUP BY a.page""")
def geo_ioa(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    a, t = b.where("l_linenumber % 2 = 1").alias("a"), b.where("l_linenumber % 2 = 0").alias("t")
    share = geometry.share_inside(F.col("a.bbox"), F.col("t.bbox"))
    return a.join(t, (F.col("a.page") == F.col("t.page")) & (share > 0)).groupBy(F.col("a.page").alias("page")).agg(F.count("*").alias("pairs"), F.round(F.sum(share), 4).alias("share"))


@query(f"""WITH v AS ({_BOX}) SELECT page, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM v a WHERE l_linenumber % 2 = 1
 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.page = a.page AND b.l_linenumber % 2 = 0 AND {_INSIDE} > 0.6)""")
def geo_text_outside_tables(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    return layout.text_outside_tables(b.where("l_linenumber % 2 = 1"), b.where("l_linenumber % 2 = 0"), ["page"]).select("page", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n == 6, "table").when(n == 5, "image").otherwise("text")
    big = F.when(n == 5, geometry.box(F.lit(0.0), F.lit(0.0), F.lit(10.0) * F.col("l_quantity"), F.lit(700.0))).otherwise(F.col("bbox"))
    return boxes(spark, sf).withColumn("page", F.col("l_orderkey")).withColumn("content_type", kind).withColumn("bbox", big).withColumn("text", F.when(kind == "text", F.repeat(F.lit("x"), (F.col("l_quantity") / 2).cast("int"))))


@query("""
SELECT l_orderkey AS page, CAST(coalesce(sum(CASE WHEN l_linenumber NOT IN (5, 6) THEN CAST(trunc(l_quantity / 2) AS BIGINT) END), 0) AS BIGINT) AS chars, count(CASE WHEN l_linenumber = 6 THEN 1 END) AS tables,
 coalesce(sum(CASE WHEN l_linenumber NOT IN (5, 6) THEN CAST(trunc(l_quantity / 2) AS BIGINT) END), 0) < 50 AND count(CASE WHEN l_linenumber = 6 THEN 1 END) = 0
  AND coalesce(max(CASE WHEN l_linenumber = 5 THEN 10 * l_quantity * 700 END) / (560.0 * 760.0) >= 0.5, false) AS is_scanned
FROM lineitem GROUP BY l_orderkey""")
def geo_scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return layout.scanned_pages(_elements(spark, sf), ["page"]).select("page", "chars", "tables", "is_scanned")


@query(f"""WITH v AS ({_BOX}), m AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
g AS (SELECT page, l_orderkey, l_linenumber, y0, y1, CAST(sum(coalesce(CAST(y0 > reach + 4 AS INTEGER), 0)) OVER (PARTITION BY page ORDER BY y0, y1 RANGE UNBOUNDED PRECEDING) AS BIGINT) AS band FROM m)
SELECT page, band, count(*) AS elements, min(y0) AS top, max(y1) AS bottom FROM g GROUP BY page, band""")
def geo_gap_bands(spark: SparkSession, sf: str) -> DataFrame:
    g = layout.gap_groups(_flat(boxes(spark, sf)), ["page"], "y0", "y1", 4.0)
    return g.groupBy("page", "band").agg(F.count("*").alias("elements"), F.min("y0").alias("top"), F.max("y1").alias("bottom"))


@query(f"""WITH v AS ({_BOX}), m AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
g AS (SELECT page, x0, CAST(sum(coalesce(CAST(x0 > reach + 6 AS INTEGER), 0)) OVER (PARTITION BY page ORDER BY x0, x1 RANGE UNBOUNDED PRECEDING) AS BIGINT) AS col FROM m),
c AS (SELECT page, col, min(x0) AS left_x FROM g GROUP BY page, col)
SELECT page, left_x, row_number() OVER (PARTITION BY page ORDER BY left_x DESC) AS place FROM c""")
def geo_columns_rtl(spark: SparkSession, sf: str) -> DataFrame:
    g = layout.gap_groups(_flat(boxes(spark, sf)), ["page"], "x0", "x1", 6.0, name="col")
    c = g.groupBy("page", "col").agg(F.min("x0").alias("left_x"))
    return c.select("page", "left_x", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("left_x"))).alias("place"))


@query(f"""WITH v AS ({_BOX}), m AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
g AS (SELECT page, x0, x1, CAST(sum(coalesce(CAST(x0 > reach + 6 AS INTEGER), 0)) OVER (PARTITION BY page ORDER BY x0, x1 RANGE UNBOUNDED PRECEDING) AS BIGINT) AS col FROM m)
SELECT page, col, min(x0) AS left_x, bool_or(x1 - x0 >= 0.65 * 100) AS spans FROM g GROUP BY page, col""")
def layout_column_min(spark: SparkSession, sf: str) -> DataFrame:
    g = layout.gap_groups(_flat(boxes(spark, sf)), ["page"], "x0", "x1", 6.0, name="col")
    return g.groupBy("page", "col").agg(F.min("x0").alias("left_x"), F.bool_or(F.col("x1") - F.col("x0") >= DEFAULTS.full_width_share * 100).alias("spans"))


@query(f"""SELECT page, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
 row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / 8, 0), x0, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place FROM ({_BOX})""")
def geo_fallback_sort(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    order = Window.partitionBy("page").orderBy(*layout.line_order(F.col("bbox.y0"), F.col("bbox.x0"), 8.0), *keys)
    return boxes(spark, sf).select("page", *keys, F.row_number().over(order).alias("place"))


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"""
WITH RECURSIVE e AS (SELECT l_orderkey // 4 AS page, * EXCLUDE (page) FROM ({_BOX})),
r AS (
 SELECT *, row_number() OVER (PARTITION BY page ORDER BY {_KEYS}) AS rank, [0::BIGINT] AS path, 0 AS step, count(*) OVER (PARTITION BY page) = 1 AS done FROM e
 UNION ALL
 SELECT page, {_KEYS}, x0, y0, x1, y1, new_rank, CASE WHEN stop THEN path ELSE list_append(path, place) END, step + 1, stop OR members = 1
 FROM (SELECT *, CASE WHEN step % 2 = 0 OR parts = 1 OR blocked THEN part ELSE dense_rank() OVER (PARTITION BY page, path ORDER BY left_x, part) END AS place,
   CASE WHEN parts = 1 OR (step % 2 = 1 AND blocked) THEN rank ELSE axis_rank END AS new_rank, step % 2 = 1 AND (parts = 1 OR blocked) AS stop,
   count(*) OVER (PARTITION BY page, path, CASE WHEN step % 2 = 1 AND blocked THEN 0 ELSE part END) AS members
  FROM (SELECT *, max(part) OVER (PARTITION BY page, path) + 1 AS parts, min(x0) OVER (PARTITION BY page, path, part) AS left_x
   FROM (SELECT *, CAST(sum(coalesce(CAST(low > reach + gap AS INTEGER), 0)) OVER (PARTITION BY page, path ORDER BY axis_rank) AS BIGINT) AS part, bool_or(x1 - x0 >= 0.65 * 560) OVER (PARTITION BY page, path) AS blocked
    FROM (SELECT *, max(high) OVER (PARTITION BY page, path ORDER BY axis_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
     FROM (SELECT *, row_number() OVER (PARTITION BY page, path ORDER BY low, rank) AS axis_rank
      FROM (SELECT *, CASE WHEN step % 2 = 0 THEN y0 ELSE x0 END AS low, CASE WHEN step % 2 = 0 THEN y1 ELSE x1 END AS high, CASE WHEN step % 2 = 0 THEN 0.015 * 760 ELSE 0.02 * 560 END AS gap FROM r WHERE NOT done))))))
)
SELECT page, {_KEYS}, CAST(row_number() OVER (PARTITION BY page ORDER BY path, round_even(y0 / 7.6, 0), x0, rank) - 1 AS INTEGER) AS reading_order FROM r WHERE done""")
def geo_xycut(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as boxes on pages of four orders, put in reading order by recursive cuts."""
    keys = _KEYS.split(", ")
    pages = boxes(spark, sf).withColumn("page", F.floor(F.col("l_orderkey") / 4))
    return layout.reading_order(pages, ["page"], keys).select("page", *keys, "reading_order")


@query("""
WITH e AS (SELECT l_orderkey AS page, l_partkey % 3 AS xref, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, (20 + l_quantity) * (10 + l_linenumber * 3) / (560.0 * 760.0) AS share, l_suppkey % 5 AS n_bytes FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY page, xref ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS first FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS image_index FROM f WHERE first = 1 AND share >= 0.002 AND n_bytes > 0)
SELECT page, xref, l_linenumber, image_index FROM k WHERE image_index <= 2""")
def img_candidates(spark: SparkSession, sf: str) -> DataFrame:
    images = boxes(spark, sf).withColumns({"page": F.col("l_orderkey"), "xref": F.col("l_partkey") % 3, "n_bytes": F.col("l_suppkey") % 5})
    return layout.image_candidates(images, ["page"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], share=0.002, most=2).select("page", "xref", "l_linenumber", "image_index")


@query("""SELECT l_orderkey AS page, l_linenumber AS image_index, '[Image Description | Page: ' || l_orderkey || ' | Image: ' || l_linenumber || ']' || chr(10) || 'image ' || substr(sha256(CAST(l_partkey AS VARCHAR)), 1, 8) AS text
FROM lineitem WHERE l_linenumber NOT IN (3, 4)""")
def image_body_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Third images have no description, fourth ones an empty one; the others' are padded."""
    images = boxes(spark, sf).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("image_index"), "l_partkey")
    seen = F.when(F.col("image_index") == 4, "").when(F.col("image_index") != 3, F.concat(F.lit(" \n"), services.vision("stub")(F.col("l_partkey").cast("string")), F.lit("\t ")))
    return layout.described_elements(images, seen).select("page", "image_index", "text")


@query("""SELECT l_orderkey AS page, '[Page Scan | Page: ' || l_orderkey || ']' || chr(10) || 'image ' || substr(sha256(CAST(l_orderkey AS VARCHAR)), 1, 8) || ' goes on' AS text, 600.0::DOUBLE AS right_x
FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) >= 5 AND max(l_linenumber) <> 6""")
def image_scan_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Scans' texts come cleaned, with the page as their box; some pages are read as nothing."""
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.max("l_linenumber").alias("most"), (F.max("l_linenumber") >= 5).alias("is_scanned"))
    sized = pages.withColumns({"page_w": F.lit(600.0), "page_h": F.lit(800.0)})
    read = F.when(F.col("most") == 6, "").otherwise(F.concat(F.lit("  "), services.vision("stub")(F.col("page").cast("string")), F.lit(" \ngoes \u0007 on ")))
    return layout.scan_elements(sized, read).select("page", "text", F.col("bbox.x1").alias("right_x"))


@query("""SELECT p_partkey, CAST(greatest(1, floor(w * least(1, 1600.0::DOUBLE / greatest(w, h)))) AS INTEGER) AS width, CAST(greatest(1, floor(h * least(1, 1600.0::DOUBLE / greatest(w, h)))) AS INTEGER) AS height
FROM (SELECT p_partkey, p_size * 100 AS w, p_partkey % 3000 + 1 AS h FROM part)""")
def image_resize_dims(spark: SparkSession, sf: str) -> DataFrame:
    size = geometry.resized(F.col("p_size") * 100, F.col("p_partkey") % 3000 + 1)
    return table(spark, sf, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


_ORDERED = "row_number() OVER (PARTITION BY l_orderkey // 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1"


@query(f"""WITH e AS (SELECT l_orderkey // 20 AS page, {_ORDERED} AS o, l_partkey FROM lineitem),
i AS (SELECT *, CAST(sum(CASE WHEN o % 5 = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY o) AS BIGINT) AS island FROM e)
SELECT page, island, string_agg('part ' || l_partkey, chr(10) || chr(10) ORDER BY o) AS body, CAST(count(*) AS INTEGER) AS pieces FROM i WHERE o % 5 <> 4 GROUP BY page, island""")
def page_text_islands(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    e = boxes(spark, sf).withColumn("reading_order", F.row_number().over(order) - 1)
    e = e.withColumn("content_type", F.when(F.col("reading_order") % 5 == 4, "table").otherwise("text")).withColumn("text", F.concat(F.lit("part "), "l_partkey"))
    return layout.text_islands(e, ["page"]).select("page", "island", "body", "pieces")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_linenumber = 4 THEN -1 ELSE l_linenumber END, l_orderkey, l_partkey, l_quantity, l_extendedprice) - 1 AS position FROM lineitem""")
def page_reading_sort(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").withColumn("page", F.when(F.col("l_linenumber") != 4, F.col("l_linenumber")))
    keys = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]
    return layout.page_order(e, "l_suppkey", "page", keys).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "position")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN p_name || ' end' WHEN 2 THEN 'example ' || p_name ELSE 'one ' || p_name || ' two' END AS text FROM part WHERE p_partkey % 5 IN (1, 2, 4)""")
def block_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of spans: of control characters only, with odd spacing, with a cut word, of another type, and with a wrapped line."""
    n, name = F.col("p_partkey") % 5, F.col("p_name")
    one = lambda *spans: F.array(F.array(*[s if isinstance(s, Column) else F.lit(s) for s in spans]))
    two = lambda a, b: F.concat(one(*a), one(*b))
    spans = F.when(n == 0, one(" \u0001", "​ ")).when(n == 1, one("  ", name, " \t  end ")).when(n == 2, two(["exam-"], ["ple ", name])).when(n == 3, one(name)).otherwise(two(["one"], [name, " two"]))
    blocks = table(spark, sf, "part").select("p_partkey", F.when(n == 3, 1).otherwise(0).alias("block_type"), text.block_text(spans).alias("text"))
    return layout.clean_blocks(blocks).select("p_partkey", "text")


@query("SELECT doc_id, strlen(text) AS n_bytes, strlen(text) <= 1000 AS fits FROM documents WHERE text IS NOT NULL")
def payload_guard(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), predicates.within_bytes(F.col("text"), 1000).alias("fits"))
