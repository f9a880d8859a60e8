from __future__ import annotations

from pyspark.sql import functions as F

from corvella import schemas
from corvella.operators import layout, ledger, tables


def box(*c):
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, c)))


def test_assembled_pages(spark):
    rows = [
        ("f", 1, 1, 600.0, 800.0, "text", box(50, 20, 550, 40), "Heading", None, None, None, None),
        ("f", 1, 2, 600.0, 800.0, "text", box(60, 110, 200, 120), "inside the table", None, None, None, None),
        ("f", 1, 3, 600.0, 800.0, "text", box(550, 300, 50, 400), "below, corners swapped " * 5, None, None, None, None),
        ("f", 1, 4, 600.0, 800.0, "image", box(50, 500, 550, 700), None, None, None, 7, 10),
        ("f", 1, 5, 600.0, 800.0, "image", box(50, 500, 550, 700), None, None, None, 7, 10),
        ("f", 2, 1, 600.0, 800.0, "image", box(0, 0, 600, 800), None, None, None, 8, 10),
        ("f", 2, 2, 600.0, 800.0, "text", box(50, 20, 550, 40), "7", None, None, None, None),
    ]
    elements = spark.createDataFrame(rows, schemas.ELEMENTS)
    raw = spark.createDataFrame([("f", 1, 1, ["a", "b"], [["1", "2"]])], schemas.RAW_TABLES)
    tabled = tables.serialised(raw).withColumn("bbox", F.struct(*[F.lit(float(v)).alias(k) for k, v in box(50, 100, 550, 200).items()]))
    docs = layout.assembled_pages(elements, tabled, read=F.lit("read text"), describe=F.lit("a picture"))
    got = [(r.page, r.metadata.content_type, r.page_content.split("\n")[-1][:20]) for r in docs.orderBy("page", "reading_order").collect()]
    assert got == [(1, "text", "Heading"), (1, "table", "| 1 | 2 |"), (1, "text", "below, corners swapp"), (1, "image", "a picture"), (2, "page_scan", "read text")]
    plain = layout.assembled_pages(elements, tabled)
    assert plain.where("page = 2").first().page_content == "7" and plain.count() == 4
    assert layout.assembled_pages(elements.limit(0), tabled.limit(0)).count() == 0


def test_table_header_states(spark):
    rows = [("f", 1, 1, ["id", "name"]), ("f", 2, 1, ["col_1", "col_2"]), ("f", 3, 1, ["only"]), ("f", 4, 1, ["col_1", ""]), ("g", 1, 1, ["col_1", "x"])]
    got = {(r.file_id, r.page): r.used_columns for r in tables.carried_columns(spark.createDataFrame(rows, "file_id string, page int, table_index int, columns array<string>")).collect()}
    assert got == {("f", 1): ["id", "name"], ("f", 2): ["id", "name"], ("f", 3): ["only"], ("f", 4): ["col_1", ""], ("g", 1): ["col_1", "x"]}


def _tabled(spark, *pages):
    rows = [("f", p, 1, header, body) for p, (header, body) in enumerate(pages, 1)]
    found = tables.serialised(spark.createDataFrame(rows, schemas.RAW_TABLES)).orderBy("page", "row_range").collect()
    return [(r.page, r.row_range, r.columns, r.text.split("\n")[1:]) for r in found]


def test_mistaken_headers_go_back_to_the_body(spark):
    got = _tabled(spark, (["a", "b"], [["1", "2"]]), (["col_1", "Body text row"], [["3", "4"]]), (["", "Last"], [[None, None]]))
    assert [g[2] for g in got] == [["a", "b"]] * 3
    assert got[1][3] == ["| a | b |", "| --- | --- |", "| col_1 | Body text row |", "| 3 | 4 |"] and got[1][1] == "1-2"
    assert got[2][3][2:] == ["|  | Last |", "|  |  |"]


def test_headers_made_up_as_a_whole_are_not_held(spark):
    got = _tabled(spark, (["a", "b"], [["1", "2"]]), (["col_1", "col_2", "col_3"], [["1", "2", "3"]]), (["col_1", "col_2"], [["3", "4"]]), (["x", "y"], []), (["col_1", "col_2"], [["5", "6"]]))
    assert [(g[0], g[2]) for g in got] == [(1, ["a", "b"]), (2, ["col_1", "col_2", "col_3"]), (3, ["a", "b"]), (5, ["a", "b"])]


def test_first_rows_as_headers_over_page_ends(spark):
    got = _tabled(spark, (["a", "b"], [["1", "2"]]), (["", " "], [["", "more"]]))
    assert got[1][2] == ["a", "b"] and got[1][3][2:] == ["|  | more |"]  # the only row was taken for the header


def test_one_file_with_many_pages(spark):
    n = 3000
    df = spark.range(1, n + 1).selectExpr("'f' AS file_id", "cast(id AS int) AS page", "1 AS table_index", "CASE WHEN id % 700 = 1 THEN array('k' || id, 'v') ELSE array('col_1', 'col_2') END AS columns")
    got = {r.page: r.used_columns[0] for r in tables.carried_columns(df).collect()}
    assert got == {p: f"k{(p - 1) // 700 * 700 + 1}" for p in range(1, n + 1)}


def test_ledger_life(spark):
    base = spark.createDataFrame([], schemas.LEDGER)
    tasks = spark.createDataFrame([("t", "h1"), ("t", "h1"), ("t", "h2")], "task_name string, task_args_hash string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    one = ledger.recorded(base, tasks, now)
    assert one.count() == 2 and ledger.recorded(one, tasks, now).count() == 2
    assert {(r.status, r.started_at is not None) for r in one.collect()} == {("PENDING", True)}
    assert ledger.decisions(tasks.distinct(), one, now).where("run").count() == 0  # what has just been entered doesn't run again
    entry = one.where("task_args_hash = 'h1'").withColumn("execution_id", F.lit(1))
    begun = ledger.updated(entry, spark.createDataFrame([(1, "STARTED", "")], "execution_id int, new_status string, new_result string"), now).first()
    assert begun.status == "STARTED" and begun.started_at is not None and begun.completed_at is None


def test_task_decisions(spark):
    now, base = F.lit(10_000).cast("timestamp"), "case when a is null then null else timestamp_seconds(10000 - a) end"
    rows = [("STARTED", 660, False), ("STARTED", 661, True), ("SUCCESS", 5, False), ("FAILURE", 5, True), (None, None, True), ("PENDING", None, False)]
    df = spark.createDataFrame(rows, "status string, a int, want boolean").withColumn("started_at", F.expr(base))
    assert df.where(~(ledger.should_run(F.col("status"), F.col("started_at"), now) == F.col("want"))).count() == 0


def test_written_chunks_are_counted(spark, tmp_path):
    from corvella.operators import catalog

    df = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 6, "c")], "chunk_id int, chunk_project_id int, chunk_text string")
    target = str(tmp_path / "chunks")
    assert catalog.write_chunks(df, target) == 3
    assert catalog.write_chunks(df.where("chunk_id = 2"), target) == 1  # its project's files are replaced, the other's stay
    assert {r.chunk_id for r in spark.read.parquet(target).collect()} == {2, 3}
    assert catalog.deleted_counts(df, 5).first().deleted == 2
