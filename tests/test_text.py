"""Golden cases of the text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from corvella.functions import predicates, text
from corvella.functions.html import extract
from corvella.operators import chunking, layout, ledger, metrics, structured, tables, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    ("given_text", "clean"),
    [
        ("exam-\nple", "example"), ("pre- \nfix", "pre-fix"), ("facial\ncues to identify", "facial cues to identify"), ("First one.\nSecond one", "First one.\nSecond one"),
        ("end of it.\nlower start", "end of it. lower start"), ("Steps\n1. one\n2. two", "Steps\n1. one\n2. two"), ("a\n\n\n\nb", "a\n\nb"), ("ﬁle", "file"), ("", ""), (None, ""), ("a\x00b​c", "abc"),
    ],
)
def test_clean_text(given_text, clean):
    assert text.clean_text_py(given_text) == clean


def test_strip_and_cells(spark):
    assert one(spark, text.strip(F.lit("   a b 　\n"))) == "a b"
    assert one(spark, text.clean_cell(F.lit(" z \n y "))) == "z y"
    assert one(spark, text.clean_cell(F.lit(None).cast("string"))) == ""
    assert one(spark, text.truncated(F.lit("ab cd ef"), 6)) == "ab cd"
    assert one(spark, text.clean_file_name(F.lit(" my report (1).pdf"))) == "myreport1.pdf"
    assert one(spark, text.url_file_name(F.lit("https://ex.com/a-b?c=1"))) == "ex_com_a_b_c_1.txt"
    assert one(spark, text.collection_name(F.lit(64), F.lit(7))) == "collection_64_7"


def meta(**given):
    kinds = {"source": "string", "format": "string", "page": "int", "content_type": "string", "table_index": "int", "row_range": "string", "image_index": "int", "sheet_name": "string"}
    return F.struct(*[F.lit(given.get(k)).cast(t).alias(k) for k, t in kinds.items()])


@pytest.mark.parametrize(
    ("given_meta", "label"),
    [
        ({"source": "/d/k1_report.pdf", "page": 12, "content_type": "text"}, "report.pdf (Page: 12)"),
        ({"source": "/d/k1_report.pdf", "page": 4, "content_type": "table", "table_index": 1, "row_range": "51-70"}, "report.pdf (Page: 4 | Table: 1 | Rows: 51-70)"),
        ({"source": "/d/k1_report.pdf", "page": 8, "content_type": "image", "image_index": 2}, "report.pdf (Page: 8 | Image: 2)"),
        ({"source": "/d/k1_report.pdf", "page": 4, "content_type": "text", "table_index": 1}, "report.pdf (Page: 4)"), ({"source": "/d/k1_report.pdf", "page": 4, "content_type": "table", "table_index": 0}, "report.pdf (Page: 4)"),
        ({"source": "d\\k1_a.pdf"}, "a.pdf"),
        ({"source": "/d/k1_report.pdf", "page": 1, "content_type": "page_scan"}, "report.pdf (Page: 1 | Scanned Page)"),
        ({"source": "k_data.xlsx", "format": "structured_data", "sheet_name": "Q4", "row_range": "51-100"}, "data.xlsx (Sheet: Q4 | Rows: 51-100)"),
        ({"source": "my_report.pdf"}, "report.pdf"), ({"source": "k_"}, "k_"), ({}, "unknown"),
    ],
)
def test_citation_label(spark, given_meta, label):
    assert one(spark, text.citation_label(meta(**given_meta))) == label


def test_args_hash(spark):
    import hashlib
    import json

    told = {"b": 2, "a": None, "c": "k_é\n\x01😀", "d": True, "e": 1e20, "f": 0.1, "task_name": 'x "y" \\ z'}
    args = {k: F.lit(v) for k, v in told.items() if k not in ("a", "task_name")}
    got = one(spark, ledger.args_hash(F.lit('x "y" \\ z'), {**args, "a": F.lit(None).cast("int")}))
    assert got == hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def test_urls_and_requests(spark):
    for url, ok in (("http://a.com/a b", False), ("http://-a-.com", True), ("http://a.com", True), ("http://a.com/", True), ("http://a.com?q", False), ("http://localhost/x", False), ("ftp://a.com", False), ("https://a.example.com:8080/p?q", True), (None, False)):
        assert one(spark, predicates.valid_url(F.lit(url).cast("string"))) is ok
    ask = lambda t, n, lang: one(spark, predicates.search_problem(F.lit(t).cast("string"), F.lit(n).cast("int"), F.lit(lang).cast("string")))
    assert ask("q", 11, None) == "limit_too_high"
    assert ask("q" * 501, 5, None) == "text_too_long"
    assert ask("q", None, " AR ") is None
    assert ask("  ", 5, None) == "text_blank"
    assert one(spark, predicates.upload_decision(F.lit("a.csv"), F.lit("application/octet-stream"), F.lit(10))) == "accepted"
    assert one(spark, predicates.upload_decision(F.lit("a.csv"), F.lit("image/png"), F.lit(10))) == "type_not_supported"


@pytest.mark.parametrize(
    ("lines", "spans"),
    [([99] * 30, ["1-6", "7-12", "13-18", "19-24", "25-30"]), ([9] * 30, ["1-25", "26-30"]), ([1000, 10, 10], ["1-1", "2-3"]), ([], [])],
)
def test_greedy_batches(spark, lines, spans):
    column = F.array(*[F.lit("x" * n) for n in lines]) if lines else F.array().cast("array<string>")
    assert [f"{b['first']}-{b['last']}" for b in one(spark, tables.greedy_batches(column))] == spans


@pytest.mark.parametrize(
    ("body", "size", "overlap", "chunks"),
    [("aaa bbb ccc ddd", 10, 0, ["aaa bbb", "ccc ddd"]), ("aaa bbb ccc ddd", 10, 4, ["aaa bbb", "bbb ccc", "ccc ddd"]), ("abcdefghij", 5, 0, ["abcde", "fghij"]), ("", 5, 0, []), (None, 5, 0, [])],
)
def test_recursive_split(body, size, overlap, chunks):
    assert chunking.recursive_split(body, size, overlap) == chunks


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(1, 40), st.data())
def test_recursive_split_limits(body, size, data):
    chunks = chunking.recursive_split(body, size, data.draw(st.integers(0, size)))
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(body.split())) == set("".join("".join(chunks).split()))


def test_recursive_split_rejects():
    with pytest.raises(ValueError, match="overlap"):
        chunking.recursive_split("a", 5, 6)


def test_headers_of_split_tables(spark):
    inner, lap = chunking.inner_sizes(F.lit("h" * 60), 800, 200)
    assert (one(spark, inner), one(spark, lap)) == (738, 200)
    inner, lap = chunking.inner_sizes(F.lit("h" * 700), 800, 200)
    assert (one(spark, inner), one(spark, lap)) == (200, 100)
    body = "[T]\n" + "word " * 400
    rows = chunking.split_atomic(spark.createDataFrame([(1, body), (2, "x" * 1600)], "id int, text string"), "text").orderBy("id", "piece_no").collect()
    assert [r.chunk_text for r in rows if r.id == 2] == ["x" * 1600]
    cut = [r for r in rows if r.id == 1]
    assert len(cut) > 1 and all(r.chunk_text.startswith("[T]\n") and len(r.chunk_text) <= 800 for r in cut)
    assert [r.continuation for r in cut] == [None] + [True] * (len(cut) - 1)


def test_page_chunks_keep_order(spark):
    rows = [("f", 1, 0, "text", "one"), ("f", 1, 1, "table", "[T]\n| a |"), ("f", 1, 2, "text", "two"), ("f", 1, 3, "text", "three")]
    out = chunking.page_chunks(spark.createDataFrame(rows, "file string, page int, reading_order int, content_type string, text string"), ["file", "page"]).orderBy("reading_order").collect()
    assert [(r.content_type, r.chunk_text) for r in out] == [("text", "one"), ("table", "[T]\n| a |"), ("text", "two\n\nthree")]


def test_html():
    page = "<html><head><title>T</title></head><body><header><h1>gone</h1></header><nav><p>menu menu menu menu menu</p></nav><main><section><p>long enough paragraph <b>bold &amp; more<p>second long enough paragraph</section><script>var x = '</p>';</script></main>"
    title, paragraphs = extract(page)
    assert title == "T"
    assert paragraphs == ["long enough paragraph bold & more second long enough paragraph", "long enough paragraph bold & more", "second long enough paragraph"] or paragraphs[0].startswith("long enough paragraph bold & more")
    assert extract(None) == ("", [])
    assert extract("<p>" + "a" * 20)[1] == [] and extract("<p>" + "a" * 21)[1] == ["a" * 21]


def test_row_text(spark):
    df = spark.createDataFrame([(1, None, 1.5)], "a int, b string, c double")
    assert df.select(structured.row_text(df, F.lit(1), ["a", "b", "c"]).alias("t")).first().t == "Row 1:\na: 1 | b: N/A | c: 1.5"
    docs = structured.row_documents(spark.range(120).selectExpr("1 AS s", "id"), ["s"], ["id"], ["id"]).orderBy("bucket").collect()
    assert [(d.row_range, d.total_rows) for d in docs] == [("1-50", 120), ("51-100", 120), ("101-120", 120)]


@pytest.mark.parametrize("rtl", [False, True])
def test_reading_order(spark, rtl):
    shapes = [("H", 50, 20, 550, 40), ("A", 50, 60, 280, 400), ("B", 320, 60, 550, 400)]
    rows = [("f", n, {"x0": float(a), "y0": float(b), "x1": float(c), "y1": float(d)}, 600.0, 800.0) for n, a, b, c, d in shapes]
    df = spark.createDataFrame(rows, "file string, n string, bbox struct<x0: double, y0: double, x1: double, y1: double>, page_w double, page_h double")
    got = [r.n for r in layout.reading_order(df, ["file"], ["n"], rtl).orderBy("reading_order").collect()]
    assert got == (["H", "B", "A"] if rtl else ["H", "A", "B"])


def test_search_edges(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0])], "id int, vector array<float>")
    got = [(r.id, r.score) for r in vectors.search(rows.where("id <> 1"), [1.0, 0.0], 5).collect()]
    assert got[:2] == [(2, 1.0), (5, 1.0)]
    assert vectors.search(rows, [], 5).count() == 0
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, query_vector array<float>")
    best = vectors.batch_search(rows, queries, 2).orderBy("place").collect()
    assert [r.id for r in best] == [1, 2]  # the all-zero vector scores NaN, which ranks first
    assert vectors.batch_search(rows.limit(0), queries, 2).count() == 0
    assert vectors.batch_search(rows, queries.limit(0), 2).count() == 0


def test_batch_search_in_blocks_is_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((300, 4)), 1)  # coarse, so that scores tie
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<float>").repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 10)], "query_id int, query_vector array<float>")
    f = x.astype(np.float32).astype(float)
    dots = f @ f.T
    want = {(q, int(i)) for q in range(0, 300, 10) for i in np.lexsort((np.arange(300), -dots[q]))[:4]}
    kept = vectors.QUERY_BLOCK
    try:
        for vectors.QUERY_BLOCK in (kept, 7):
            got = {(r.query_id, r.id) for r in vectors.batch_search(rows, queries, 4, metric="dot").collect()}
            assert got == want
    finally:
        vectors.QUERY_BLOCK = kept
    text_keys = rows.selectExpr("'k' || id AS id", "vector")
    assert vectors.batch_search(text_keys, queries, 2).count() == 60


def test_histogram_of_nothing(spark):
    empty = spark.createDataFrame([], "method string, endpoint string, status int, duration_s double")
    assert metrics.latency_histogram(empty).count() == 0
