from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from corvella.config import Settings
from corvella.operators import catalog, retrieval, services
from corvella.runtime import marked, materialise, release, scratch_root
from corvella.sources import files
from corvella.streaming import ingest


def docx(paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            cells = ""
            for row in rows:
                cells += "<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>" for v in row) + "</row>"
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def folder(tmp_path):
    (tmp_path / "k_a.txt").write_text("plain text", "utf-8")
    (tmp_path / "b.md").write_text("# Title\n\n- **one**\n- [two](http://x.example)\n\n```\ncode\n```", "utf-8")
    (tmp_path / "c.csv").write_bytes("a,b\n1,caf\xe9\n2,x,extra\n3\n".encode("latin-1"))
    (tmp_path / "d.docx").write_bytes(docx(["first", "second"]))
    (tmp_path / "e.xlsx").write_bytes(xlsx({"S1": [["a", "b"], [1, "x"]], "S2": [["c"], [2.5]]}))
    (tmp_path / "f.docx").write_bytes(b"broken")
    (tmp_path / "g.exe").write_bytes(b"unknown")
    return str(tmp_path)


def test_files(spark, tmp_path):
    found = files.read_files(spark, folder(tmp_path))
    assert [r.name for r in files.unsupported(found).collect()] == ["g.exe"]
    docs = {}
    for r in files.documents(found).collect():
        docs.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert docs["k_a.txt"][0].page_content == "plain text"
    assert docs["b.md"][0].page_content == "Title\none\ntwo\ncode"
    assert docs["c.csv"][0].page_content == "Row 1:\na: 1 | b: caf\xe9\n\nRow 2:\na: 3 | b: N/A"
    assert docs["d.docx"][0].page_content == "first\n\nsecond"
    assert [(r.sheet_name, r.page_content) for r in docs["e.xlsx"]] == [("S1", "Row 1:\na: 1 | b: x"), ("S2", "Row 1:\nc: 2.5")]
    assert docs["f.docx"][0].page_content is None and docs["f.docx"][0].error


def test_excel_cells():
    import pandas as pd

    sheet = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO(xlsx({"S": [["a", "a"]]}))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{sheet}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;h&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
    with zipfile.ZipFile(out) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/s0.xml"] = (
        f'<worksheet xmlns="{sheet}"><sheetData><row><c t="inlineStr"><is><t>a</t></is></c><c t="inlineStr"><is><t>a</t></is></c><c/><c t="inlineStr"><is><t>d</t></is></c></row>'
        '<row><c s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c s="3"><v>2.0</v></c><c t="e"><v>#N/A</v></c></row><row><c/><c/><c s="3"><v>3</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>'
    ).encode()
    new = io.BytesIO()
    with zipfile.ZipFile(new, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)
    frame = files.xlsx_sheets(new.getvalue())["S"]
    assert frame.columns.tolist() == ["a", "a.1", "Unnamed: 2", "d"]
    assert files.table_documents(frame)[0]["page_content"] == (
        "Row 1:\na: 2024-01-01 00:00:00 | a.1: 2024-01-01 12:00:00 | Unnamed: 2: 2 | d: N/A\n\nRow 2:\na: N/A | a.1: N/A | Unnamed: 2: 3 | d: True"
    )
    assert files.table_documents(pd.DataFrame([[1, 2]], columns=[None, " b "]))[0]["page_content"] == "Row 1:\ncolumn_0: 1 | b: 2"


def test_page_elements_plug_in(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"2")
    found = files.read_files(spark, str(tmp_path))
    got = files.page_elements(found, lambda data: iter([{"page": int(data)}]), "file_id string, page int").collect()
    assert [r.page for r in got] == [2]


def test_stream_of_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    folder(source)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.watch_files(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("error IS NULL").count() == 6


def test_stream_keeps_late_rows(spark, tmp_path):
    schema = "request_id int, created_at string"
    for n, rows in enumerate(([(1, "2024-03-01"), (1, "2024-03-01"), (2, "2024-03-02")], [(3, "2024-01-01"), (2, "2024-03-02")])):  # the third comes two months late
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / f"part{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        ingest.append_new(stream, str(tmp_path / "out"), str(tmp_path / "state"), "request_id").awaitTermination()
    assert sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_stream_of_events(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0)]
    batch = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    counted = ingest.event_counts(stream)
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.events, r.total) for r in spark.table("counted").collect()] == [("a", 2, 3.0)]
    assert [(r.events, r.total) for r in ingest.event_counts(batch).collect()] == [(2, 3.0)]


def test_settings():
    s = Settings.from_env({"CORVELLA_CHUNK_SIZE": "400", "CORVELLA_LANGUAGE": ""})
    assert (s.chunk_size, s.language) == (400, "en")


def test_services_and_templates(spark):
    assert retrieval.template("fr", "footer") == retrieval.TEMPLATES["en"]["footer"]
    assert services.vision("nobody") is services.vision(None)
    row = spark.range(1).select(services.embedder("hashed")(F.lit("some words")).alias("a"), services.embedder("hashed")(F.lit("some words"), "query").alias("b"), services.generator("none")(F.lit("x")).alias("c")).first()
    assert row.a == row.b and row.c is None


def test_lookup_of_doubles_fails(spark):
    import pytest
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert catalog.lookup(df, "k", 2).count() == 1
    with pytest.raises(PySparkException):
        catalog.lookup(df, "k", 1).collect()


def test_marked_keeps_all_partners(spark):
    df = spark.range(20_000).withColumn("key", (F.col("id") * 7919).cast("string")).withColumn("slot", F.lit(1))
    keys = df.where("id % 97 = 0").select("key")
    got = marked(df, "key", keys)
    assert got.join(keys, "key", "left_semi").count() == keys.count()
    assert got.count() < 400
    assert marked(df, "key", keys.limit(0)).count() == 0


def test_scratch_tables(spark):
    df = materialise(spark.range(5), "t")
    assert df.count() == 5
    assert scratch_root(spark) == scratch_root(spark)
    release(spark)
