"""Readers of files: text, Markdown, CSV, Word, Excel; each gives documents path, page_content, format and more.

Files are read as bytes by Spark's binary source, one task many files, and parsed with the standard library and pandas.  A file that
can't be read gives a row with a null page_content and its error, so that nothing is lost in silence.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pandas._libs.parsers import STR_NA_VALUES
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.functions import predicates

ROWS_PER_DOCUMENT = 50
SCHEMA = "path string, page_content string, format string, sheet_name string, row_range string, columns array<string>, total_rows int, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, bytes and loader of all files under a path; the loader is null for unknown suffixes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.col("content").alias("bytes"), predicates.loader(name).alias("loader"))


def unsupported(files: DataFrame) -> DataFrame:
    return files.where("loader IS NULL").select("path", "name")


def markdown_text(text: str) -> str:
    """Markdown's visible text, a block a line: marks of headings, lists, quotes, emphasis, links, code and tables removed."""
    out, fenced = [], False
    for line in text.replace("\r\n", "\n").split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
            continue
        if not fenced:
            if re.fullmatch(r"\s*(?:[-*_]\s*){3,}|\s*\|?(?:\s*:?-+:?\s*\|)+\s*:?-*:?\s*", line) and line.strip():
                continue
            line = re.sub(r"^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)+", "", line)
            line = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", line)
            line = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", line)
            line = re.sub(r"(\*\*|__|\*|_|`)(?=\S)(.+?)(?<=\S)\1", r"\2", line)
            if line.strip().startswith("|"):
                out += [c.strip() for c in line.strip().strip("|").split("|") if c.strip()]
                continue
        if line.strip():
            out.append(line.strip())
    return "\n".join(out).strip()


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word document, blank lines between them; tabs and breaks kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = ""
        for n in p.iter():
            if n.tag == f"{_W}t":
                text += n.text or ""
            elif n.tag == f"{_W}tab":
                text += "\t"
            elif n.tag in (f"{_W}br", f"{_W}cr"):
                text += "\n"
        out.append(text)
    return "\n\n".join(out)


# Built-in number formats of dates and times.
_DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])
_DAY_ZERO = pd.Timestamp("1899-12-30")


def _date_styles(z: zipfile.ZipFile, names: set[str]) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in names:
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", "0")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_S}numFmt")}
    dated = {i for i, code in own.items() if re.search("[dmyhs]", code, re.IGNORECASE)} | _DATE_FORMATS
    styles = root.find(f"{_S}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", "0")) in dated}


def _cell(kind: str | None, text: str, shared: list[str], dated: bool) -> object:
    """A cell's value: whole numbers as such, dates as times, errors and the usual marks of missing values as nothing."""
    if kind == "e":
        return None
    if kind in ("s", "str"):
        value = shared[int(text)] if kind == "s" else text
        return None if value in STR_NA_VALUES else value
    if kind == "b":
        return bool(int(text))
    number = float(text)
    if dated:
        return (_DAY_ZERO + pd.Timedelta(days=number)).round("ms")
    return int(number) if number == int(number) else number


def _unique_names(header: list[object]) -> list[str]:
    """Column names: missing ones say their place from 0, repeated ones get a number."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, h in enumerate(header):
        name = f"Unnamed: {i}" if h is None else str(h)
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def _typed(column: pd.Series) -> pd.Series:
    """A column of numbers as such, written as text or not; with gaps its whole numbers become fractional ones."""
    if any(isinstance(v, (bool, pd.Timestamp)) for v in column):
        return column
    try:
        return pd.to_numeric(column)
    except (TypeError, ValueError):
        return column


def xlsx_sheets(data: bytes) -> dict[str, pd.DataFrame]:
    """Each sheet's rows under its first row's names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        dates = _date_styles(z, names)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = (targets[s.get(f"{_R}id")] or "").lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{_S}row"):
                cells: dict[int, object] = {}
                for k, c in enumerate(row.iter(f"{_S}c")):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = k
                    if letters:
                        at = 0
                        for x in letters.group():
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = _cell("str", "".join(t.text or "" for t in c.iter(f"{_S}t")), shared, False)
                    elif v is not None and v.text is not None:
                        cells[at] = _cell(kind, v.text, shared, int(c.get("s") or 0) in dates)
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            width = max(map(len, rows), default=0)
            rows = [r + [None] * (width - len(r)) for r in rows]
            sheets[s.get("name") or ""] = pd.DataFrame(rows[1:], columns=_unique_names(rows[0]), dtype=object).apply(_typed) if rows else pd.DataFrame()
    return sheets


def read_csv(data: bytes) -> pd.DataFrame:
    """UTF-8, else Latin-1; lines with too many fields are skipped, short ones padded."""
    for encoding in ("utf-8", "latin-1"):
        try:
            return pd.read_csv(io.BytesIO(data), encoding=encoding, on_bad_lines="skip")
        except UnicodeDecodeError:
            continue
        except pd.errors.EmptyDataError:
            return pd.DataFrame()
    return pd.DataFrame()


def table_documents(frame: pd.DataFrame) -> list[dict[str, object]]:
    """Rows of a table, those without any value dropped, as documents of fifty rows."""
    frame = frame.dropna(how="all").reset_index(drop=True)
    columns = [str(c).strip() if pd.notna(c) else f"column_{i}" for i, c in enumerate(frame.columns)]
    out = []
    for at in range(0, len(frame), ROWS_PER_DOCUMENT):
        part = frame.iloc[at : at + ROWS_PER_DOCUMENT]
        texts = []
        for n, row in enumerate(part.itertuples(index=False), at + 1):
            texts.append(f"Row {n}:\n" + " | ".join(f"{c}: {'N/A' if pd.isna(v) else str(v).strip()}" for c, v in zip(columns, row)))
        out.append({"page_content": "\n\n".join(texts), "row_range": f"{at + 1}-{at + len(part)}", "columns": columns, "total_rows": len(frame)})
    return out


def _text(data: bytes) -> list[dict[str, object]]:
    return [{"page_content": data.decode("utf-8")}]


def _markdown(data: bytes) -> list[dict[str, object]]:
    return [{"page_content": markdown_text(data.decode("utf-8")), "format": "markdown"}]


def _docx(data: bytes) -> list[dict[str, object]]:
    return [{"page_content": docx_text(data)}]


def _csv(data: bytes) -> list[dict[str, object]]:
    return [{**d, "format": "structured_data"} for d in table_documents(read_csv(data))]


def _excel(data: bytes) -> list[dict[str, object]]:
    return [{**d, "format": "structured_data", "sheet_name": name} for name, frame in xlsx_sheets(data).items() for d in table_documents(frame)]


#: Loaders by name.  A PDF needs a parser of its own: register one here, or give the elements of its pages to operators.layout.
LOADERS: dict[str, Callable[[bytes], list[dict[str, object]]]] = {"text": _text, "markdown": _markdown, "docx": _docx, "csv": _csv, "excel": _excel}


def documents(files: DataFrame) -> DataFrame:
    """Documents of files (path, bytes, loader); files without a loader are left out, unreadable ones keep a row with their error."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data, loader in zip(pdf["path"], pdf["bytes"], pdf["loader"]):
                try:
                    found = LOADERS[loader](data) if loader in LOADERS else [{"error": f"no parser for {loader}"}]
                except Exception as e:  # a broken file must not end the others
                    found = [{"error": f"{type(e).__name__}: {e}"}]
                rows += [[{"path": path, **d}.get(c) for c in columns] for d in found]
            yield pd.DataFrame(rows, columns=columns, dtype=object).astype({"total_rows": "Int32"})

    return files.where("loader IS NOT NULL").select("path", "bytes", "loader").mapInPandas(run, SCHEMA)


def page_elements(files: DataFrame, parse: Callable[[bytes], Iterator[dict[str, object]]], schema: str) -> DataFrame:
    """Elements of paged files by a parser that yields one dict an element; a page that fails is the parser's to skip, a file that fails gives no rows."""
    from pyspark.sql import types as T

    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["bytes"]):
                try:
                    rows += [{"file_id": path, **e} for e in parse(data)]
                except Exception:  # noqa: S112
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "bytes").mapInPandas(run, schema)
