"""Text columns: cleaning, trimming, names, labels and prompts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: White space as ``str.strip`` sees it, spelt for Java's regular expressions.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any script's kind."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clean_cell(value: Column) -> Column:
    """A table cell on one line; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), rf"{SPACE}+", " "))


def truncated(text: Column, most: int | None) -> Column:
    """The first ``most`` characters (all for None), then stripped."""
    return strip(text if most is None else F.substring(text, 1, most))


def dehyphenated(text: Column) -> Column:
    """Words cut by a hyphen at a line end, joined."""
    return F.regexp_replace(text, r"([\p{L}\p{N}_])-\n(?=[\p{L}\p{N}_])", "$1")


def collapsed(text: Column) -> Column:
    """Runs of spaces and tabs as one space, none around line feeds, at most one blank line in a row."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(flat, r"\n{3,}", "\n\n")


_LEAD = re.compile(r"\s*(?:\d+(?:\.\d+)*\.?\s|(?:chapter|figure|table|step|phase)\s+\d|[•-]\s)", re.IGNORECASE)


def _goes_on(line: str, following: str) -> bool:
    """Whether a line end is only a wrap: the next line is no structure of its own and no new sentence."""
    if not line.strip() or not following.strip() or _LEAD.match(following):
        return False
    first = following.lstrip()[0]
    return not (line[-1] in ".!?:" and (first.isupper() or first.isdigit()))


class _Visible(dict):
    """A translation that drops control characters and the like but for line feeds and tabs; what a character is, is looked up once."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = code if c in "\n\t" or unicodedata.category(c)[0] != "C" else None
        return self[code]


_VISIBLE = _Visible()


def clean_text_py(text: str | None) -> str:
    """Page text made continuous: compatible characters composed, cut words joined, control characters dropped, wraps undone."""
    if not text:
        return ""
    t = re.sub(r"(\w)-\n(\w)", r"\1\2", text if text.isascii() else unicodedata.normalize("NFKC", text))
    t = t.translate(_VISIBLE)
    t = re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", t))
    lines = t.split("\n")
    merged = lines[:1]
    for line, following in zip(lines, lines[1:]):
        if _goes_on(line, following):
            merged[-1] += ("" if merged[-1].endswith("-") else " ") + following
        else:
            merged.append(following)
    t = re.sub(r"\n{3,}", "\n\n", "\n".join(merged))
    return re.sub(r"[ \t]+", " ", t).strip()


@pandas_udf(StringType())
def clean_text(text: pd.Series) -> pd.Series:
    return text.map(clean_text_py)


def clean_file_name(name: Column) -> Column:
    """A stored name: stripped, with letters, digits, underscores and dots only."""
    return F.regexp_replace(strip(name), r"[^\p{L}\p{N}_.]", "")


def url_file_name(url: Column) -> Column:
    """The name under which a page's text is kept."""
    plain = F.regexp_replace(F.regexp_replace(url, r"https?://", ""), r"[^\p{L}\p{N}_]", "_")
    return F.concat(F.substring(plain, 1, 80), F.lit(".txt"))


def stable_key(*parts: Column, length: int = 12) -> Column:
    """A reproducible key in place of a random one."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def collection_name(dim: Column, project: Column) -> Column:
    return F.concat(F.lit("collection_"), dim.cast("string"), F.lit("_"), project.cast("string"))


def vector_text(vector: Column, digits: int = 6) -> Column:
    """``[a,b,...]`` with a fixed number of decimals, the same in every engine."""
    shown = F.transform(vector, lambda x: F.round(x.cast("double"), digits).cast(f"decimal(38,{digits})").cast("string"))
    return F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))


def block_text(lines: Column) -> Column:
    """Text of a block of lines of spans: spans run on, lines are lines."""
    return F.array_join(F.transform(lines, lambda spans: F.array_join(spans, "")), "\n")


def citation_label(meta: Column) -> Column:
    """Where a passage comes from: file name without its key, and page, table, image, sheet or rows.  An index of 0 or an empty range is none."""
    name = F.element_at(F.split(meta["source"], "/"), -1)
    plain = F.regexp_replace(name, r"^[^_]*_", "")
    file = F.when(plain == "", name).otherwise(plain)
    page, rows, kind = meta["page"], F.nullif(meta["row_range"], F.lit("")), meta["content_type"]
    part = (
        F.when((kind == "table") & (meta["table_index"] != 0), F.concat_ws(" | ", F.concat(F.lit("Table: "), meta["table_index"]), F.concat(F.lit("Rows: "), rows)))
        .when((kind == "image") & (meta["image_index"] != 0), F.concat(F.lit("Image: "), meta["image_index"]))
        .when(kind == "page_scan", F.lit("Scanned Page"))
    )
    paged = F.concat(file, F.lit(" (Page: "), page, F.coalesce(F.concat(F.lit(" | "), part), F.lit("")), F.lit(")"))
    sheet = F.concat_ws(" | ", F.concat(F.lit("Sheet: "), F.nullif(meta["sheet_name"], F.lit(""))), F.concat(F.lit("Rows: "), rows))
    return (
        F.when(meta.isNull() | meta["source"].isNull() | (meta["source"] == ""), F.lit("unknown"))
        .when(page.isNotNull(), paged)
        .when((meta["format"] == "structured_data") & (sheet != ""), F.concat(file, F.lit(" ("), sheet, F.lit(")")))
        .otherwise(file)
    )


def filled(template: str, **values: Column) -> Column:
    """A template with its ``$name`` slots filled; null values count as empty."""
    parts = re.split(r"\$([a-z_]+)", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p])


def metadata_json(meta: Column) -> Column:
    """Metadata as JSON without its nulls; ``{}`` for none."""
    return F.coalesce(F.to_json(meta), F.lit("{}"))


def read_response(body: Column) -> Column:
    """The text of a page reader's answer: its pages' markdown or text joined by blank lines, else the text at its top."""
    page = "pages ARRAY<STRUCT<markdown: STRING, text: STRING>>, markdown STRING, text STRING, content STRING"
    answer = F.from_json(body, page)
    parts = F.transform(answer["pages"], lambda p: strip(F.coalesce(F.nullif(p["markdown"], F.lit("")), p["text"], F.lit(""))))
    joined = F.array_join(F.filter(parts, lambda t: t != ""), "\n\n")
    top = strip(F.coalesce(F.nullif(answer["markdown"], F.lit("")), F.nullif(answer["text"], F.lit("")), answer["content"]))
    return F.coalesce(F.nullif(joined, F.lit("")), F.nullif(top, F.lit("")))
