"""Splitting documents into chunks: recursively at separators, page by page, and under kept headers."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from corvella.config import Settings
from corvella.functions.text import SPACE
from corvella.operators import layout
from corvella.operators.numbering import numbered

DEFAULTS = Settings()
SEPARATORS = ("\n\n", "\n", " ", "")


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to ``size``, each chunk beginning with as many last pieces of the one before as ``overlap`` holds."""
    out: list[str] = []
    held: deque[str] = deque()
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            text = "".join(held).strip()
            if text:
                out.append(text)
            while total > overlap or (total and total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    text = "".join(held).strip()
    if text:
        out.append(text)
    return out


def recursive_split(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where the separators allow it.

    The first separator that occurs cuts the text and stays at the start of what follows; pieces too long are cut by the next ones.
    """
    if size <= 0 or not 0 <= overlap <= size:
        raise ValueError("size must be positive and overlap between 0 and size")
    if not text:
        return []
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[level], separators[level + 1 :]
    if sep == "":
        pieces = list(text)
    else:
        first, *others = text.split(sep)
        pieces = [p for p in (first, *(sep + o for o in others)) if p]
    out: list[str] = []
    small: list[str] = []
    for p in pieces:
        if len(p) < size:
            small.append(p)
            continue
        if small:
            out += _merged(small, size, overlap)
            small = []
        out += recursive_split(p, size, overlap, rest) if rest else [p]
    return out + _merged(small, size, overlap)


@pandas_udf(ArrayType(StringType()))
def split_text(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([recursive_split(t, int(s), int(o)) for t, s, o in zip(text, size, overlap)])


def chunks_of(df: DataFrame, text: str, size: Column | int = DEFAULTS.chunk_size, overlap: Column | int = DEFAULTS.overlap_size) -> DataFrame:
    """``df`` with one row per chunk: piece_no (from 0) and chunk_text; documents without a chunk give no row."""
    size = size if isinstance(size, Column) else F.lit(size)
    overlap = overlap if isinstance(overlap, Column) else F.lit(overlap)
    return df.select("*", F.posexplode(split_text(F.col(text), size, overlap)).alias("piece_no", "chunk_text"))


def inner_sizes(header: Column, size: int, overlap: int) -> tuple[Column, Column]:
    """Chunk size and overlap that remain under a header that every piece repeats."""
    inner = F.greatest(F.lit(200), F.lit(size) - F.length(header) - 2)
    return inner, F.least(F.lit(overlap), F.floor(inner / 2).cast("int"))


def kept_header(text: Column) -> Column:
    """The first line of a text that begins with a bracket closed in it (without a line feed: up to the closing bracket); null otherwise."""
    line = F.substring_index(text, "\n", 1)
    closed = F.when(text.contains("\n"), line).otherwise(F.concat(F.substring_index(text, "]", 1), F.lit("]")))
    return F.when(text.startswith("[") & line.contains("]"), F.regexp_replace(closed, rf"{SPACE}+$", ""))


def under_header(text: Column) -> Column:
    """What follows the kept header, without line feeds at its start."""
    line = F.length(F.substring_index(text, "\n", 1))
    rest = F.when(text.contains("\n"), F.substring(text, line + 1, F.length(text))).otherwise(F.substring(text, F.length(F.substring_index(text, "]", 1)) + 2, F.length(text)))
    return F.regexp_replace(rest, r"^\n+", "")


def split_atomic(elements: DataFrame, text: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.overlap_size) -> DataFrame:
    """Tables, images and scans: whole up to twice the size; longer ones in pieces that each repeat the header, from the second on as continuations."""
    whole = F.length(text) <= 2 * size
    header = kept_header(F.col(text))
    inner, lap = inner_sizes(header, size, overlap)
    body = F.when(header.isNotNull(), under_header(F.col(text))).otherwise(F.col(text))
    sized = elements.select("*", header.alias("_header"), body.alias("_body"), F.when(header.isNotNull(), inner).otherwise(F.lit(size)).alias("_size"), F.when(header.isNotNull(), lap).otherwise(F.lit(overlap)).alias("_lap"))
    kept = sized.where(whole).select(*elements.columns, F.lit(0).alias("piece_no"), F.col(text).alias("chunk_text"), F.lit(None).cast("boolean").alias("continuation"))
    cut = sized.where(~whole).select(*elements.columns, "_header", F.posexplode(split_text(F.col("_body"), F.col("_size").cast("int"), F.col("_lap").cast("int"))).alias("piece_no", "_piece"))
    pieces = cut.select(*elements.columns, "piece_no", F.when(F.col("_header").isNotNull(), F.concat("_header", F.lit("\n"), "_piece")).otherwise(F.col("_piece")).alias("chunk_text"), F.when(F.col("_header").isNotNull() & (F.col("piece_no") > 0), F.lit(True)).alias("continuation"))
    return kept.unionByName(pieces)


def page_chunks(elements: DataFrame, page: list[str], size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.overlap_size) -> DataFrame:
    """Chunks of paged files: texts between atomic elements are joined and split, atomic ones kept or split under their header, all in reading order.

    The page columns, reading_order (of a joined text its first block's), content_type, piece_no, chunk_text and continuation.
    """
    texts = chunks_of(layout.text_islands(elements, page), "body", size, overlap).select(*page, F.col("first_order").alias("reading_order"), F.lit("text").alias("content_type"), "piece_no", "chunk_text", F.lit(None).cast("boolean").alias("continuation"))
    atomic = split_atomic(elements.where("content_type <> 'text'"), "text", size, overlap).select(*page, "reading_order", "content_type", "piece_no", "chunk_text", "continuation")
    return texts.unionByName(atomic)


def chunk_records(chunks: DataFrame, asset: str, order: list[str]) -> DataFrame:
    """``chunks`` with chunk_order from 1 within each asset, however many chunks one asset has."""
    return numbered(chunks, [asset], order, "chunk_order")


def routed(documents: DataFrame, format_column: str = "format") -> tuple[DataFrame, DataFrame]:
    """Documents of paged files, and all others (those without a format among them)."""
    paged = F.coalesce(F.col(format_column) == "pdf", F.lit(False))
    return documents.where(paged), documents.where(~paged)
