"""Page layout: text outside tables, bands and columns, reading order, scanned pages, images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corvella.config import Settings
from corvella.functions import geometry, predicates
from corvella.functions.text import clean_text, strip
from corvella.operators.numbering import numbered

DEFAULTS = Settings()


def text_outside_tables(texts: DataFrame, tables: DataFrame, page: list[str], bbox: str = "bbox", share: float = DEFAULTS.overlap_share) -> DataFrame:
    """Text blocks of which no more than ``share`` lies in any one table of their page."""
    a, b = texts.alias("a"), tables.alias("b")
    on = geometry.share_inside(F.col(f"a.{bbox}"), F.col(f"b.{bbox}")) > share
    for p in page:
        on = on & (F.col(f"a.{p}") == F.col(f"b.{p}"))
    return a.join(b, on, "left_anti")


def gap_groups(elements: DataFrame, page: list[str], low: str, high: str, tolerance: float | Column, name: str = "band") -> DataFrame:
    """``name`` numbers from 0 the groups along one axis: a new one where an element begins beyond all ends so far plus the tolerance."""
    order = Window.partitionBy(*page).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    new = F.coalesce((F.col(low) > reach + tolerance).cast("int"), F.lit(0))
    marked = elements.withColumn("_new", new)
    return marked.withColumn(name, F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def line_order(y0: Column, x0: Column, tolerance: float) -> list[Column]:
    """Sort keys of the plain order: lines of a height, half-even as the lines are rounded, then from the left."""
    return [F.rint(y0 / F.lit(float(tolerance))), x0]


def _cut_order(boxes: list[tuple[float, float, float, float]], width: float, height: float, rtl: bool) -> list[int]:
    """Reading order by recursive cuts: bands at gaps in y, in a band columns at gaps in x, unless something spans the page.

    Columns go from the right if ``rtl``; lines of an uncut group always go from the left.  Equal places keep the order they came in.
    """
    gap_y, gap_x, line = max(4.0, 0.015 * height), max(6.0, 0.02 * width), max(2.0, 0.01 * height)

    def plain(ids: list[int]) -> list[int]:
        return sorted(ids, key=lambda i: (round(boxes[i][1] / line), boxes[i][0]))

    def groups(ids: list[int], axis: int, gap: float) -> list[list[int]]:
        out: list[list[int]] = []
        reach = 0.0
        for i in sorted(ids, key=lambda i: boxes[i][axis]):
            if not out or boxes[i][axis] > reach + gap:
                out.append([])
                reach = boxes[i][axis + 2]
            out[-1].append(i)
            reach = max(reach, boxes[i][axis + 2])
        return out

    order: list[int] = []
    # work list of (elements, what is tried on them next)
    todo: list[tuple[list[int], str]] = [(list(range(len(boxes))), "bands")]
    while todo:
        ids, how = todo.pop()
        if len(ids) < 2:
            order += ids
        elif how == "bands":
            bands = groups(ids, 1, gap_y)
            todo += [(b, "columns") for b in reversed(bands)] if len(bands) > 1 else [(ids, "columns")]
        elif any(boxes[i][2] - boxes[i][0] >= DEFAULTS.full_width_share * width for i in ids):
            order += plain(ids)
        else:
            columns = groups(ids, 0, gap_x)
            if len(columns) == 1:
                order += plain(ids)
            else:
                columns.sort(key=lambda c: min(boxes[i][0] for i in c), reverse=rtl)
                todo += [(c, "bands") for c in reversed(columns)]
    return order


@pandas_udf(T.ArrayType(T.IntegerType()))
def _places(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, width: pd.Series, height: pd.Series, rtl: pd.Series) -> pd.Series:
    """The place of each box in the reading order of its page."""
    out = []
    for *sides, w, h, r in zip(x0, y0, x1, y1, width, height, rtl):
        order = _cut_order(list(zip(*(s.tolist() for s in sides))), w, h, bool(r))
        places = [0] * len(order)
        for place, i in enumerate(order):
            places[i] = place
        out.append(places)
    return pd.Series(out)


def reading_order(elements: DataFrame, page: list[str], tie: list[str], rtl: bool = False) -> DataFrame:
    """``elements`` (bbox, page_w, page_h and the named columns) with reading_order from 0 within each page.

    Pages are the groups; one page's elements are a row while they are put in order.  ``tie`` fixes the order of equal boxes.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in elements.columns])
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(tie)], whole.alias("_row"))))
    pages = elements.groupBy(*page).agg(F.transform(rows, lambda x: x["_row"]).alias("_rows"))
    sides = [F.col("_rows")["bbox"][c].cast("array<double>") for c in ("x0", "y0", "x1", "y1")]
    first = F.col("_rows")[0]
    placed = pages.select("_rows", _places(*sides, first["page_w"].cast("double"), first["page_h"].cast("double"), F.lit(rtl)).alias("_places"))
    pairs = placed.select(F.explode(F.arrays_zip("_rows", "_places")).alias("_p"))
    return pairs.select(*[F.col(f"_p._rows.`{c}`").alias(c) for c in elements.columns], F.col("_p._places").alias("reading_order"))


def scanned_pages(elements: DataFrame, page: list[str]) -> DataFrame:
    """Per page: chars, tables, largest_image and is_scanned."""
    kind = F.col("content_type")
    summary = elements.groupBy(*page).agg(
        F.coalesce(F.sum(F.when(kind == "text", F.length("text"))), F.lit(0)).alias("chars"),
        F.count(F.when(kind == "table", 1)).alias("tables"),
        F.max(F.when(kind == "image", geometry.area(F.col("bbox")))).alias("largest_image"),
        F.max(F.col("page_w") * F.col("page_h")).alias("page_area"),
    )
    return summary.withColumn("is_scanned", predicates.scanned_page(F.col("chars"), F.col("tables"), F.col("largest_image"), F.col("page_area")))


def image_candidates(images: DataFrame, page: list[str], order: list[str], share: float = DEFAULTS.image_least_share, most: int = DEFAULTS.images_per_page) -> DataFrame:
    """Images worth describing: the first of each xref on a page, big enough, with bytes, the first ``most``; numbered by image_index."""
    first = Window.partitionBy(*page, "xref").orderBy(*order)
    nth = Window.partitionBy(*page).orderBy(*order)
    seen = images.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    big = F.try_divide(geometry.area(F.col("bbox")), F.col("page_w") * F.col("page_h")) >= share
    kept = seen.where(F.col("bbox").isNotNull() & big & (F.col("n_bytes") > 0))
    return kept.withColumn("image_index", F.row_number().over(nth)).where(F.col("image_index") <= most)


def text_islands(elements: DataFrame, page: list[str]) -> DataFrame:
    """Runs of text between the tables, images and scans of a page, each joined by blank lines: the page columns, island, body, pieces, first_order."""
    order = Window.partitionBy(*page).orderBy("reading_order")
    atomic = (F.col("content_type") != "text").cast("int")
    numbered = elements.withColumn("island", F.sum(atomic).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "text")))
    return (
        numbered.where("content_type = 'text'").groupBy(*page, "island").agg(ordered.alias("o"))
        .select(*page, "island", F.array_join(F.transform("o", lambda x: x["text"]), "\n\n").alias("body"), F.size("o").alias("pieces"), F.col("o")[0]["reading_order"].alias("first_order"))
    )


def page_order(elements: DataFrame, file: str, page: str, tie: list[str]) -> DataFrame:
    """``position`` from 0 through a file: pages ascending, elements without a page first."""
    paged = elements.withColumn("_page", F.coalesce(F.col(page), F.lit(-1)))
    return numbered(paged, [file], ["_page", *tie], "position").withColumn("position", F.col("position") - 1).drop("_page")


def clean_blocks(blocks: DataFrame, kind: str = "block_type", text: str = "text") -> DataFrame:
    """Blocks of type 0 with their text cleaned, but for those of which nothing is left."""
    return blocks.where(F.col(kind) == 0).withColumn(text, clean_text(F.col(text))).where(F.col(text) != "")


def described_elements(images: DataFrame, describe: Column) -> DataFrame:
    """Images with a description as elements; one without is left out and keeps its number."""
    body = F.concat(F.lit("[Image Description | Page: "), F.col("page"), F.lit(" | Image: "), F.col("image_index"), F.lit("]\n"), strip(describe))
    return images.withColumn("_told", describe).where(F.col("_told") != "").drop("_told").withColumn("text", body).withColumn("content_type", F.lit("image"))


def scan_elements(pages: DataFrame, read: Column) -> DataFrame:
    """The cleaned text read from each scanned page as its only element, the page (page_w, page_h, where known) being its box; pages that can't be read give none."""
    body = F.concat(F.lit("[Page Scan | Page: "), F.col("page"), F.lit("]\n"), clean_text(F.col("_read")))
    found = pages.where("is_scanned").withColumn("_read", read).where(F.col("_read") != "").withColumn("text", body).drop("_read").withColumn("content_type", F.lit("page_scan"))
    if {"page_w", "page_h"} <= set(pages.columns):
        found = found.withColumn("bbox", geometry.box(F.lit(0.0), F.lit(0.0), F.col("page_w"), F.col("page_h")))
    return found


def page_documents(elements: DataFrame, page: list[str]) -> DataFrame:
    """Elements of pages as documents with their metadata; on a scanned page that was read, only the scan remains."""
    scans = elements.where("content_type = 'page_scan'").select(*page).distinct()
    rest = elements.where("content_type <> 'page_scan'").join(scans, page, "left_anti")
    both = elements.where("content_type = 'page_scan'").unionByName(rest)
    corners = F.when(F.col("bbox").isNotNull(), F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"))
    told = {c: F.col(c) if c in elements.columns else F.lit(None).cast(k) for c, k in (("row_range", "string"), ("columns", "array<string>"), ("vision_provider", "string"), ("vision_model", "string"))}
    meta = F.struct(
        F.col("file_id").alias("source"), F.lit("pdf").alias("format"), F.col("page"), F.col("content_type"), corners.alias("bbox"), F.col("reading_order"), F.col("table_index"),
        told["row_range"].alias("row_range"), told["columns"].alias("columns"), F.col("image_index"), told["vision_provider"].alias("vision_provider"), told["vision_model"].alias("vision_model"),
    )
    return both.where(strip(F.col("text")) != "").select("file_id", "page", "reading_order", F.col("text").alias("page_content"), meta.alias("metadata"))



def assembled_pages(elements: DataFrame, tables: DataFrame, read: Column | None = None, describe: Column | None = None, rtl: bool = False, provider: str | None = None, model: str | None = None) -> DataFrame:
    """From the elements of pages (schemas.ELEMENTS) and their serialised tables (operators.tables.serialised, with bbox) to documents in reading order.

    Texts are cleaned; those inside tables, and those of which nothing is left, are dropped.  A scanned page that ``read`` can read becomes its scan
    alone; on the others images that ``describe`` can describe join the text and tables.  ``read`` and ``describe`` are columns over the page's or
    image's row; null ones do nothing, and without either no page counts as scanned.  ``provider`` and ``model`` name the service behind them.  A table's
    batches are one element: they share its place, and follow each other by their rows.
    """
    page, size = ["file_id", "page"], ["page_w", "page_h"]
    bbox = geometry.normalised(F.col("bbox"), F.col("page_w"), F.col("page_h"))
    valid = elements.withColumn("bbox", bbox).where(F.col("bbox").isNotNull())
    sizes = valid.select(*page, *size).distinct()
    texts = text_outside_tables(valid.where("content_type = 'text'").withColumn("text", clean_text(F.col("text"))).where("text <> ''"), tables, page)
    kinds = tables.select(*page, F.lit("table").alias("content_type"), "bbox", "table_index").distinct().join(sizes, page)
    images = valid.where("content_type = 'image'")
    candidates = image_candidates(images.drop("image_index"), page, ["elem_id"])
    seen = ["content_type", "bbox", "text"]
    both = texts.select(*page, *size, *seen).unionByName(candidates.select(*page, *size, *seen)).unionByName(kinds.withColumn("text", F.lit(None).cast("string")).select(*page, *size, *seen))
    states = scanned_pages(both, page).join(sizes, page)
    service = {"vision_provider": F.lit(provider).cast("string"), "vision_model": F.lit(model).cast("string")}
    scans = scan_elements(states, read if read is not None else F.lit(None).cast("string")).select(*page, *size, *seen).withColumns(service)
    described = described_elements(candidates, describe if describe is not None else F.lit(None).cast("string")).join(states.where("is_scanned").select(*page), page, "left_anti").withColumns(service)
    empty = {"table_index": F.lit(None).cast("int"), "image_index": F.lit(None).cast("int"), "vision_provider": F.lit(None).cast("string"), "vision_model": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "elem_id": F.lit(None).cast("int")}
    columns = [*page, *size, *seen, "elem_id", "table_index", "image_index", "vision_provider", "vision_model"]

    def filled(df: DataFrame) -> DataFrame:
        return df.withColumns({c: v for c, v in empty.items() if c not in df.columns}).select(columns)

    rank = F.when(F.col("content_type") == "table", 0).when(F.col("content_type") == "text", 1).otherwise(2)
    placed = filled(texts.drop("table_index", "image_index")).unionByName(filled(kinds)).unionByName(filled(described.drop("table_index"))).withColumn("_rank", rank)
    ordered = reading_order(placed, page, ["_rank", "table_index", "elem_id", "image_index"], rtl).drop("_rank")
    batches = tables.select(*page, "table_index", "row_range", "columns", F.col("text").alias("_batch"))
    whole = ordered.join(batches, [*page, "table_index"], "left").withColumn("text", F.coalesce("_batch", "text")).drop("_batch")
    alone = filled(scans).withColumns({"reading_order": F.lit(0), "row_range": F.lit(None).cast("string"), "columns": F.lit(None).cast("array<string>")})
    return page_documents(whole.unionByName(alone), page)
