"""Rows of structured files as documents of fifty rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.config import Settings
from corvella.functions.text import strip
from corvella.operators.numbering import numbered

DEFAULTS = Settings()


def shown(df: DataFrame, column: str) -> Column:
    """A value as text: null as N/A, timestamps to the second, doubles in their shortest form with a point, text stripped."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.TimestampType):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1")
        text = F.when((F.abs(c) < 1e15) & ((F.abs(c) >= 1e-4) | (c == 0)), F.regexp_replace(plain, r"\.$", ".0")).otherwise(F.lower(c.cast("string")))
    else:
        text = strip(c.cast("string"))
    return F.coalesce(text, F.lit("N/A"))


def row_text(df: DataFrame, number: Column, columns: list[str]) -> Column:
    """``Row n:`` and ``name: value`` pairs; names are stripped."""
    pairs = [F.concat(F.lit(f"{c.strip()}: "), shown(df, c)) for c in columns]
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(":\n"), F.concat_ws(" | ", *pairs))


def numbered_rows(df: DataFrame, sheet: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows with at least one value, numbered from 1 in each sheet as row_no; a sheet may hold most of the rows."""
    some = df.where(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns]).isNotNull())
    return numbered(some, sheet, order)


def sheet_totals(df: DataFrame, sheet: list[str], columns: list[str], rows: int = DEFAULTS.rows_per_document) -> DataFrame:
    """The sheet columns, total_rows (rows with at least one value) and the number of documents they make."""
    some = df.where(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns]).isNotNull())
    return some.groupBy(*sheet).agg(F.count("*").alias("total_rows")).withColumn("documents", F.ceil(F.col("total_rows") / rows).cast("long"))


def row_documents(df: DataFrame, sheet: list[str], order: list[str], columns: list[str], rows: int = DEFAULTS.rows_per_document) -> DataFrame:
    """The sheet columns, bucket (from 0), row_range, total_rows and rows_text of documents of ``rows`` rows each; no sheet columns: one sheet."""
    texts = numbered_rows(df, sheet, order, columns).withColumn("text", row_text(df, F.col("row_no"), columns)).withColumn("bucket", F.floor((F.col("row_no") - 1) / rows).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("row_no", "text")))  # at most ``rows`` of them
    documents = texts.groupBy(*sheet, "bucket").agg(F.max("row_no").alias("_last"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("rows_text"))
    some = df.where(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns]).isNotNull())
    if sheet:  # few sheets, counted before they meet the texts
        totals = some.groupBy(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(sheet)]).agg(F.count("*").alias("total_rows"))
        on = F.lit(True)
        for i, c in enumerate(sheet):
            on = on & documents[c].eqNullSafe(totals[f"_{i}"])
        documents = documents.join(totals, on)
    else:
        documents = documents.withColumn("total_rows", some.agg(F.count("*").alias("total_rows")).scalar())
    span = F.concat((F.col("bucket") * rows + 1).cast("string"), F.lit("-"), F.col("_last").cast("string"))
    return documents.select(*sheet, "bucket", span.alias("row_range"), "total_rows", "rows_text")
