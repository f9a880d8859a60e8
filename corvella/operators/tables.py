"""Tables as text: headers, rows, batches within a budget, headers carried over page ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corvella.config import Settings
from corvella.functions import predicates
from corvella.functions.text import clean_cell, strip
from corvella.operators.numbering import carried, ranges

DEFAULTS = Settings()


def header_cells(names: Column, rows: Column) -> tuple[Column, Column]:
    """(header cells, body rows): the given names if any is not blank, else the first row; cells are cleaned, blank ones stay empty."""
    given = F.coalesce(F.exists(names, lambda h: strip(F.coalesce(h, F.lit(""))) != ""), F.lit(False))
    header = F.when(given, names).otherwise(F.get(rows, F.lit(0)))
    body = F.when(given, rows).otherwise(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))
    return F.transform(header, lambda h: clean_cell(h)), body


def named(cells: Column) -> Column:
    """Header cells as column names: blank ones become col_1, col_2 and so on."""
    return F.transform(cells, lambda h, i: F.when(h == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(h))


def header_names(names: Column, rows: Column) -> tuple[Column, Column]:
    """(columns, body rows) of a table by its given names, or by its first row where all of them are blank."""
    cells, body = header_cells(names, rows)
    return named(cells), body


def row_line(cells: Column) -> Column:
    """``| a | b |``"""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: clean_cell(c)), " | "), F.lit(" |"))


def row_pairs(number: Column, columns: Column, cells: Column) -> Column:
    """``Row n:`` and ``name: value`` pairs; what has no partner is left out."""
    n = F.least(F.size(columns), F.size(cells))
    pairs = F.zip_with(F.slice(columns, 1, n), F.slice(cells, 1, n), lambda h, c: F.concat(h, F.lit(": "), clean_cell(c)))
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(":\n"), F.array_join(pairs, " | "))


def preamble(page: Column, table: Column, rows: Column, columns: Column, regular: Column) -> Column:
    names = F.when(regular, F.array_join(columns, ", ")).otherwise(F.array_join(columns, " | "))
    return F.concat(F.lit("[PDF Table | Page: "), page.cast("string"), F.lit(" | Table: "), table.cast("string"), F.lit(" | Rows: "), rows, F.lit(" | Columns: "), names, F.lit("]"))


_BATCHES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("text", T.StringType())]))


def greedy_batches(lines: Column, most_rows: int = DEFAULTS.table_batch_rows, most_chars: int = DEFAULTS.table_batch_chars) -> Column:
    """Batches (first, last, text) of lines in order: a line opens a new one when the rows are full or its characters, a line feed each, would exceed the budget.

    Where a batch begins depends on all before it, so a table's lines are walked once, in an Arrow batch of tables.
    """

    @pandas_udf(_BATCHES)
    def walk(tables: pd.Series) -> pd.Series:
        out = []
        for table in tables:
            done: list[dict[str, object]] = []
            begin, chars = 0, 0
            table = [] if table is None else list(table)
            for i, line in enumerate(table):
                size = len(line) + 1
                if i > begin and (i - begin >= most_rows or chars + size > most_chars):
                    done.append({"first": begin + 1, "last": i, "text": "\n".join(table[begin:i])})
                    begin, chars = i, 0
                chars += size
            if table:
                done.append({"first": begin + 1, "last": len(table), "text": "\n".join(table[begin:])})
            out.append(done)
        return pd.Series(out)

    return walk(lines)


def carried_columns(tables: DataFrame, file: str = "file_id", page: str = "page") -> DataFrame:
    """``tables`` (file, page, table_index, columns, and has_rows where a table may have none) with used_columns: the first table of a page
    whose header is made up, and which fits the names held so far in their number, takes these.

    Held are the names of the latest earlier first table that kept its own and had rows, unless all of them were made up.  Whether a table
    took the held names shows in sizes alone: whatever was held, after a table with names of its own their number is that table's.
    """
    own = F.col("has_rows") if "has_rows" in tables.columns else F.lit(True)
    first = tables.where("table_index = 1").withColumn("_generic", predicates.degenerate_header(F.col("columns")))
    names = own & ~F.forall("columns", lambda c: c.startswith("col_"))
    cut = ranges(first.withColumn("_size", F.when(names, F.size("columns"))), [file], [page])
    sized = carried(cut, [file], [page], "_size", "_before")
    kept = names & (~F.col("_generic") | F.col("_before").isNull() | (F.col("_before") != F.size("columns")))
    held = carried(sized.withColumn("_kept", F.when(kept, F.col("columns"))), [file], [page], "_kept", "_held")
    takes = F.coalesce(F.col("_generic") & (F.size("_held") == F.size("columns")), F.lit(False))
    found = held.select(file, page, "table_index", F.when(takes, F.col("_held")).otherwise(F.col("columns")).alias("used_columns"), takes.alias("carried"))
    rest = tables.where("table_index <> 1").withColumns({"used_columns": F.col("columns"), "carried": F.lit(False)})
    return rest.unionByName(tables.join(found, [file, page, "table_index"]).select(*rest.columns))


def latest_header(tables: DataFrame, file: str = "file_id", page: str = "page") -> DataFrame:
    """The same where all tables have one number of columns: the last real header before the page."""
    real = F.when(~predicates.degenerate_header(F.col("columns")), F.col("columns"))
    held = carried(ranges(tables.withColumn("_real", real), [file], [page]), [file], [page], "_real", "_held")
    return held.select(*tables.columns, F.coalesce("_real", "_held", "columns").alias("used_columns"))


def serialised(tables: DataFrame) -> DataFrame:
    """``tables`` (file_id, page, table_index, header, rows) as text batches: file_id, page, table_index, row_range, columns, text.

    Tables without rows give none.  Where a header was taken for one by mistake and the held names replace it, its cells go back to the top of the body.
    """
    cells, body = header_cells(F.col("header"), F.col("rows"))
    read = tables.where(F.size("rows") > 0).withColumn("_cells", cells).withColumn("columns", named(F.col("_cells"))).withColumn("body", body).where(F.size("columns") > 0)
    held = carried_columns(read.withColumn("has_rows", F.size("body") > 0))
    mistaken = F.col("carried") & F.exists("columns", lambda c: ~c.startswith("col_"))
    whole = F.when(mistaken, F.concat(F.array("_cells"), F.col("body"))).otherwise(F.col("body"))
    ready = held.withColumn("body", whole).withColumn("columns", F.col("used_columns")).where(F.size("body") > 0)
    regular = predicates.regular_rows(F.col("body"), F.size("columns"))
    lines = F.when(regular, F.transform("body", lambda r: row_line(r))).otherwise(F.transform("body", lambda r, i: row_pairs(i + 1, F.col("columns"), r)))
    batches = ready.withColumn("regular", regular).withColumn("b", F.explode(greedy_batches(lines)))
    span = F.concat(F.col("b.first"), F.lit("-"), F.col("b.last"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("columns", lambda _: F.lit("---")), " | "), F.lit(" |"))
    head = preamble(F.col("page"), F.col("table_index"), span, F.col("columns"), F.col("regular"))
    text = F.when(F.col("regular"), F.concat_ws("\n", head, row_line(F.col("columns")), rule, "b.text")).otherwise(F.concat_ws("\n", head, "b.text"))
    return batches.select("file_id", "page", "table_index", span.alias("row_range"), "columns", text.alias("text"))
