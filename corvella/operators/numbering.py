"""Row numbers and values carried forward over groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.runtime import materialise


PART = "_part"


def ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` cut into ranges of group and order, a hot group into several, numbered by _part and written once, as all who read them must see the same cut.

    Rows with equal keys share a range, so that ranges never overlap.
    """
    keys = [F.col(f"`{c}`") for c in [*group, *order]]
    return materialise(df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()), "ranges")


def _beside(rows: DataFrame, parts: DataFrame, group: list[str]) -> Column:
    on = rows[PART] == parts[PART]
    for g in group:
        on = on & rows[g].eqNullSafe(parts[g])
    return on


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "row_no") -> DataFrame:
    """``df`` with ``name`` from 1 in each group by ``order`` (plain columns; they should settle the order).

    Each range numbers its own rows and adds the sizes of the ranges before.  Without a group all rows are one.
    """
    ranged = ranges(df, group, order)
    sizes = ranged.groupBy(*group, PART).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*group, PART).orderBy(*order)))
    return placed.join(ahead, _beside(placed, ahead, group)).select(*[placed[c] for c in df.columns if c != name], (placed["_place"] + ahead["_ahead"]).cast("long").alias(name))


def carried(ranged: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``ranged`` (rows cut by ``ranges``) with ``name``: the last value of the column ``value`` that is not null in the earlier rows of its group by ``order``.

    Of each range only its last value goes on to those behind.
    """
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    lasts = ranged.groupBy(*group, PART).agg(F.max_by(value, place).alias("_last"))
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lasts.withColumn("_ahead", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    inside = Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return placed.join(ahead, _beside(placed, ahead, group)).select(*[placed[c] for c in ranged.columns if c != name], F.coalesce(placed["_inside"], ahead["_ahead"]).alias(name))
