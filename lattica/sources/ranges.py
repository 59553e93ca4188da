"""Numbering within groups of any size: rows are dealt by ranges of their keys and start after the earlier ranges' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.stored import written


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranged(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The rows dealt by ranges of the keys, written, with the number of their range: ranges ascend with the keys.

    A range holds about as many rows as any other, so a first key with a third of all rows spans many ranges.
    """
    return written(df.repartitionByRange(*(F.col(f"`{k}`") for k in keys)).withColumn(out, F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Appends the row's number by order in its group, from 1; a group of any size is dealt over many tasks.

    Rows are numbered in each range of (group, order), and start after the rows of the group's earlier ranges, of which
    there is one count for each. Groups must not be null.
    """
    part, before = free_name(df, "part"), free_name(df, "before")
    rows = ranged(df, [*group, *order], part)
    counts = rows.groupBy(*group, part).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order))
    return rows.withColumn(out, own.cast("bigint")).join(starts, [*group, part]).withColumn(out, F.col(out) + F.col(before)).drop(part, before)
