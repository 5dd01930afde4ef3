"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, sorted over all tasks and written, with part, the number of their task, and row, their place over all parts with gaps between these.

    What is written fixes both, so that later readers cannot disagree about them.
    """
    tie = "_tie"
    while tie in rows.columns:
        tie = f"_{tie}"
    ranged = rows.withColumn(tie, F.monotonically_increasing_id())  # rows that are equal in all of order may be many
    ranged = ranged.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    return scratch.save(ranged.withColumn("row", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("row", 33))


def parts_of(rows: DataFrame, *group: str) -> DataFrame:
    """(part, group, shift, size): shift added to a row's number gives its place in its group, of size rows, from 0. A row per part and group."""
    parts = rows.groupBy("part", *group).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*(group or [F.lit(0)]))  # a row per part
    shift = F.sum("n").over(own.orderBy("part")) - F.col("n") - F.col("first")
    return parts.select("part", *group, shift.alias("shift"), F.sum("n").over(own).alias("size"))
