"""Consecutive numbers in a global order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricing_engine.session import staged

_PLACE_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def number_rows(rows: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """Number rows ``start, start + 1, ...`` by ``order``, which must be total.

    Rows are range partitioned and sorted, each range is counted, and the counts
    give every range its offset.  The only single-task window runs over one row
    per range.  The sorted rows are written once, by column, which fixes the ranges
    between the two passes.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_id", _PLACE_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range")
        .agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col("_id") - F.shiftleft(F.col("_range"), _PLACE_BITS)
    return (
        placed.join(offsets, "_range")
        .withColumn(name, F.col("_before") + place + F.lit(start))
        .drop("_id", "_range", "_before")
    )
