"""Run counters as one small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pricing_engine.operators.history import HISTORY_KEY


def history_report(observations: DataFrame) -> DataFrame:
    """Rows, invalid rows, rows after keep-last, distinct products and the vendors.

    Rows are first counted per history key (with a map-side part), so the
    distinct counts run on reduced data.
    """
    invalid = F.col("date").isNull() | F.col("price").isNull() | F.col("product_id").isNull() | F.col("vendor").isNull()
    per_key = observations.groupBy(*HISTORY_KEY).agg(
        F.count("*").alias("n"),
        F.sum(F.when(invalid, 1).otherwise(0)).alias("bad"),
    )
    per_vendor = per_key.groupBy("product_id", "vendor").agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.when(F.col("n") > F.col("bad"), 1).otherwise(0)).alias("kept"),
    )
    return per_vendor.agg(
        F.sum("n").alias("n_rows"),
        F.sum("bad").alias("n_invalid"),
        F.sum("kept").alias("n_after_dedupe"),
        F.count_distinct("product_id").alias("n_products"),
        # one entry per vendor
        F.array_join(F.array_sort(F.collect_set("vendor")), ",").alias("vendors"),
    )


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records per category before and after the term filter."""
    original = before.groupBy("category").agg(F.count("*").alias("original"))
    kept = after.groupBy("category").agg(F.count("*").alias("kept"))
    n_kept = F.coalesce("kept", F.lit(0))
    return original.join(kept, "category", "left").select(
        "category", "original", n_kept.alias("kept"), (F.col("original") - n_kept).alias("removed")
    )


class Counters:
    """Counts that the jobs of a run take on their way, without a pass of their own."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def over(self, counted: DataFrame, step: str, **counts: Column) -> DataFrame:
        """``counted``, whose next use also takes ``counts``; it must be written or collected."""
        seen = Observation()
        self._seen.append((step, seen))
        return counted.observe(seen, *[c.alias(name) for name, c in counts.items()])

    def rows(self) -> list[tuple[str, str, int]]:
        """(step, counter, value) of all that was counted."""
        return [(step, name, int(value or 0)) for step, seen in self._seen for name, value in seen.get.items()]
