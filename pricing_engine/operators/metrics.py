"""All-time price bounds per product and per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricing_engine.operators.history import PRODUCT_KEY, latest_batch
from pricing_engine.sources.tables import valid_prices


def _bounds() -> list[Column]:
    return [
        F.max("max_price").alias("max_price"),
        F.min("min_price").alias("min_price"),
        F.max("last_updated").alias("last_updated"),
    ]


def _as_bounds(prices: DataFrame) -> DataFrame:
    """Each price as the bounds of one observation."""
    return valid_prices(prices).select(
        *PRODUCT_KEY,
        F.col("price").alias("max_price"),
        F.col("price").alias("min_price"),
        F.col("date").alias("last_updated"),
    )


def batch_metrics(prices: DataFrame) -> DataFrame:
    """Highest and lowest price and newest date of a batch, per product and vendor."""
    return _as_bounds(prices).groupBy(*PRODUCT_KEY).agg(*_bounds())


def fold_metrics(existing: DataFrame, prices: DataFrame) -> DataFrame:
    """Stored bounds extended by a batch: one union and one aggregate, no join.

    Maximum, minimum and newest date are associative and idempotent, so batches
    may be folded in any order and more than once.
    """
    columns = [*PRODUCT_KEY, "max_price", "min_price", "last_updated"]
    rows = existing.select(columns).unionByName(_as_bounds(prices))
    return rows.groupBy(*PRODUCT_KEY).agg(*_bounds())


def fold_latest_batch(existing: DataFrame, history: DataFrame) -> DataFrame:
    """Stored bounds extended by the newest date of the stored history."""
    return fold_metrics(existing, latest_batch(valid_prices(history)))


def compare_metrics(existing: DataFrame, latest: DataFrame) -> DataFrame:
    """Stored and latest bounds side by side, with the combined bounds.

    Both sides hold one row per key, so the outer join cannot fan out.
    """
    old, new = existing.alias("old"), latest.alias("new")
    joined = old.join(
        new.select(
            *PRODUCT_KEY,
            F.col("max_price").alias("latest_max_price"),
            F.col("min_price").alias("latest_min_price"),
            F.col("last_updated").alias("latest_seen"),
        ),
        PRODUCT_KEY,
        "full_outer",
    )
    return joined.select(
        *PRODUCT_KEY,
        F.col("old.max_price").alias("stored_max_price"),
        F.col("old.min_price").alias("stored_min_price"),
        "latest_max_price",
        "latest_min_price",
        F.greatest("old.max_price", "latest_max_price").alias("max_price"),
        F.least("old.min_price", "latest_min_price").alias("min_price"),
        F.greatest("old.last_updated", "latest_seen").alias("last_updated"),
    )


def group_metrics(membership: DataFrame, metrics: DataFrame) -> DataFrame:
    """Bounds per group; a group without any metrics stays, with nulls."""
    return (
        membership.select("group_id", "group_name", "category", *PRODUCT_KEY)
        .join(
            metrics.select(*PRODUCT_KEY, "max_price", "min_price", "last_updated"),
            PRODUCT_KEY,
            "left",
        )
        .groupBy("group_id", "group_name", "category")
        .agg(*_bounds())
    )


def repeated_groups(grouped: DataFrame) -> DataFrame:
    """Group ids that stand for more than one name or category."""
    counts = grouped.groupBy("group_id").agg(F.count("*").alias("n_rows"))
    return counts.where(F.col("n_rows") > 1)


def check_groups(grouped: DataFrame) -> DataFrame:
    """Raise if a group has several names or categories, which would repeat its offer."""
    repeated = repeated_groups(grouped)
    example = repeated.first()
    if example is not None:
        raise ValueError(f"group {example['group_id']} has {example['n_rows']} names or categories")
    return grouped
