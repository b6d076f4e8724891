"""Tables that requests are answered from: each request reads one bucket.

The dashboard's groups lie in buckets of their category, the price series in buckets
of their product; both are written by the run and follow its batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricing_engine.operators.history import ARRIVAL, product_history, upsert_history
from pricing_engine.plans.dashboard import category_page, snapshot_groups
from pricing_engine.sources.sinks import TableStore
from pricing_engine.sources.versions import Source


def keep_series(store: TableStore, prices: DataFrame, arrival: str = ARRIVAL, source: Source | None = None) -> None:
    """Merge a batch of prices into the series of its products, as into the history."""
    rows = prices.select("date", "product_id", "vendor", "category", "price", arrival)
    store.update("price_series", lambda stored: upsert_history(stored, rows, arrival), rows.dropna(subset=["product_id", "vendor"]), source)


def publish_groups(store: TableStore, members: DataFrame) -> None:
    """Write the dashboard's groups anew from members with all that is known of them."""
    store.update("dashboard_groups", lambda _stored: snapshot_groups(members))


def served_page(store: TableStore, category: str) -> DataFrame:
    """Groups of one category, from its bucket; empty for an unknown one."""
    asked = store.spark.createDataFrame([(category,)], "category string")
    return category_page(store.read_for("dashboard_groups", asked), category)


def served_history(store: TableStore, product_id: str, vendor: str) -> DataFrame:
    """Dated prices of one product at one vendor, from its bucket, oldest first."""
    asked = store.spark.createDataFrame([(product_id, vendor)], "product_id string, vendor string")
    return product_history(store.read_for("price_series", asked), product_id, vendor)
