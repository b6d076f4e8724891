"""Price history and registry: keep-last merges, latest prices, one product's series.

"Last" means arrival: new rows beat stored ones, and within a batch a number in
the ``arrival`` column decides, which must be non-negative and unique per key.
All reductions are aggregates with a map-side part, so a key that holds a third
of the rows is reduced before the shuffle; no window sorts it in one task.  Where
every value has a fixed width Spark aggregates by hashing, without a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_KEY = ["date", "product_id", "vendor", "category"]
PRODUCT_KEY = ["product_id", "vendor"]
ARRIVAL = "arrival"
ARRIVAL_TYPE = T.DecimalType(38, 0)

_FIXED_WIDTH = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def keep_last(rows: DataFrame, keys: list[str], arrival: str = ARRIVAL) -> DataFrame:
    """One row per key, the one that arrived last, without the arrival column."""
    payload = [c for c in rows.columns if c not in keys and c != arrival]
    kept = [c for c in rows.columns if c != arrival]
    if all(isinstance(rows.schema[c].dataType, _FIXED_WIDTH) for c in payload):
        values = [F.max_by(c, arrival).alias(c) for c in payload]
        return rows.groupBy(*keys).agg(*values).select(kept)
    last = F.max_by(F.struct(*payload), arrival).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*").select(kept)


def _merge(stored: DataFrame, new: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    columns = [c for c in new.columns if c != arrival]
    before_all = F.lit(-1).cast(new.schema[arrival].dataType)
    rows = stored.select(columns).withColumn(arrival, before_all).unionByName(new)
    return keep_last(rows.dropna(subset=PRODUCT_KEY), keys, arrival)


def upsert_history(stored: DataFrame, new: DataFrame, arrival: str = ARRIVAL) -> DataFrame:
    """Stored and new observations, the last one per date, product, vendor and category."""
    return _merge(stored, new, HISTORY_KEY, arrival)


def upsert_registry(stored: DataFrame, new: DataFrame, arrival: str = ARRIVAL) -> DataFrame:
    """Stored and new products, the last one per product and vendor."""
    return _merge(stored, new, PRODUCT_KEY, arrival)


def product_rows(records: DataFrame) -> DataFrame:
    """Registry rows of ingested records."""
    return records.withColumnRenamed("date", "last_seen").drop("price")


def product_snapshot(history: DataFrame) -> DataFrame:
    """All-time bounds and the newest price per product and vendor, in one pass.

    The history holds one row per date and category.  Two rows of one date are
    told apart by category: the later name wins.  The first aggregate hashes the
    bulk of the rows; the second sees one row per category that lists a product.
    """
    per_category = history.groupBy(*PRODUCT_KEY, "category").agg(
        F.max("price").alias("max_price"),
        F.min("price").alias("min_price"),
        F.max("date").alias("date"),
        F.max_by("price", "date").alias("price"),
    )
    newest = F.struct("date", "category")
    return (
        per_category.groupBy(*PRODUCT_KEY)
        .agg(
            F.max("max_price").alias("max_price"),
            F.min("min_price").alias("min_price"),
            F.max_by(F.struct("price", "date", "category"), newest).alias("last"),
        )
        .select(
            *PRODUCT_KEY,
            "max_price",
            "min_price",
            F.col("last.date").alias("last_updated"),
            F.col("last.price").alias("current_price"),
            F.col("last.date").alias("last_seen_date"),
            F.col("last.category").alias("category"),
        )
    )


def latest_prices(history: DataFrame) -> DataFrame:
    """The newest price per product and vendor."""
    return product_snapshot(history).select(
        *PRODUCT_KEY, "current_price", "last_seen_date", "category"
    )


def latest_batch(history: DataFrame) -> DataFrame:
    """Rows of the newest date over all vendors.

    The date is a scalar subquery, so on a table partitioned by date the scan
    reads that partition only.
    """
    newest = history.select(F.max("date").alias("newest"))
    return history.where(F.col("date") == newest.scalar())


def product_history(history: DataFrame, product_id: str, vendor: str) -> DataFrame:
    """Dated prices of one product at one vendor, oldest first."""
    return (
        history.where((F.col("product_id") == product_id) & (F.col("vendor") == vendor))
        .select("date", "price")
        .orderBy("date", "price")
    )
