"""Stored views that follow each batch of prices: latest prices, group members, offers, lists.

A batch hands on the keys it touches, from products to their groups and from groups to
their categories.  Every table lies in buckets of its key, so each step reads and
writes the buckets of those keys only, never the history.  An offer that leaves a
short list is replaced from the stored offers of its category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricing_engine.operators.history import ARRIVAL, PRODUCT_KEY
from pricing_engine.plans.analysis import analyse_members, category_lists
from pricing_engine.session import staged
from pricing_engine.sources.sinks import TableStore
from pricing_engine.sources.tables import valid_prices
from pricing_engine.sources.versions import Source


def fold_latest(stored: DataFrame, prices: DataFrame, arrival: str = ARRIVAL) -> DataFrame:
    """Stored latest prices and a batch: the newest per product, of one date the later category.

    A price for a date and category that is stored already replaces it, as in the history.
    """
    new = valid_prices(prices).select(
        *PRODUCT_KEY, F.col("price").alias("current_price"), F.col("date").alias("last_seen_date"), "category", F.col(arrival).alias(ARRIVAL)
    )
    before_all = F.lit(-1).cast(new.schema[ARRIVAL].dataType)
    newest = F.struct("last_seen_date", "category", ARRIVAL)
    last = F.max_by(F.struct("current_price", "last_seen_date", "category"), newest).alias("last")
    return stored.withColumn(ARRIVAL, before_all).unionByName(new).groupBy(*PRODUCT_KEY).agg(last).select(*PRODUCT_KEY, "last.*")


def refresh_views(store: TableStore, prices: DataFrame, arrival: str = ARRIVAL, source: Source | None = None) -> None:
    """Carry a batch of prices through bounds, latest prices, groups and lists."""
    prices = staged(valid_prices(prices), "prices")
    store.update("latest_prices", lambda stored: fold_latest(stored, prices, arrival), prices, source)
    store.fold_metrics(prices, source)
    refresh_groups(store, prices.select(*PRODUCT_KEY), source)


def refresh_groups(store: TableStore, products: DataFrame, source: Source | None = None) -> None:
    """Carry what is known of some products, priced anew or newly placed, into groups and lists."""
    products = staged(products.select(*PRODUCT_KEY).dropna().distinct(), "touched")
    known = products
    for table in ("latest_prices", "product_metrics"):
        known = known.join(store.read_for(table, products).drop("category"), PRODUCT_KEY, "left")
    placed = store.read_for("product_match", products)
    members = staged(placed.join(known, PRODUCT_KEY), "members")
    own = ["group_id", *PRODUCT_KEY]
    store.update("group_members", lambda stored: stored.join(members, own, "left_anti").unionByName(members.select(stored.columns)), members, source)

    groups = staged(members.select("group_id", "category").distinct(), "groups")
    all_members = store.read_for("group_members", groups).join(groups.select("group_id").distinct(), "group_id", "left_semi")
    offers = staged(analyse_members(all_members), "offers")
    store.update("group_offers", lambda stored: stored.join(groups, "group_id", "left_anti").unionByName(offers.select(stored.columns)), groups, source)

    categories = groups.select("category").distinct()
    lists = category_lists(store.read_for("group_offers", categories).join(categories, "category", "left_semi"))
    lists = staged(lists, "lists")
    store.update("category_lists", lambda stored: stored.join(categories, "category", "left_anti").unionByName(lists), categories, source)
