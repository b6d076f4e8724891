"""Jobs over a table store: the daily run and its parts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricing_engine.functions.scoring import DEFAULT_MIN_SCORE
from pricing_engine.operators import ingest
from pricing_engine.operators.groups import has_unmatched_products, unmatched_products
from pricing_engine.operators.history import (
    ARRIVAL,
    ARRIVAL_TYPE,
    latest_batch,
)
from pricing_engine.operators.matching import assign_best, assign_reviewed, new_review_queue, review_queue
from pricing_engine.operators.metrics import check_groups, group_metrics
from pricing_engine.operators.quality import Counters
from pricing_engine.plans.analysis import analyse_groups, category_lists
from pricing_engine.plans.views import refresh_groups, refresh_views
from pricing_engine.schemas import TABLES
from pricing_engine.session import staged
from pricing_engine.sources.category_config import check_categories, config_table, fetch_targets
from pricing_engine.sources.payloads import successful
from pricing_engine.sources.sinks import TableStore
from pricing_engine.sources.tables import valid_prices



def arrival_number() -> Column:
    """Place in the run: category, then vendor, both in configuration order, then response."""
    target = F.col("position").cast("decimal(10,0)") * F.lit(10**6).cast("decimal(7,0)")
    target = (target + F.col("vendor_position")).cast("decimal(18,0)")
    return (target * F.lit(10**18).cast("decimal(19,0)") + F.col("seq")).cast(ARRIVAL_TYPE)


@dataclass
class Ingested:
    records: DataFrame
    rejects: DataFrame
    counters: Counters


def ingest_payloads(
    store: TableStore,
    payloads: DataFrame,
    config: Mapping[str, Any],
    readers: Mapping[str, ingest.Reader],
    as_of: str,
    first_hit_vendors: Iterable[str] = (),
    only_vendors: Iterable[str] | None = None,
    only_categories: Iterable[str] | None = None,
) -> Ingested:
    """Payloads to filtered records, staged on shared storage, and the rejects."""
    check_categories(config, only_categories)
    spark = store.spark
    rules = config_table(spark, config)
    targets = fetch_targets(rules, readers, only_vendors, only_categories).select(
        "position", "vendor_position", "category", "vendor"
    )
    wanted = successful(payloads).join(targets, ["category", "vendor"], "left_semi")
    # payloads are parsed once; what follows reads the parsed columns
    counters, one = Counters(), F.lit(1)
    parsed = ingest.normalise(wanted, readers, as_of)
    parsed = counters.over(parsed, "parse", rows=F.count(one), rejected=F.count(ingest.reject_reason()))
    read = staged(parsed, "parsed")
    good, bad = ingest.split_rejects(read)
    hits = ingest.first_search_hits(good, list(first_hit_vendors), ["seq"])
    merged = ingest.merge_sources(hits, ["seq"]).join(targets, ["category", "vendor"])
    merged = counters.over(merged, "merge", rows=F.count(one))
    kept = ingest.filter_terms(merged, rules).select(
        *ingest.RECORD, arrival_number().alias(ARRIVAL)
    )
    kept = counters.over(kept, "filter", rows=F.count(one))
    return Ingested(staged(kept, "records"), bad, counters)


def log_run(store: TableStore, run: str, counters: Counters) -> None:
    """Append what a run has counted to the run log."""
    rows = [(run, *row) for row in counters.rows()]
    new = store.spark.createDataFrame(rows, TABLES["run_log"])
    store.update("run_log", lambda stored: stored.unionByName(new))


def store_records(store: TableStore, records: DataFrame) -> None:
    """Merge records into the price history and the registry."""
    store.create_missing()
    prices = records.select("date", "product_id", "vendor", "category", "price", ARRIVAL)
    store.merge_history(prices)
    store.merge_products(records)


def match_products(
    store: TableStore,
    decisions: DataFrame | None = None,
    min_score: float = DEFAULT_MIN_SCORE,
    new_decisions: DataFrame | None = None,
) -> bool:
    """Put unmatched products into groups; false if there are none.

    With ``decisions`` a product joins the best group accepted for it, and with
    ``new_decisions`` the group of an accepted leader; without, the best-scoring group.
    """
    products, metrics = store.read("products"), store.read("product_metrics")
    if not has_unmatched_products(products, store.read("product_match")):
        return False

    def matched(membership: DataFrame) -> DataFrame:
        if decisions is None:
            return assign_best(products, membership, metrics, min_score)
        queue = review_queue(products, membership, metrics, min_score)
        new_queue = None if new_decisions is None else new_review_queue(products, membership, metrics, min_score)
        return assign_reviewed(products, membership, queue, decisions, new_queue, new_decisions)

    store.update("product_match", matched)
    return True


def update_metrics(store: TableStore, records: DataFrame | None = None) -> None:
    """Fold records, or the newest stored date, into the bounds; then the groups'."""
    if records is None:
        records = latest_batch(valid_prices(store.read("price_history")))
    metrics = store.fold_metrics(records)
    if store.exists("product_match"):
        grouped = group_metrics(store.read("product_match"), metrics)
        store.replace("grouped_product_metrics", check_groups(staged(grouped, "group-bounds")))


def analyse(store: TableStore) -> DataFrame:
    """The lists per category; an absent table is an error, an empty history is not."""
    history, grouped, membership = (
        store.read(table, missing_ok=False)
        for table in ("price_history", "grouped_product_metrics", "product_match")
    )
    return category_lists(analyse_groups(history, grouped, membership))


def daily_run(
    store: TableStore,
    payloads: DataFrame | None,
    config: Mapping[str, Any],
    readers: Mapping[str, ingest.Reader],
    as_of: str,
    decisions: DataFrame | None = None,
    min_score: float = DEFAULT_MIN_SCORE,
    new_decisions: DataFrame | None = None,
    incremental: bool = False,
    **limits: Any,
) -> DataFrame:
    """Ingest, store, match if anything is new, update the metrics, analyse.

    Without payloads the metrics are refreshed from the stored history.  An incremental
    run keeps stored views and reads the lists from them: what no record touches is
    neither read nor written.  Its store has had incremental runs only.
    """
    store.create_missing()
    records = None
    if payloads is not None:
        ingested = ingest_payloads(store, payloads, config, readers, as_of, **limits)
        log_run(store, as_of, ingested.counters)
        if not ingested.records.isEmpty():
            records = ingested.records
            store_records(store, records)
    if not incremental:
        match_products(store, decisions, min_score, new_decisions)
        update_metrics(store, records)
        return analyse(store)
    unplaced = staged(unmatched_products(store.read("products"), store.read("product_match")), "unplaced")
    match_products(store, decisions, min_score, new_decisions)
    if records is not None:
        refresh_views(store, records)
    refresh_groups(store, unplaced)
    return store.read("category_lists")


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("vendor", "reason").agg(F.count("*").alias("n_rows"))
