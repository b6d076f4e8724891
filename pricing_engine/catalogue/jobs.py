"""Queries that go through files: scans, sinks, merges and a whole daily run.

Each writes a table derived from the test data to a scratch folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricing_engine.catalogue.names import AS_OF, CONFIG, json_payloads
from pricing_engine.catalogue.stored import ONE_CATEGORY, ONE_PRODUCT, ONE_VENDOR, Query
from pricing_engine.operators import history as H
from pricing_engine.operators import ingest as I
from pricing_engine.operators.metrics import fold_metrics, group_metrics
from pricing_engine.operators.numbering import number_rows
from pricing_engine.plans.dashboard import snapshot_members
from pricing_engine.plans.jobs import (
    daily_run,
    ingest_payloads,
    log_run,
    rejects_by_reason,
    store_records,
    update_metrics,
)
from pricing_engine.plans.serving import keep_series, publish_groups, served_history, served_page
from pricing_engine.plans.views import refresh_views
from pricing_engine.schemas import PAYLOADS
from pricing_engine.session import scratch_path, staged
from pricing_engine.sources import sample_tables as T
from pricing_engine.sources.payloads import scan_payloads
from pricing_engine.sources.sinks import TableStore, export_csv
from pricing_engine.sources.tables import scan_price_history, scan_table
from pricing_engine.streaming.incremental import maintain_tables

READERS = {"ASIA": I.read_json_list_price, "EUROPE": I.read_json_list_price}


def _store(spark: SparkSession, buckets: int = 0, history_by: str = "date") -> TableStore:
    return TableStore(spark, scratch_path(spark, "query-store"), buckets, history_by)


def history_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The price history as CSV, with a price in fifty unreadable, scanned in its types."""
    broken = F.pmod(F.col("product_id").cast("bigint"), F.lit(50)) == 0
    price = F.when(broken, "n/a").otherwise(F.col("price").cast("string"))
    path = scratch_path(spark, "history-csv")
    export_csv(T.price_history(spark, sf).withColumn("price", price), path, ["date", "vendor", "category", "product_id"])
    return scan_price_history(spark, path, "csv")


def products_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "products")
    T.products(spark, sf).withColumn("extra", F.lit(1)).write.parquet(path)
    return scan_table(spark, path, "products")


def metrics_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics-csv")
    export_csv(T.metrics(spark, sf), path, ["vendor", "product_id"])
    return scan_table(spark, path, "product_metrics", "csv")


def absent_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the observations folded into a table that is not there yet."""
    absent = scan_table(spark, scratch_path(spark, "nothing"), "product_metrics", missing_ok=True)
    return fold_metrics(absent, T.observations(spark, sf))


def membership_version(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    store.replace("product_match", T.membership(spark, sf).limit(0))
    return store.replace("product_match", T.membership(spark, sf))


def group_bounds_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "groups-json")
    T.group_bounds(spark, sf).write.json(path)
    return scan_table(spark, path, "grouped_product_metrics", "json")


def history_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping batches merged into a store date by date."""
    store = _store(spark)
    store.merge_history(T.observations(spark, sf, "l_linenumber <= 4"))
    return store.merge_history(T.observations(spark, sf, "l_linenumber >= 3"))


def registry_versions(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    for lines in ("l_linenumber <= 4", "l_linenumber >= 3"):
        new = H.product_rows(T.records(spark, sf, lines))
        store.replace("products", H.upsert_registry(store.read("products"), new))
    return store.read("products")


def bucketed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of a store with buckets, folded line number by line number."""
    store = _store(spark, buckets=8)
    for line in range(1, 8):
        store.fold_metrics(T.observations(spark, sf, f"l_linenumber = {line}"))
    return store.read("product_metrics")


def _by_arrival(spark: SparkSession, sf: str, n: int) -> list[str]:
    """Conditions that cut the lines into ``n`` runs of order keys, the main part of arrival."""
    last = T.lines_of(spark, sf).agg(F.max("l_orderkey")).first()[0] or 0
    cuts = [last * i // n for i in range(n + 1)]
    return [f"l_orderkey > {a if i else -1} AND l_orderkey <= {b}" for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def interleaved_writers(spark: SparkSession, sf: str) -> DataFrame:
    """A history to which a second writer publishes while the first one computes its merge."""
    store = _store(spark, history_by="month")
    older, newer = (T.observations(spark, sf, lines) for lines in _by_arrival(spark, sf, 2))
    waiting = [older]

    def change(stored: DataFrame) -> DataFrame:
        merged = staged(H.upsert_history(stored, newer), "merged")
        if waiting:
            store.merge_history(waiting.pop())
        return merged

    return store.update("price_history", change, newer)


def group_bounds_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Group bounds published after half of the observations, and again after all."""
    store = _store(spark, buckets=8)
    membership = T.membership(spark, sf)
    for lines in _by_arrival(spark, sf, 2):
        bounds = store.fold_metrics(T.observations(spark, sf, lines))
        store.replace("grouped_product_metrics", group_metrics(membership, bounds))
    return store.read("grouped_product_metrics")


def _streamed(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A stored table after a stream of records that land in three runs."""
    store = _store(spark, buckets=8, history_by="month")
    landed, checkpoint = scratch_path(spark, "records"), scratch_path(spark, "records-checkpoint")
    for lines in _by_arrival(spark, sf, 3):
        records = T.records(spark, sf, lines)
        records.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(records.schema).parquet(landed)
        maintain_tables(stream, store, checkpoint).awaitTermination()
    return store.read(table)


def streamed_history(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "price_history")


def streamed_registry(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "products")


def _kept_views(spark: SparkSession, sf: str) -> TableStore:
    """A store whose views have followed three batches of observations."""
    store = _store(spark, buckets=8)
    store.replace("product_match", T.membership(spark, sf))
    for lines in _by_arrival(spark, sf, 3):
        refresh_views(store, T.observations(spark, sf, lines))
    return store


def incremental_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _kept_views(spark, sf).read("category_lists")


def incremental_members(spark: SparkSession, sf: str) -> DataFrame:
    return _kept_views(spark, sf).read("group_members")


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    """Responses as they land: arrival numbers become places in the run."""
    path = scratch_path(spark, "landed")
    placed = number_rows(json_payloads(spark, sf), ["seq"], 1, "place").drop("seq")
    columns = [F.col("place" if f.name == "seq" else f.name).cast(f.dataType).alias(f.name) for f in PAYLOADS.fields]
    placed.select(columns).write.parquet(path)
    return scan_payloads(spark, path)


def daily_history(spark: SparkSession, sf: str) -> DataFrame:
    """The price history after a run over the landed responses of two vendors."""
    store = _store(spark)
    daily_run(store, _landed(spark, sf), CONFIG, READERS, AS_OF).write.format("noop").mode("overwrite").save()
    return store.read("price_history")


def daily_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What such a run rejects, of the categories and vendors that it fetches."""
    found = ingest_payloads(_store(spark), _landed(spark, sf), CONFIG, READERS, AS_OF)
    return rejects_by_reason(staged(found.rejects, "rejects"))


def served_category(spark: SparkSession, sf: str) -> DataFrame:
    """One category's groups, read from the bucket that the run has written."""
    store = _store(spark, buckets=8)
    snapshot = H.product_snapshot(T.price_history(spark, sf))
    publish_groups(store, snapshot_members(T.membership(spark, sf), snapshot))
    return served_page(store, ONE_CATEGORY)


def served_series(spark: SparkSession, sf: str) -> DataFrame:
    """One product's prices, read from the bucket that three batches have filled."""
    store = _store(spark, buckets=8)
    for lines in _by_arrival(spark, sf, 3):
        keep_series(store, T.observations(spark, sf, lines))
    return served_history(store, ONE_PRODUCT, ONE_VENDOR)


def metrics_only(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds refreshed from the newest stored date, without new records."""
    store = _store(spark, buckets=8, history_by="month")
    store.merge_history(T.observations(spark, sf))
    update_metrics(store)
    return store.read("product_metrics")


def daily_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The bounds after a run over the landed responses of two vendors."""
    store = _store(spark, buckets=8)
    found = ingest_payloads(store, _landed(spark, sf), CONFIG, READERS, AS_OF)
    store_records(store, found.records)
    update_metrics(store, found.records)
    return store.read("product_metrics")


def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What such a run counts while it parses, merges and filters."""
    store = _store(spark)
    ingested = ingest_payloads(store, _landed(spark, sf), CONFIG, READERS, AS_OF)
    log_run(store, AS_OF, ingested.counters)
    return store.read("run_log")


QUERIES: dict[str, Query] = {
    "src_1_history_csv": history_csv,
    "src_2_products_scan": products_scan,
    "src_3_metrics_csv": metrics_csv,
    "src_6_absent_metrics": absent_metrics,
    "src_4_membership_version": membership_version,
    "src_5_group_bounds_json": group_bounds_json,
    "snk_2_history_merges": history_merges,
    "snk_3_registry_versions": registry_versions,
    "snk_4_bucketed_metrics": bucketed_metrics,
    "snk_2_interleaved_writers": interleaved_writers,
    "snk_5_group_bounds_versions": group_bounds_versions,
    "out_1_incremental_lists": incremental_lists,
    "win_1_incremental_members": incremental_members,
    "str_1_stream_history": streamed_history,
    "str_1_stream_registry": streamed_registry,
    "pip_1_daily_history": daily_history,
    "pip_1_daily_rejects": daily_rejects,
    "pip_1_run_counters": run_counters,
    "pip_1_daily_metrics": daily_metrics,
    "pip_2_metrics_only": metrics_only,
    "out_3_served_category": served_category,
    "flt_7_served_history": served_series,
}
