"""Streaming upkeep of the stored tables, with the batch operators per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pricing_engine.operators.history import ARRIVAL
from pricing_engine.session import staged
from pricing_engine.sources.sinks import TableStore
from pricing_engine.sources.versions import Source


def _source(batch: DataFrame, batch_id: int) -> Source:
    """The batch as the stream's checkpoint numbers it."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("batches are applied from within a streaming query")
    return Source(query, batch_id)


def apply_prices(store: TableStore, source: Source, batch: DataFrame, arrival: str | None = None) -> None:
    """Fold observations into the bounds and, with ``arrival``, merge them into the history.

    Each table's log holds the newest batch it has seen, in the version that the batch
    made, so a batch that comes again after a failure adds no version anywhere.
    """
    if arrival is not None:
        store.merge_history(batch, arrival, source)
    store.fold_metrics(batch, source)


def apply_records(store: TableStore, source: Source, batch: DataFrame) -> None:
    """Merge ingested records into history and registry and fold their prices, each once."""
    prices = batch.select("date", "product_id", "vendor", "category", "price", ARRIVAL)
    store.merge_history(prices, ARRIVAL, source)
    store.merge_products(batch, ARRIVAL, source)
    store.fold_metrics(prices, source)


def _started(rows: DataFrame, store: TableStore, checkpoint: str, apply: Callable[[TableStore, Source, DataFrame], None], trigger: dict) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        # the batch belongs to the query's own session, and several tables read it
        own = replace(store, spark=batch.sparkSession)
        apply(own, _source(batch, batch_id), staged(batch, "batch"))

    return (
        rows.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def maintain_metrics(
    observations: DataFrame,
    store: TableStore,
    checkpoint: str,
    keep_history: str | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Fold a stream of ``date, product_id, vendor, category, price`` into the store.

    With ``keep_history`` (the arrival column) the batch is merged into the price
    history as well.  The tables are the state; no watermark is needed, since late
    prices widen the bounds like any other.
    """
    apply = lambda own, source, batch: apply_prices(own, source, batch, keep_history)
    return _started(observations, store, checkpoint, apply, trigger)


def maintain_tables(records: DataFrame, store: TableStore, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keep history, registry and metrics up to date from a stream of ingested records.

    Rows of a later batch beat those of earlier ones; within a batch the arrival
    number decides.
    """
    return _started(records, store, checkpoint, apply_records, trigger)
