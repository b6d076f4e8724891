import json

import pytest
from pyspark.sql import functions as F

from pricing_engine.operators import ingest as I
from pricing_engine.operators.metrics import batch_metrics
from pricing_engine.plans import jobs
from pricing_engine.schemas import DECISIONS, PAYLOADS, PRICE_HISTORY
from pricing_engine.sources.sinks import TableStore
from pricing_engine.streaming.incremental import maintain_metrics

CONFIG = {
    "categories": {
        "tissue": {
            "search_terms": ["tissue"], "vendors": ["a", "b"], "specific_products": {"b": ["9"]},
            "must_include_terms": ["tissue"], "must_exclude_terms": ["toilet"],
        }
    }
}
READERS = {"a": I.read_json_list_price, "b": I.read_json_sized}


def _payloads(spark, price_a, price_b):
    rows = [
        ("a", "search", 1, None, {"id": "1", "brand": "Kleenex", "name": "Tissues 95 pack", "price": price_a}),
        ("a", "search", 2, None, {"id": "2", "brand": "Kleenex", "name": "Toilet Tissue", "price": 4.0}),
        ("b", "search", 1, None, {"id": "7", "product_name": "Kleenex Tissues", "product_size": "95 pack", "current_price": price_b}),
        ("b", "specific", 2, "9", {"id": "9", "name": "Sorbent Tissues", "price": 2.0}),
        ("b", "specific", 3, "8", {"name": "x"}),
    ]
    full = [(v, "tissue", s, "tissue", n, 200, None, None, r, json.dumps(b)) for v, s, n, r, b in rows]
    return spark.createDataFrame(full, PAYLOADS)


def test_daily_runs(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    jobs.daily_run(store, _payloads(spark, 5.0, 4.0), CONFIG, READERS, "2026-04-26", first_hit_vendors=["b"]).collect()
    match = {(r.vendor, r.product_id): r.group_id for r in store.read("product_match").collect()}
    assert match[("a", "1")] == match[("b", "7")] != match[("b", "9")]
    lists = jobs.daily_run(store, _payloads(spark, 3.0, 4.5), CONFIG, READERS, "2026-04-27")
    rows = {(r.list_name, r.best_vendor): r for r in lists.collect()}
    best = rows["top_five_cheapest", "a"]
    assert (best.current_price, best.discount, best.status) == (3.0, 40.0, "cheapest")
    assert store.read("price_history").count() == 6
    bounds = {(r.vendor, r.product_id): (r.max_price, r.min_price) for r in store.read("product_metrics").collect()}
    assert bounds[("a", "1")] == (5.0, 3.0) and bounds[("b", "7")] == (4.5, 4.0)
    # without payloads the stored history refreshes the metrics and changes nothing
    again = jobs.daily_run(store, None, CONFIG, READERS, "2026-04-28").collect()
    assert sorted(map(str, again)) == sorted(map(str, lists.collect()))


def test_reviewed_run_and_rejects(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], DECISIONS)
    jobs.daily_run(store, _payloads(spark, 5.0, 4.0), CONFIG, READERS, "2026-04-26", decisions=none).collect()
    assert store.read("product_match").select("group_id").distinct().count() == 3
    ingested = jobs.ingest_payloads(store, _payloads(spark, 5.0, 4.0), CONFIG, READERS, "2026-04-26")
    assert [tuple(r) for r in jobs.rejects_by_reason(ingested.rejects).collect()] == [("b", "missing price", 1)]
    limited = jobs.ingest_payloads(store, _payloads(spark, 5.0, 4.0), CONFIG, READERS, "2026-04-26", only_vendors=["a"])
    assert [r.product_id for r in limited.records.collect()] == ["1"]


def test_analysis_needs_its_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.analyse(TableStore(spark, str(tmp_path / "empty")))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, str(i % 5), "v", "c", float(i * 37 % 11)) for i in range(60)]
    frame = spark.createDataFrame(rows, "d int, product_id string, vendor string, category string, price double")
    prices = frame.select(F.date_add(F.lit("2026-04-26").cast("date"), F.col("d")).alias("date"), "product_id", "vendor", "category", "price")
    landed = str(tmp_path / "landed")
    prices.repartition(4).write.parquet(landed)
    stream = spark.readStream.schema(PRICE_HISTORY).option("maxFilesPerTrigger", 1).parquet(landed)
    store = TableStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        maintain_metrics(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, store.read("product_metrics").collect())) == sorted(map(tuple, batch_metrics(prices).collect()))


def test_stream_keeps_history(spark, tmp_path):
    landed = str(tmp_path / "landed")
    prices = spark.createDataFrame([("2026-04-26", "p", "v", "c", 1.0, 1), ("2026-04-26", "p", "v", "c", 2.0, 2)], "day string, product_id string, vendor string, category string, price double, n int")
    prices.select(F.col("day").cast("date").alias("date"), "product_id", "vendor", "category", "price", F.col("n").cast("decimal(38,0)").alias("arrival")).coalesce(1).write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    store = TableStore(spark, str(tmp_path / "store"))
    maintain_metrics(stream, store, str(tmp_path / "checkpoint"), keep_history="arrival").awaitTermination()
    assert [r.price for r in store.read("price_history").collect()] == [2.0]
