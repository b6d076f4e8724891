"""Versions of stored tables: writers that meet, readers that stay, batches that come twice."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricing_engine.operators import history as H
from pricing_engine.schemas import PRICE_HISTORY, PRODUCT_METRICS
from pricing_engine.sources import sinks
from pricing_engine.sources.sinks import TableStore
from pricing_engine.sources.versions import ConflictError, Source
from pricing_engine.streaming import incremental

DAY = [datetime.date(2026, 4, 26) + datetime.timedelta(days=d) for d in range(5)]


def history(spark, *rows):
    frame = spark.createDataFrame([(DAY[d], p, "v", "c", float(x)) for d, p, x in rows], PRICE_HISTORY)
    return frame.withColumn("arrival", F.monotonically_increasing_id().cast(H.ARRIVAL_TYPE))


def prices(frame):
    return sorted((r.date, r.product_id, r.price) for r in frame.collect())


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"), buckets=4)


def between(monkeypatch, store, table, act):
    """``act`` once, after a writer of ``table`` has written its folders and before it publishes."""
    whole, left = sinks.TableStore._written, [act]

    def written(self, name, rows, number):
        folders = whole(self, name, rows, number)
        if name == table and left:
            left.pop()()
        return folders

    monkeypatch.setattr(sinks.TableStore, "_written", written)


def test_writers_of_one_partition_keep_both_updates(spark, store, monkeypatch):
    store.merge_history(history(spark, (0, "p", 1), (1, "p", 1)))
    between(monkeypatch, store, "price_history", lambda: store.merge_history(history(spark, (1, "q", 5))))
    got = store.merge_history(history(spark, (1, "p", 2)))
    assert prices(got) == prices(store.read("price_history")) == [(DAY[0], "p", 1.0), (DAY[1], "p", 2.0), (DAY[1], "q", 5.0)]
    assert store.version("price_history").number == 2


def test_writers_of_other_partitions_do_not_compute_again(spark, store, monkeypatch):
    store.merge_history(history(spark, (0, "p", 1)))
    between(monkeypatch, store, "price_history", lambda: store.merge_history(history(spark, (2, "q", 5))))
    calls = []
    monkeypatch.setattr(sinks, "upsert_history", lambda *a: calls.append(a) or H.upsert_history(*a))
    got = store.merge_history(history(spark, (1, "p", 2)))
    assert prices(got) == [(DAY[0], "p", 1.0), (DAY[1], "p", 2.0), (DAY[2], "q", 5.0)] and len(calls) == 2


def test_replacements_that_meet_fail(spark, store, monkeypatch):
    row = lambda x: spark.createDataFrame([("p", "v", x, x, DAY[0])], PRODUCT_METRICS)
    store.replace("product_metrics", row(1.0))
    between(monkeypatch, store, "product_metrics", lambda: store.replace("product_metrics", row(2.0)))
    with pytest.raises(ConflictError):
        store.replace("product_metrics", row(3.0))
    assert store.read("product_metrics").first().max_price == 2.0
    with pytest.raises(ConflictError):
        store.replace("product_metrics", row(3.0), expected=0)
    assert store.replace("product_metrics", row(3.0), expected=1).first().max_price == 3.0


def test_a_table_that_always_moves_on_is_given_up(spark, store, monkeypatch):
    whole = sinks.TableStore._written

    def written(self, name, rows, number):
        folders = whole(self, name, rows, number)
        self.log(name).publish(self.version(name).after(None, whole(self, name, rows, number), None))
        return folders

    monkeypatch.setattr(sinks.TableStore, "_written", written)
    with pytest.raises(ConflictError, match="5 times"):
        store.update("grouped_product_metrics", lambda stored: stored)


def test_readers_keep_their_version_until_it_is_vacuumed(spark, store, tmp_path):
    store.merge_history(history(spark, (0, "p", 1), (1, "p", 1)))
    store.fold_metrics(history(spark, (0, "p", 1), (0, "q", 1)))
    before, bounds = store.read("price_history"), store.read("product_metrics")
    for x in (2, 3):
        store.merge_history(history(spark, (1, "p", x)))
        store.fold_metrics(history(spark, (1, "p", 10 * x)))
    assert prices(before) == [(DAY[0], "p", 1.0), (DAY[1], "p", 1.0)]
    assert {r.product_id: r.max_price for r in bounds.collect()} == {"p": 1.0, "q": 1.0}
    files = lambda: len(list((tmp_path / "store").rglob("*.parquet")))
    many = files()
    assert store.vacuum(1) > 0 and files() < many and store.vacuum(1) == 0
    assert prices(store.read("price_history")) == [(DAY[0], "p", 1.0), (DAY[1], "p", 3.0)]
    assert {r.product_id: r.max_price for r in store.read("product_metrics").collect()} == {"p": 30.0, "q": 1.0}
    assert len(store.log("price_history").numbers()) == 1
    store.merge_history(history(spark, (2, "p", 4)))
    assert store.read("price_history").count() == 3


def test_what_an_interrupted_writer_leaves_is_not_read(spark, store, monkeypatch):
    store.merge_history(history(spark, (0, "p", 1)))

    def stop():
        raise KeyboardInterrupt

    between(monkeypatch, store, "price_history", stop)
    with pytest.raises(KeyboardInterrupt):
        store.merge_history(history(spark, (0, "p", 2), (3, "z", 1)))
    assert prices(store.read("price_history")) == [(DAY[0], "p", 1.0)]
    assert prices(store.merge_history(history(spark, (0, "p", 3)))) == [(DAY[0], "p", 3.0)]


def test_buckets_cannot_change(spark, store):
    store.fold_metrics(history(spark, (0, "p", 1)))
    with pytest.raises(ValueError, match="4 buckets"):
        TableStore(spark, store.root, buckets=8).fold_metrics(history(spark, (0, "p", 1)))


def test_a_source_is_applied_once(spark, store):
    for batch in (0, 0, 1, 0, 1):
        store.merge_history(history(spark, (batch, "p", 1)), source=Source("s", batch))
    assert store.version("price_history").number == 1
    store.merge_history(history(spark, (0, "p", 7)), source=Source("other", 0))
    assert store.version("price_history").applied == {"s": 1, "other": 0}


def records(spark, *rows):
    schema = "date date, product_id string, vendor string, product_name string, category string, price double, source string, arrival decimal(38,0)"
    from decimal import Decimal

    return spark.createDataFrame([(DAY[d], p, "v", name, "c", float(x), "search", Decimal(n)) for n, (d, p, name, x) in enumerate(rows)], schema)


def test_stream_applies_each_batch_once(spark, store, tmp_path, monkeypatch):
    """The job stops between two tables; the batch comes again and changes only the other tables."""
    landed = str(tmp_path / "landed")
    batches = [records(spark, (0, "p", "Old", 1), (0, "q", "Q", 2)), records(spark, (0, "p", "New", 3), (1, "p", "New", 5))]
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(landed)
    run = lambda: incremental.maintain_tables(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    fold = sinks.TableStore.fold_metrics
    monkeypatch.setattr(sinks.TableStore, "fold_metrics", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division by zero"):
        run()
    assert [store.version(t).number for t in ("price_history", "products", "product_metrics")] == [0, 0, -1]
    monkeypatch.setattr(sinks.TableStore, "fold_metrics", fold)
    run()
    run()
    assert [store.version(t).number for t in ("price_history", "products", "product_metrics")] == [1, 1, 1]
    assert prices(store.read("price_history")) == [(DAY[0], "p", 3.0), (DAY[0], "q", 2.0), (DAY[1], "p", 5.0)]
    assert {r.product_id: (r.product_name, r.last_seen) for r in store.read("products").collect()} == {"p": ("New", DAY[1]), "q": ("Q", DAY[0])}
    assert {r.product_id: (r.max_price, r.min_price) for r in store.read("product_metrics").collect()} == {"p": (5.0, 1.0), "q": (2.0, 2.0)}


def test_buckets_are_written_once(spark, store, monkeypatch):
    """No copy of the rows goes before a table in buckets; its log names the folders that were made."""
    copies = []
    monkeypatch.setattr(sinks, "staged", lambda rows, name: copies.append(name) or rows)
    rows = spark.range(40).selectExpr(
        "cast(id as string) product_id", "'v' vendor", "'n' product_name", "'c' category", "'search' source", "date'2024-01-01' last_seen"
    )
    store.replace("products", rows)
    version = store.version("products")
    assert not copies and set(version.folders) == {"0", "1", "2", "3"}
    assert all(f.endswith(f"/bucket={p}") for p, f in version.folders.items())
    assert sorted(r.product_id for r in store.read("products").collect()) == sorted(str(i) for i in range(40))
    store.replace("products", rows.limit(0))
    assert store.version("products").folders == {} and store.read("products").count() == 0
