"""Views kept batch by batch, against the same views computed from all rows."""

import datetime
import json
from decimal import Decimal

import numpy as np
import pytest

from pricing_engine.operators import ingest as I
from pricing_engine.plans import analysis as A
from pricing_engine.plans import jobs
from pricing_engine.plans.views import refresh_groups, refresh_views
from pricing_engine.schemas import PAYLOADS, PRODUCT_MATCH
from pricing_engine.sources.sinks import TableStore
from pricing_engine.sources.versions import Source

SCHEMA = "date date, product_id string, vendor string, category string, price double, arrival decimal(38,0)"
START = datetime.date(2026, 4, 26)


def batch(spark, rows):
    return spark.createDataFrame([(START + datetime.timedelta(days=d), p, "v", c, x, Decimal(n)) for n, (d, p, c, x) in enumerate(rows)], SCHEMA)


def rows(frame):
    return sorted(map(str, frame.collect()))


def membership(spark, products, size=3):
    return spark.createDataFrame([(p // size, f"g{p // size}", f"c{p // size % 4}", str(p), "v", f"n{p}") for p in products], PRODUCT_MATCH)


def expected_lists(store):
    history, bounds = store.read("price_history"), store.read("product_metrics")
    match = store.read("product_match")
    from pricing_engine.operators.metrics import group_metrics

    return A.category_lists(A.analyse_groups(history, group_metrics(match, bounds), match))


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"), buckets=16)


def test_lists_follow_batches(spark, store):
    """Late dates, replaced prices, two categories a product, leaders that leave their list, new members."""
    rng = np.random.default_rng(4)
    store.replace("product_match", membership(spark, range(90)))
    for n in range(4):
        new = batch(spark, [(int(rng.integers(0, 6)), str(rng.integers(0, 100)), f"k{rng.integers(0, 2)}", float(rng.integers(1, 30))) for _ in range(40)])
        store.merge_history(new)
        if n == 2:
            store.replace("product_match", membership(spark, range(100)))
            refresh_groups(store, membership(spark, range(90, 100)))
        for _ in range(2):
            refresh_views(store, new, source=Source("q", n))
        assert rows(store.read("category_lists")) == rows(expected_lists(store))
    assert store.version("category_lists").number == 4  # one for each batch and one for the new members


def test_a_small_batch_reads_and_writes_its_buckets(spark, store):
    store.replace("product_match", membership(spark, range(400), size=2))
    refresh_views(store, batch(spark, [(0, str(p), "k", 10.0) for p in range(400)]))
    before = {t: store.version(t) for t in ("latest_prices", "product_metrics", "group_members", "group_offers", "category_lists")}
    read = []
    whole = TableStore.at

    def at(self, table, version, parts=None):
        frame = whole(self, table, version, parts)
        if parts is not None:  # else it is what an update hands back, unread
            read.extend(frame.inputFiles())
        return frame

    TableStore.at = at
    try:
        refresh_views(store, batch(spark, [(1, "7", "k", 3.0)]))
    finally:
        TableStore.at = whole
    stored = sum(len(v.folders) for v in before.values())
    assert stored > 50 and len(set(read)) <= 14  # old and new bucket of each table
    for table, old in before.items():
        changed = {p for p, f in store.version(table).folders.items() if old.folders.get(p) != f}
        assert len(changed) == 1
    best = [r for r in store.read("category_lists").collect() if r.list_name == "top_five_most_discounted" and r["rank"] == 1 and r.discount > 0]
    assert [(r.group_id, r.current_price, r.discount) for r in best] == [(3, 3.0, 70.0)]


def test_groups_without_prices_have_no_offer(spark, store):
    store.replace("product_match", membership(spark, range(6)))
    refresh_groups(store, membership(spark, range(6)))
    assert store.read("group_members").count() == 6 and store.read("category_lists").isEmpty()
    refresh_views(store, batch(spark, []))
    refresh_views(store, batch(spark, [(0, "1", "k", 2.0), (0, None, "k", 2.0), (0, "unknown", "k", 9.0)]))
    assert {r.group_id for r in store.read("category_lists").collect()} == {0}


def test_incremental_runs_equal_whole_ones(spark, tmp_path):
    config = {"categories": {"tissue": {"search_terms": ["t"], "vendors": ["a", "b"]}}}
    readers = {"a": I.read_json_list_price, "b": I.read_json_list_price}

    def payloads(prices):
        full = [(v, "tissue", "search", "t", n, 200, None, None, None, json.dumps({"id": str(n), "name": f"Brand Tissue {n * 100} pack", "price": x})) for v in "ab" for n, x in prices.items()]
        return spark.createDataFrame(full, PAYLOADS)

    stores = [TableStore(spark, str(tmp_path / name), buckets=4) for name in "xy"]
    for day, prices in enumerate([{1: 5.0, 2: 4.0}, {1: 3.0, 3: 2.0}, {2: 6.0}]):
        found = [rows(jobs.daily_run(s, payloads(prices), config, readers, f"2026-04-2{day}", incremental=i)) for s, i in zip(stores, (False, True))]
        assert found[0] == found[1] and found[0]
