"""Nested members and run counters."""

import datetime
import json

from pyspark.sql import functions as F

from pricing_engine.operators import ingest as I
from pricing_engine.plans import dashboard as D
from pricing_engine.plans import jobs, serving
from pricing_engine.schemas import GROUP_MEMBERS, PAYLOADS
from pricing_engine.sources.sinks import TableStore

DAY = datetime.date(2026, 4, 26)


def test_members_in_chunks(spark):
    """A large group is several rows in one order; missing and zero prices sort by 999."""
    prices = [(i * 37) % 101 / 1.0 for i in range(100)] + [None, 0.0, 1500.0]
    rows = [(1, "big", "c", f"p{i:03}", "v", "n", x, DAY, x, x, DAY) for i, x in enumerate(prices)]
    rows += [(2, "small", "c", "q", "v", "n", 1.0, DAY, 1.0, 1.0, DAY)]
    members = spark.createDataFrame(rows, GROUP_MEMBERS)
    nested = D.nested_members(members, 20).orderBy("group_id", "chunk").collect()
    assert [(r.group_id, r.chunk, len(r.members)) for r in nested] == [(1, i, 20) for i in range(5)] + [(1, 5, 3), (2, 0, 1)]
    got = [m.product_id for r in nested[:-1] for m in r.members]
    want = sorted(rows[:-1], key=lambda r: (999 if not r[6] else r[6], r[4], r[3]))
    assert got == [r[3] for r in want] and got[-1] == "p102"
    assert nested[0].members[0].asDict().keys() == set(D._MEMBER)
    assert D.nested_members(members.limit(0)).isEmpty()


def test_requests_read_one_bucket(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), buckets=16)
    rows = [(g, f"g{g}", f"c{g % 40}", f"p{g}", "v", "n", 1.0 + g, DAY, 9.0 + g, 1.0, DAY) for g in range(400)]
    members = spark.createDataFrame(rows, GROUP_MEMBERS)
    serving.publish_groups(store, members)
    page = serving.served_page(store, "c7")
    assert len(page.inputFiles()) == 1 and {r.group_id for r in page.collect()} == set(range(7, 400, 40))
    assert serving.served_page(store, "unknown").isEmpty()
    prices = members.selectExpr("last_seen_date AS date", "product_id", "vendor", "category", "current_price AS price", "CAST(group_id AS DECIMAL(38,0)) AS arrival")
    for day in (0, 1):
        serving.keep_series(store, prices.withColumn("date", F.date_add("date", day)))
    series = serving.served_history(store, "p9", "v")
    assert len(series.inputFiles()) == 1 and [r.price for r in series.collect()] == [10.0, 10.0]
    assert serving.served_history(TableStore(spark, str(tmp_path / "none"), buckets=4), "p", "v").isEmpty()


def payloads(spark, n):
    rows = [("a", "tissue", "search", "t", i, 200, None, None, None, json.dumps({"id": str(i % 5), "name": "Tissue" if i % 3 else "Towel", **({"price": 1.0} if i % 4 else {})})) for i in range(n)]
    return spark.createDataFrame(rows, PAYLOADS)


def test_a_run_logs_what_it_counts(spark, tmp_path):
    config = {"categories": {"tissue": {"search_terms": ["t"], "vendors": ["a"], "must_include_terms": ["tissue"]}}}
    store = TableStore(spark, str(tmp_path / "store"))
    for run, n in (("2026-04-26", 20), ("2026-04-27", 0)):
        found = jobs.ingest_payloads(store, payloads(spark, n), config, {"a": I.read_json_list_price}, run)
        jobs.log_run(store, run, found.counters)
    got = {(r.run, r.step, r.counter): r.value for r in store.read("run_log").collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "2026-04-26"} == {("parse", "rows"): 20, ("parse", "rejected"): 5, ("merge", "rows"): 5, ("filter", "rows"): found_kept(20)}
    assert {v for k, v in got.items() if k[0] == "2026-04-27"} == {0}


def found_kept(n):
    last = {}
    for i in range(n):
        if i % 4:
            last[i % 5] = i
    return sum(1 for i in last.values() if i % 3)


def test_nested_groups_reduce_the_lines_once(spark, monkeypatch):
    """Groups and members come from one snapshot and one membership."""
    from pricing_engine.catalogue import stored

    read = []
    for name in ("price_history", "membership"):
        plain = getattr(stored.T, name)
        monkeypatch.setattr(stored.T, name, lambda s, d, name=name, plain=plain: read.append(name) or plain(s, d))
    assert stored.nested_groups(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(read) == ["membership", "price_history"]
