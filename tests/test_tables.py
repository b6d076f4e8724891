import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pricing_engine.operators import history as H
from pricing_engine.operators import metrics as M
from pricing_engine.operators.groups import best_offers, has_unmatched_products, next_group_id
from pricing_engine.plans import analysis as A
from pricing_engine.schemas import (
    GROUP_METRICS,
    PRICE_HISTORY,
    PRODUCT_MATCH,
    PRODUCT_METRICS,
    PRODUCTS,
    MissingColumnsError,
    empty_table,
)
from pricing_engine.sources.sinks import TableStore, export_csv
from pricing_engine.sources.tables import conform, scan_price_history, scan_table

DAY = [datetime.date(2026, 4, 26), datetime.date(2026, 4, 27), datetime.date(2026, 4, 28)]


def _history(spark, *rows):
    return spark.createDataFrame([(DAY[d], p, v, c, x) for d, p, v, c, x in rows], PRICE_HISTORY)


def _arriving(frame):
    return frame.withColumn("arrival", F.monotonically_increasing_id().cast(H.ARRIVAL_TYPE))


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_csv_scan_coerces_and_drops(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("vendor,date,product_id,category,price\na,2026-04-27T01:00:00Z,007,c,3.5\na,bad,1,c,2\na,2026-04-27,2,c,NaN\n")
    assert _rows(scan_price_history(spark, str(path), "csv")) == [(DAY[1], "007", "a", "c", 3.5)]


def test_missing_columns_are_named_in_order(spark):
    with pytest.raises(MissingColumnsError, match=r"\['category', 'date'\]"):
        conform(_history(spark).drop("date", "category"), "price_history")


def test_absent_tables(spark, tmp_path):
    path = str(tmp_path / "none")
    assert scan_table(spark, path, "products", missing_ok=True).isEmpty()
    with pytest.raises(AnalysisException):
        scan_table(spark, path, "products")
    bad = tmp_path / "bad.parquet"
    bad.write_text("junk")
    with pytest.raises(Exception):
        scan_table(spark, str(bad), "products", missing_ok=True).count()


def test_keep_last_is_idempotent(spark):
    stored = _history(spark, (0, "p", "v", "c", 5.0), (0, "q", "v", "c", 1.0))
    new = _arriving(_history(spark, (0, "p", "v", "c", 7.0), (0, "p", "v", "c", 4.0)).coalesce(1))
    once = H.upsert_history(stored, new)
    assert _rows(once) == _rows(H.upsert_history(once, new)) == [(DAY[0], "p", "v", "c", 4.0), (DAY[0], "q", "v", "c", 1.0)]


def test_registry_keeps_the_last_category(spark):
    new = spark.createDataFrame([("p", "v", "n", "a", "search", DAY[1]), ("p", "v", "n", "b", "search", DAY[0])], PRODUCTS)
    got = H.upsert_registry(empty_table(spark, PRODUCTS), _arriving(new.coalesce(1))).collect()
    assert [(r.category, r.last_seen) for r in got] == [("b", DAY[0])]


def test_metrics_fold_over_any_split(spark):
    rows = [(d, p, "v", "c", float((7 * d + 3 * int(p)) % 5)) for d in range(3) for p in "12345"]
    whole = M.batch_metrics(_history(spark, *rows))
    folded = empty_table(spark, PRODUCT_METRICS)
    for day in (1, 0, 2, 1):
        folded = M.fold_metrics(folded, _history(spark, *[r for r in rows if r[0] == day]))
    assert _rows(folded) == _rows(whole)


def test_fold_keeps_both_sides(spark):
    old = spark.createDataFrame([("1", "v", 5.0, 3.2, DAY[0]), ("2", "v", 1.0, 1.0, DAY[0])], PRODUCT_METRICS)
    new = _history(spark, (1, "1", "v", "c", 6.0), (1, "1", "v", "c", 3.5), (1, "3", "v", "c", 2.0))
    want = [("1", "v", 6.0, 3.2, DAY[1]), ("2", "v", 1.0, 1.0, DAY[0]), ("3", "v", 2.0, 2.0, DAY[1])]
    assert _rows(M.fold_metrics(old, new)) == want
    joined = M.compare_metrics(old, M.batch_metrics(new)).select("product_id", "vendor", "max_price", "min_price", "last_updated")
    assert _rows(joined) == want


def test_group_without_metrics_stays(spark):
    match = spark.createDataFrame([(1, "g", "c", "1", "v", "n"), (1, "g", "c", "2", "v", "n"), (2, "h", "c", "9", "v", "n")], PRODUCT_MATCH)
    metrics = spark.createDataFrame([("1", "v", 5.0, 3.0, DAY[0])], PRODUCT_METRICS)
    assert _rows(M.group_metrics(match, metrics)) == [(1, "g", "c", 5.0, 3.0, DAY[0]), (2, "h", "c", None, None, None)]
    with pytest.raises(ValueError):
        M.check_groups(spark.createDataFrame([(1, "a", "c", 1.0, 1.0, None), (1, "b", "c", 1.0, 1.0, None)], GROUP_METRICS))


def test_best_offer_ties(spark):
    members = spark.createDataFrame(
        [(1, "x", "a", 3.0, DAY[0]), (1, "y", "c", 3.0, DAY[1]), (1, "z", "b", 3.0, DAY[1])],
        "group_id bigint, product_id string, vendor string, current_price double, last_seen_date date",
    )
    assert best_offers(members).first().best_vendor == "b"
    assert best_offers(members, "stored").first().best_vendor == "a"


def test_latest_price_ties_by_category(spark):
    history = _history(spark, (1, "p", "v", "b", 2.0), (1, "p", "v", "a", 1.0), (0, "p", "v", "z", 9.0))
    assert _rows(H.latest_prices(history)) == [("p", "v", 2.0, DAY[1], "b")]
    assert H.latest_batch(history).count() == 2


def _groups(spark, n):
    rows = [(g, f"g{g}", "c", float(g), "v", 10.0 * max(0, n - 2 - g), "discounted") for g in range(n)]
    return spark.createDataFrame(rows, "group_id bigint, group_name string, category string, current_price double, best_vendor string, discount double, status string")


def test_short_lists(spark):
    groups = _groups(spark, 7)
    top = A.top_discounted(groups).orderBy("rank").collect()
    assert [(r["rank"], r.group_id) for r in top] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    summary = A.category_summary(groups).first()
    assert len(summary.top_five_cheapest) == 5 and summary.n_at_low == 0


def test_ids_and_unmatched(spark):
    match = empty_table(spark, PRODUCT_MATCH)
    product = spark.createDataFrame([("1", "v", "n", "c", "search", None)], PRODUCTS)
    assert next_group_id(match) == 1
    assert has_unmatched_products(product, match)
    assert not has_unmatched_products(empty_table(spark, PRODUCTS), match)


def test_store_versions_and_order(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.read("products", missing_ok=False)
    store.create_missing()
    assert store.read("products").isEmpty() and store.read("price_history").columns == PRICE_HISTORY.fieldNames()
    rows = [(str(i), "b" if i % 2 else "a", 2.0, 1.0, DAY[0]) for i in range(9, -1, -1)]
    store.replace("product_metrics", spark.createDataFrame(rows, PRODUCT_METRICS))
    again = store.replace("product_metrics", store.read("product_metrics").where("product_id < '4'"))
    assert [(r.vendor, r.product_id) for r in again.coalesce(1).collect()] == [("a", "0"), ("a", "2"), ("b", "1"), ("b", "3")]
    export_csv(again, str(tmp_path / "csv"), ["vendor", "product_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().last_updated == "2026-04-26"


def test_history_merge_replaces_touched_dates_only(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    store.merge_history(_arriving(_history(spark, (0, "p", "v", "c", 1.0), (1, "p", "v", "c", 2.0)).coalesce(1)))
    new = _arriving(_history(spark, (1, "p", "v", "c", 3.0), (2, "q", "v", "c", 4.0)).coalesce(1))
    for _ in range(2):
        merged = store.merge_history(new)
        assert _rows(merged) == [(DAY[0], "p", "v", "c", 1.0), (DAY[1], "p", "v", "c", 3.0), (DAY[2], "q", "v", "c", 4.0)]


def test_buckets_that_a_batch_does_not_touch_stay(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), buckets=8)
    first = _history(spark, *[(0, str(i), "v", "c", float(i)) for i in range(40)])
    assert store.fold_metrics(first).count() == 40
    files = lambda: {f for f in (tmp_path / "store").rglob("bucket=*/*.parquet")}
    before = files()
    batch = _history(spark, (1, "3", "v", "c", 99.0), (1, "new", "v", "c", 1.0))
    for _ in range(2):
        got = {r.product_id: (r.max_price, r.min_price) for r in store.fold_metrics(batch).collect()}
        assert len(got) == 41 and got["3"] == (99.0, 3.0) and got["new"] == (1.0, 1.0) and got["4"] == (4.0, 4.0)
    untouched = before & files()
    assert len({f.parent for f in before - untouched}) <= 2 and len({f.parent for f in untouched}) >= 5


def test_a_lost_folder_is_an_error(spark, tmp_path):
    import shutil

    from pyspark.errors import AnalysisException

    store = TableStore(spark, str(tmp_path / "store"))
    store.replace("products", empty_table(spark, PRODUCTS))
    assert store.read("products").isEmpty()
    for folder in (tmp_path / "store" / "products").glob("v=*"):  # which the log names
        shutil.rmtree(folder)
    with pytest.raises(AnalysisException):
        store.read("products").collect()
