import datetime
import json

import pytest
from pyspark.sql import functions as F

from pricing_engine.operators import ingest as I
from pricing_engine.schemas import PAYLOADS
from pricing_engine.sources.category_config import (
    UnknownCategoryError,
    check_categories,
    config_summary,
    config_table,
    fetch_targets,
    load_config,
    specific_products,
)
from pricing_engine.sources.payloads import scan_payloads, successful

READERS = {
    "list": I.read_json_list_price,
    "sized": I.read_json_sized,
    "pharmacy": I.html_heading_reader(" | Shop"),
    "beauty": I.read_html_slug,
}


def _payload(vendor, body, source="search", seq=1, requested=None, url=None, category="c", term="t", status=200):
    text = body if isinstance(body, str) else json.dumps(body)
    return (vendor, category, source, term, seq, status, url, url, requested, text)


def _read(spark, *payloads):
    frame = spark.createDataFrame(list(payloads), PAYLOADS)
    good, bad = I.split_rejects(I.normalise(frame, READERS, "2026-04-27"))
    return good.orderBy("seq").collect(), {r.seq: r.reason for r in bad.collect()}


def test_no_field_is_taken_out_for_nothing(spark):
    """Only the reader that tells a stated null from an absent key asks which keys a body has."""
    payloads = spark.createDataFrame([_payload("sized", {"id": "7"})], PAYLOADS)
    assert "stated" not in I._json_fields(payloads, I._SIZED_FIELDS).columns
    assert I._json_fields(payloads, ["id", "name"], ["name"]).schema["stated"].dataType.names == ["name"]


def test_json_with_list_price(spark):
    tissue = {"id": "2372797", "slug": "s", "name": "3 Ply Tissues", "brand": "Kleenex", "price": 2.6}
    good, bad = _read(
        spark,
        _payload("list", tissue, seq=1),
        _payload("list", tissue | {"discount_price": None}, seq=2),
        _payload("list", tissue | {"discount_price": 2.1}, seq=3),
        _payload("list", tissue | {"id": None, "name": "KLEENEX x "}, seq=4),
        _payload("list", {"name": "n", "price": 1}, seq=5),
        _payload("list", tissue | {"name": None}, seq=6),
        _payload("list", tissue, source="gift", seq=7),
        _payload("list", "no json", seq=8),
    )
    assert [(r.seq, r.product_id, r.product_name, r.price) for r in good] == [
        (1, "2372797", "Kleenex 3 Ply Tissues", 2.6),
        (3, "2372797", "Kleenex 3 Ply Tissues", 2.1),
        (4, "s", "KLEENEX x", 2.6),
    ]
    assert bad == {2: "missing price", 5: "missing id", 6: "missing name", 7: "unknown source", 8: "missing id"}


def test_json_with_size(spark):
    hit = {
        "product_name": "Essentials Facial Tissues", "product_brand": "Essentials", "current_price": 1.9,
        "product_size": "224 pack", "url": "https://shop.example/productdetails/759496",
    }
    detail = {"id": 759496, "name": "Essentials Facial Tissues 224 pack", "price": 2.0, "discount_price": 1.9}
    good, bad = _read(
        spark,
        _payload("sized", hit, seq=1),
        _payload("sized", detail, source="specific", seq=2, requested="759496"),
        _payload("sized", {"name": "n", "price": 3}, source="specific", seq=3, requested="x/productdetails/12"),
        _payload("sized", {"name": "n", "price": 3, "id": "none"}, seq=4),
        _payload("sized", {"id": "5"}, seq=5),
    )
    assert [(r.product_id, r.product_name, r.price) for r in good] == [
        ("759496", "Essentials Facial Tissues 224 pack", 1.9),
        ("759496", "Essentials Facial Tissues 224 pack", 1.9),
        ("12", "n", 3.0),
    ]
    assert bad == {4: "missing id", 5: "missing price"}


def test_html_pages(spark):
    page = "<title>T | Shop</title>{}<p>$0.00</p><p>$12.99 $3.00</p>{}"
    good, bad = _read(
        spark,
        _payload("pharmacy", page.format("<h1>Name</h1>", ""), "specific", 1, "/buy/9/x", "https://s/buy/80010/x"),
        _payload("pharmacy", page.format("", "Product ID: 123"), "specific", 2, "/buy/9/x", "https://s/other"),
        _payload("pharmacy", page.format("", ""), "specific", 3, "/buy/9/x", "https://s/other"),
        _payload("pharmacy", "<h1>Name</h1>", "specific", 4, "/buy/9/x", "https://s/buy/1/x"),
        _payload("pharmacy", "<p>$1</p>", "specific", 5, "/buy/9/x", "https://s/buy/1/x"),
        _payload(
            "beauty", "<p>SKU</p><p>100054443</p><p>$20.00</p><p>x (5ml), 1 Pack</p>", "specific", 6,
            "/product/a/", "https://s/product/raspberry-hair-vinegar/",
        ),
        _payload("beauty", "<p>$20.00</p>", "specific", 7, "/product/a-b/", "https://s/product/sun-milk/"),
    )
    assert [(r.product_id, r.product_name, r.price) for r in good] == [
        ("80010", "Name", 12.99),
        ("123", "T", 12.99),
        ("9", "T", 12.99),
        ("100054443", "Raspberry Hair Vinegar (1 Pack)", 20.0),
        ("a-b", "Sun Milk", 20.0),
    ]
    assert bad == {4: "missing price", 5: "missing name"}


def test_landed_payloads_keep_successes(spark, tmp_path):
    rows = [_payload("list", "{}", status=s, seq=i) for i, s in enumerate((200, 204, 301, 404, None))]
    frame = spark.createDataFrame(rows, PAYLOADS)
    assert [r.seq for r in successful(frame).orderBy("seq").collect()] == [0, 1, 4]
    frame.write.json(str(tmp_path / "landed"))
    assert scan_payloads(spark, str(tmp_path / "landed"), "json").count() == 3


RECORD = (
    "category string, vendor string, product_id string, source string, requested_product_id string, "
    "seq bigint, price double, search_term string"
)


def _merged(spark, *rows):
    frame = spark.createDataFrame([("c", "v", *r, "t") for r in rows], RECORD)
    return {r.product_id: (r.price, r.source) for r in I.merge_sources(frame, ["seq"]).collect()}


def test_direct_fetches_yield_to_search_hits(spark):
    assert _merged(
        spark,
        ("1", "search", None, 1, 2.0),
        ("1", "search", None, 2, 3.0),
        ("1", "specific", "1", 3, 9.0),
        ("2", "specific", "2", 4, 4.0),
    ) == {"1": (3.0, "search"), "2": (4.0, "specific")}


def test_direct_fetch_by_url_overrides(spark):
    assert _merged(spark, ("1", "search", None, 1, 2.0), ("1", "specific", "/buy/1/x", 2, 9.0)) == {"1": (9.0, "specific")}


def test_repeated_direct_fetches(spark):
    assert _merged(spark, ("1", "specific", "1", 1, 2.0), ("1", "specific", "1", 2, 9.0)) == {"1": (2.0, "specific")}
    assert _merged(spark, ("1", "specific", "/buy/1", 1, 2.0), ("1", "specific", "/buy/1", 2, 9.0)) == {"1": (9.0, "specific")}


def test_first_hit_per_term(spark):
    rows = [("c", "v", "1", "search", None, s, float(s), "t") for s in (3, 1, 2)]
    rows += [("c", "w", "1", "search", None, s, float(s), "t") for s in (3, 1)]
    kept = I.first_search_hits(spark.createDataFrame(rows, RECORD), ["v"], ["seq"])
    assert sorted((r.vendor, r.seq) for r in kept.collect()) == [("v", 1), ("w", 1), ("w", 3)]


CONFIG = {
    "categories": {
        "paper": {
            "search_terms": ["toilet paper"], "vendors": ["list", "sized"], "specific_products": ["1", 2],
            "must_include_terms": [" Toilet "], "or_include_terms": ["paper", "tissue", ""],
        },
        "granola": {
            "vendors": ["sized", "unknown"], "specific_products": {"sized": ["3"], "list": ["4"]},
            "must_exclude_terms": ["yoghurt", "bar"],
        },
    }
}


def test_term_filter_matches_substrings(spark):
    names = [
        ("paper", "TOILET Paper"), ("paper", "Toilet Brush"), ("paper", "Paper Towel"),
        ("granola", "Granola Barley"), ("granola", "Granola Oat"), ("other", "Bar"),
    ]
    rows = spark.createDataFrame(names, "category string, product_name string")
    kept = {r.product_name for r in I.filter_terms(rows, config_table(spark, CONFIG)).collect()}
    assert kept == {"TOILET Paper", "Granola Oat", "Bar"}


def test_targets(spark):
    targets = fetch_targets(config_table(spark, CONFIG), ["list", "sized"]).orderBy("position", "vendor_position")
    rows = [(r.category, r.vendor, r.n_search_terms, r.n_specific) for r in targets.collect()]
    assert rows == [("paper", "list", 1, 2), ("paper", "sized", 1, 2), ("granola", "sized", 0, 1)]
    only = fetch_targets(config_table(spark, CONFIG), ["list", "sized"], ["list"], ["paper"])
    assert only.count() == 1
    summary = {r.category: (r.vendors, r.n_search_terms) for r in config_summary(config_table(spark, CONFIG)).collect()}
    assert summary == {"paper": ("list, sized", 1), "granola": ("sized, unknown", 0)}


def test_config_errors(tmp_path):
    with pytest.raises(UnknownCategoryError, match=r"\['nope'\].*\['granola', 'paper'\]"):
        check_categories(CONFIG, ["paper", "nope"])
    check_categories(CONFIG, None)
    with pytest.raises(TypeError):
        specific_products({"specific_products": "1"})
    path = tmp_path / "c.json"
    path.write_text(json.dumps(CONFIG))
    assert load_config(str(path)) == CONFIG


def test_filters_read_computed_columns_once(spark):
    frame = spark.createDataFrame([_payload("list", "{}")], PAYLOADS)
    good, _ = I.split_rejects(I.normalise(frame, READERS, "2026-04-27"))
    plan = good.select(F.col("price"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("JsonToStructs") <= 4


def test_a_fetch_dropped_as_redundant_gives_nothing(spark):
    """Search finds X; a fetch asked for X answers Y and is dropped; a fetch asked for Y is needed."""
    def record(seq, product, source, asked):
        return (datetime.date(2026, 4, 26), product, "v", "n", "c", 1.0 + seq, source, asked, seq)

    schema = "date date, product_id string, vendor string, product_name string, category string, price double, source string, requested_product_id string, seq int"
    rows = [record(1, "X", "search", None), record(2, "Y", "specific", "X"), record(3, "Y", "specific", "Y")]
    # a chain: C is given by the fetch of B, which is given by the fetch of A
    rows += [record(4, "B", "specific", "A"), record(5, "C", "specific", "B"), record(6, "D", "specific", "C"), record(7, "E", "specific", None)]
    got = I.merge_sources(spark.createDataFrame(rows, schema), ["seq"]).collect()
    assert {(r.product_id, r.seq) for r in got} == {("X", 1), ("Y", 3), ("B", 4), ("D", 6), ("E", 7)}


def test_long_chains_of_fetches(spark, monkeypatch):
    """Chains, repeats and several givers, against fetching one by one; a chain takes few rounds."""
    import random

    from pricing_engine.operators import ingest

    random.seed(2)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(300)]
    pairs += [(f"x{random.randrange(30)}", f"x{random.randrange(30)}") for _ in range(200)] + [(None, "c7"), ("c7", "c7")]
    random.shuffle(pairs[300:])
    given, want = set(), []
    for n, (asked, got) in enumerate(pairs):
        if asked is None or asked not in given:
            given.add(got)
            want.append(n)
    schema = "category string, vendor string, requested_product_id string, product_id string, seq long"
    rows = spark.createDataFrame([("c", "v", a, g, n) for n, (a, g) in enumerate(pairs)], schema)
    writes = []
    monkeypatch.setattr(ingest, "staged", lambda df, name, whole=ingest.staged: writes.append(name) or whole(df, name))
    assert sorted(r.seq for r in ingest._needed_fetches(rows, ["seq"]).collect()) == want
    chains = writes.count("chains")
    assert chains < 80
    writes.clear()
    only = spark.createDataFrame([("c", "v", a, g, n) for n, (a, g) in enumerate(pairs[:300])], schema)
    assert ingest._needed_fetches(only, ["seq"]).count() == 150 and writes.count("chains") <= 11 and writes.count("judged") == 2


def test_bodies_are_parsed_once_as_variants(spark):
    """Bodies landed as VARIANT give the records that their texts give, without any parsing."""
    bodies = [
        {"id": 7, "name": "n", "price": 12.50, "discount_price": None}, {"slug": "s", "name": "é", "price": "3"},
        {"id": "x", "name": None, "price": 1}, {"id": {"a": 1}, "price": 1e3}, [1], "no json", '{"id": 1', '{"id":1,"id":2}',
    ]
    frame = spark.createDataFrame([_payload("list", b, seq=i) for i, b in enumerate(bodies)], PAYLOADS)
    landed = frame.withColumn("body", F.try_parse_json("body"))
    for reader in (I.read_json_list_price, I.read_json_sized):
        texts, variants = reader(frame), reader(landed)
        assert sorted(map(str, texts.collect())) == sorted(map(str, variants.collect()))
        plan = texts._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "JsonToStructs" not in plan and plan.lower().count("parse_json") <= 1
    found = {r.seq: (r.product_id, r.product_name, r.price) for r in I.read_json_list_price(frame).collect()}
    assert found[0] == ("7", "n", None) and found[1] == ("s", "é", 3.0) and found[2][1] is None
    assert found[3] == ('{"a":1}', "", 1000.0) and all(found[i][0] is None for i in (4, 5, 6, 7))
