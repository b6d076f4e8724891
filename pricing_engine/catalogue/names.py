"""Queries over names, payloads, matching and the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricing_engine.catalogue.stored import ONE_VENDOR, Query, known_members
from pricing_engine.functions import html as HT
from pricing_engine.functions import payload_fields as P
from pricing_engine.functions import scoring as S
from pricing_engine.functions import text as TX
from pricing_engine.operators import groups as G
from pricing_engine.operators import ingest as I
from pricing_engine.operators import matching as MT
from pricing_engine.operators import quality as Q
from pricing_engine.operators.history import ARRIVAL, product_snapshot
from pricing_engine.operators.name_pairs import gated_pairs, name_features, scored_pairs
from pricing_engine.plans.name_index import index_names, indexed_review_queue
from pricing_engine.session import scratch_path, staged
from pricing_engine.sources import sample_tables as T
from pricing_engine.sources.category_config import config_summary, config_table, fetch_targets
from pricing_engine.sources.payloads import successful
from pricing_engine.sources.sinks import TableStore
from pricing_engine.streaming.incremental import maintain_metrics

AS_OF = "2002-01-01"
SHOP_URL = "https://shop.example"
# shops that carry all categories; the last one has no reader
SHOPS = ["ASIA", "EUROPE", "NOWHERE"]
CONFIG = {
    "categories": {
        "ECONOMY": {
            "search_terms": ["ring", "rod"],
            "vendors": SHOPS,
            "specific_products": ["1", "2"],
            "must_include_terms": ["BRAND", " "],
            "or_include_terms": ["ring", "Rod "],
            "must_exclude_terms": ["hot", "old"],
        },
        "SMALL": {
            "search_terms": [],
            "vendors": ["ASIA"],
            "specific_products": {"ASIA": ["5", "6", "7"], "EUROPE": ["8"]},
            "must_exclude_terms": ["ml"],
        },
        "PROMO": {"search_terms": ["any"], "vendors": [], "or_include_terms": ["pk", "case"]},
    }
}


# names ----------------------------------------------------------------------


def _product_names(spark: SparkSession, sf: str) -> DataFrame:
    return T.parts(spark, sf).select(
        F.col("l_partkey").cast("string").alias("product_id"),
        "product_name",
        TX.normalised_name(F.col("product_name")).alias("name"),
    )



def normalised_names(spark: SparkSession, sf: str) -> DataFrame:
    return _product_names(spark, sf)


def attributes(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    return _product_names(spark, sf).select(
        "product_id",
        TX.ply_count(name).alias("ply"),
        TX.pack_count(name).alias("pack"),
        TX.size_value(name).alias("size_value"),
        TX.size_unit(name).alias("size_unit"),
    )


def brands(spark: SparkSession, sf: str) -> DataFrame:
    return _product_names(spark, sf).select("product_id", TX.brand(F.col("name")).alias("brand"))


def numbers(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_join(TX.standalone_numbers(F.col("name")), ",")
    return _product_names(spark, sf).select("product_id", found.alias("numbers"))


def dated_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Event times in four spellings, one of them unreadable."""
    ts = F.col("ts")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+10:00'"))
        .when(kind == 2, F.date_format(ts, "yyyyMMdd"))
        .otherwise(F.date_format(ts, "dd.MM.yyyy"))
    )
    return T.read(spark, sf, "events").select("event_id", TX.iso_date(text).alias("date"))


def group_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of groups made of all parts of one brand, type and size."""
    members = T.read(spark, sf, "part").select(
        F.concat_ws("/", "p_brand", "p_type", "p_size").alias("group_id"),
        T.product_name().alias("product_name"),
        F.col("p_partkey").alias("turn"),
    )
    return G.shared_group_names(members, ["turn"])


def shared_names(spark: SparkSession, sf: str) -> DataFrame:
    """Shared tokens of three spellings of each part's name."""
    name, brand = F.col("p_name"), F.col("p_brand")
    size = F.col("p_size").cast("string")
    spellings = F.array(
        F.concat_ws(" ", brand, name, size, F.lit("Pack & more (new)")),
        F.concat_ws(" ", name, F.lit("of"), brand, F.lit("/"), size, F.lit("pack")),
        F.concat_ws("-", size, F.lit("PACK"), brand, F.upper(name)),
    )
    return T.read(spark, sf, "part").select("p_partkey", TX.shared_token_name(spellings).alias("name"))


def price_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each member's highest price against its group's."""
    metrics = T.metrics(spark, sf)
    groups = T.group_bounds(spark, sf).select("group_id", F.col("max_price").alias("group_max"))
    return (
        T.membership(spark, sf)
        .select("group_id", "product_id", "vendor")
        .join(metrics, ["product_id", "vendor"])
        .join(groups, "group_id")
        .select(
            "product_id",
            "vendor",
            S.price_score(F.col("max_price"), F.col("group_max")).alias("price_score"),
            S.price_reason(F.col("max_price"), F.col("group_max")).alias("price_reason"),
        )
    )


def final_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Line discounts and taxes stand in for the scores, to cover many values."""
    name_score = (F.col("l_quantity") * 200 + F.col("l_linenumber") * 7 + F.col("l_suppkey") % 100) / 100
    points = F.when(F.col("l_returnflag") != "N", (F.col("l_tax") * 1000).cast("int"))
    return T.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.final_score(name_score, points).alias("final_score"),
    )


# matching -------------------------------------------------------------------


def _all_names(spark: SparkSession, sf: str) -> DataFrame:
    yes = F.lit(True)
    names = T.parts(spark, sf).select(
        "category", TX.normalised_name(F.col("product_name")).alias("name")
    )
    return staged(name_features(names.distinct().withColumns({"asks": yes, "answers": yes})), "names")


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names that may match as far as brand, numbers and penalties tell."""
    return gated_pairs(_all_names(spark, sf), S.DEFAULT_MIN_SCORE).select(
        "category", "l_name", "r_name", "penalty", "penalty_reasons"
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return MT.match_candidates(T.products(spark, sf), T.metrics(spark, sf))


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Registry and known membership, written first, as a run finds them."""
    products = staged(T.products(spark, sf), "products")
    return products, staged(known_members(spark, sf), "membership")


def scored_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names with their ratios, as far as they can reach the threshold."""
    return scored_pairs(_all_names(spark, sf), S.DEFAULT_MIN_SCORE).drop("penalty_reasons")


def candidate_products(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with a row for every pair of products."""
    products, metrics = staged(T.products(spark, sf), "products"), staged(T.metrics(spark, sf), "metrics")
    return MT.expand_copies(MT.match_candidates(products, metrics), products, metrics)


def indexed_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The review queue of all products through a stored index of the names in groups."""
    products, membership = _stored(spark, sf)
    store = TableStore(spark, scratch_path(spark, "index-store"), buckets=8)
    store.replace("product_match", membership)
    store.replace("product_metrics", T.metrics(spark, sf))
    index_names(store, membership)
    return indexed_review_queue(store, products)


def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of products in their order, the best one first."""
    return MT.numbered_candidates(candidate_products(spark, sf))


def new_review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The proposals of a first run, when no product has a group."""
    products = staged(T.products(spark, sf), "products")
    nobody = T.membership(spark, sf).limit(0)
    return MT.new_review_queue(products, nobody, staged(T.metrics(spark, sf), "metrics"))


def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return MT.candidate_report(MT.ranked_candidates(candidates(spark, sf)))


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return MT.review_queue(*_stored(spark, sf), T.metrics(spark, sf))


def assign_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Every new product has its part's group and the next part's on its queue.

    The reviewer accepts both for parts divisible by ten, none otherwise.
    """
    products, known = _stored(spark, sf)
    new = G.unmatched_products(products, known)
    part = F.col("product_id").cast("bigint")
    groups = known.select("group_id").distinct()
    queue = (
        new.select("product_id", "vendor", F.posexplode(F.array(part + 1, part)).alias("place", "group_id"))
        .join(groups, "group_id")
        .withColumn("rank", F.col("place") + 1)
    )
    decisions = queue.select("product_id", "vendor", "group_id", (part % 10 == 0).alias("accept"))
    return MT.assign_reviewed(products, known, queue, decisions)


def assign_best(spark: SparkSession, sf: str) -> DataFrame:
    metrics = staged(T.metrics(spark, sf), "metrics")
    return MT.assign_best(*_stored(spark, sf), metrics)


# payloads -------------------------------------------------------------------


def brand_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Names that hold their brand already on every other part; sizes on every third."""
    part = T.read(spark, sf, "part")
    own = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_brand"), F.lit(" "), F.col("p_name")))
    name = F.coalesce(own, F.col("p_name"))
    size = F.concat(F.col("p_size").cast("string"), F.lit(" Pack"))
    sized = F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit(" "), F.lower(size))).otherwise(name)
    return part.select("p_partkey", P.with_size(P.with_brand(F.col("p_brand"), sized), size).alias("product_name"))


def page_ids(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return T.read(spark, sf, "pages").select(
        "page_id",
        P.detail_id(url).alias("detail_id"),
        P.slug_id(F.regexp_replace(url, "/", "-")).alias("slug_id"),
        P.url_path(url).alias("path"),
        P.buy_id(F.regexp_replace(url, "/(en|fr|de|es)/", "/buy/")).alias("buy_id"),
        P.product_slug(F.regexp_replace(url, "/(en|fr|de|es)/", "/product/")).alias("slug"),
    )


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Full URLs, paths and slugs made canonical by the two rules."""
    url, kind = F.col("url"), F.col("page_id") % 3
    path = F.concat(F.lit("/product/p-"), F.col("page_id").cast("string"), F.lit("/"))
    given = F.when(kind == 0, url).when(kind == 1, path).otherwise(F.concat(F.lit(" slug-"), F.col("page_id"), F.lit("/ ")))
    return T.read(spark, sf, "pages").select(
        "page_id",
        P.absolute_url(given, SHOP_URL, "/product/", True).alias("wrapped_url"),
        P.absolute_url(F.replace(given, F.lit("product"), F.lit("buy")), SHOP_URL, "/buy/", False).alias("buy_url"),
    )


def page_names(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "pages").select("page_id", HT.page_name(F.col("html")).alias("name"))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "pages").select("page_id", HT.visible_text(F.col("html"), True).alias("text"))


def slug_names(spark: SparkSession, sf: str) -> DataFrame:
    slug = F.concat(F.lit("/"), F.lower(F.regexp_replace("p_name", " ", "--")), F.lit("_"), F.lower("p_type"), F.lit("/"))
    return T.read(spark, sf, "part").select("p_partkey", P.slug_name(slug).alias("name"))


def json_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One landed JSON response per line; ids, names, prices and sources missing now and then."""
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    some_id = F.when(key % 11 != 0, F.col("l_partkey").cast("string"))
    slug = F.when(key % 22 != 0, F.concat(F.lit(" slug-"), F.col("l_partkey").cast("string")))
    price = F.when(key % 13 != 0, F.col("l_extendedprice"))
    body = F.to_json(
        F.struct(
            some_id.alias("id"),
            slug.alias("slug"),
            F.col("p_brand").alias("brand"),
            F.col("p_name").alias("name"),
            F.concat(F.col("p_size").cast("string"), F.lit(" pack")).alias("size"),
            price.alias("price"),
        )
    )
    null_discount = F.concat(F.lit('{"discount_price":null,'), F.substr(body, F.lit(2)))
    source = F.when(key % 17 == 0, F.lit("gift")).when(line <= 4, I.SEARCH).otherwise(I.SPECIFIC)
    lines = T.lines_of(spark, sf).join(T.vendors(spark, sf), "l_suppkey")
    return lines.join(T.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "vendor",
        F.col("p_type").alias("category"),
        source.alias("source"),
        F.concat(F.lit("term"), line % 2).alias("search_term"),
        T.arrival().alias("seq"),
        F.lit(200).alias("status_code"),
        F.lit(None).cast("string").alias("request_url"),
        F.lit(None).cast("string").alias("final_url"),
        # half of the direct fetches name the product by URL
        F.when(line % 2 == 0, F.col("l_partkey").cast("string"))
        .otherwise(F.concat(F.lit("/buy/"), F.col("l_partkey")))
        .alias("requested_product_id"),
        F.when(key % 19 == 0, null_discount).otherwise(body).alias("body"),
    )


def _read_json(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = I.read_json_list_price(json_payloads(spark, sf)).withColumn("date", TX.iso_date(F.lit(AS_OF)))
    return I.split_rejects(rows)


def json_records(spark: SparkSession, sf: str) -> DataFrame:
    return _read_json(spark, sf)[0].select(*I.RECORD, F.col("seq").cast("string").alias("seq"))


def sized_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.read_json_sized(json_payloads(spark, sf)).withColumn("date", TX.iso_date(F.lit(AS_OF)))
    return I.split_rejects(rows)[0].select(*I.RECORD, F.col("seq").cast("string").alias("seq"))


def reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    rejects = _read_json(spark, sf)[1]
    return rejects.groupBy("vendor", "reason").agg(F.count("*").alias("n_rows"))


def first_hits(spark: SparkSession, sf: str) -> DataFrame:
    good = staged(_read_json(spark, sf)[0], "records")
    return I.first_search_hits(good, [ONE_VENDOR], ["seq"]).select(
        *I.RECORD, "search_term", F.col("seq").cast("string").alias("seq")
    )


def merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the direct fetches that name a product are answered with the one before it."""
    good = _read_json(spark, sf)[0]
    part = F.col("product_id").try_cast("bigint")
    moved = (F.col("source") == I.SPECIFIC) & F.col("requested_product_id").isNotNull() & (part % 5 == 0)
    asked = F.when(F.coalesce(moved, F.lit(False)), (part + 1).cast("string")).otherwise(F.col("requested_product_id"))
    good = staged(good.withColumn("requested_product_id", asked), "records")
    return I.merge_sources(good, ["seq"]).select(*I.RECORD, F.col("seq").cast("string").alias("seq"))


def _page_payloads(spark: SparkSession, sf: str, body: Column, path: str) -> DataFrame:
    """Every part as a landed page; a ninth of the requests failed, which their status tells."""
    key = F.col("p_partkey")
    url = F.concat(F.lit(f"{SHOP_URL}{path}"), F.when(key % 8 != 0, key.cast("string")).otherwise(F.lit("")), F.lit("/"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))))
    landed = T.read(spark, sf, "part").select(
        F.lit("shop").alias("vendor"),
        F.col("p_type").alias("category"),
        F.lit(I.SPECIFIC).alias("source"),
        F.lit(None).cast("string").alias("search_term"),
        key.alias("seq"),
        F.when(key % 9 != 0, 200).otherwise(404).alias("status_code"),
        url.alias("request_url"),
        url.alias("final_url"),
        F.concat(F.lit(path), key.cast("string"), F.lit("/x")).alias("requested_product_id"),
        body.alias("body"),
    )
    return successful(landed)


def heading_pages(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    heading = F.when(key % 5 != 0, F.concat(F.lit("<h1 class='a'> <b>"), F.col("p_brand"), F.lit("</b>\n"), F.col("p_name"), F.lit(" &amp; co</h1>"))).otherwise(F.lit(""))
    price = F.when(key % 7 != 0, F.concat(F.lit("<p>$0.00</p><i>$"), fixed(F.col("p_retailprice")), F.lit("</i> $1.50"))).otherwise(F.lit("$0"))
    page_id = F.when(key % 4 != 0, F.concat(F.lit("<div>product id: "), key + 5, F.lit("</div>"))).otherwise(F.lit(""))
    body = F.concat(
        F.lit("<html><head><title>"), F.col("p_name"), F.lit(" | Shop</title><script>var a='$9.99';</script></head><body>"),
        heading, price, page_id, F.lit("<!-- $8.88 --></body></html>"),
    )
    pages = _page_payloads(spark, sf, body, "/buy/")
    rows = I.normalise(pages, {"shop": I.html_heading_reader(" | Shop")}, AS_OF)
    return I.split_rejects(rows)[0].select(*I.RECORD)


def fixed(price: Column) -> Column:
    return F.format_string("%.2f", price)


def slug_pages(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    price = fixed(F.col("p_retailprice"))
    block = F.concat(F.lit("<b>A$ "), price, F.lit("</b> <p>$"), price, F.lit(" $1.25 per  item</p><p>$77.5 $0.75</p>"))
    twice = F.when(key % 2 == 0, F.concat(block, block)).otherwise(F.concat(F.lit("<p>$"), price, F.lit("</p>")))
    packs = F.when(key % 3 == 0, F.lit("<p>2 Packs</p><p>4 packs</p>")).when(key % 3 == 1, F.lit("<li>Thing (5ml), 1 Pack</li>")).otherwise(F.lit("Pack"))
    sku = F.when(key % 5 != 0, F.concat(F.lit("<span>SKU</span><span>K-"), key, F.lit("</span>"))).otherwise(F.lit(""))
    body = F.concat(F.lit("<body><noscript>$3.33</noscript>"), twice, packs, sku, F.lit("<style>$2.22</style></body>"))
    pages = _page_payloads(spark, sf, body, "/product/p_")
    rows = I.normalise(pages, {"shop": I.read_html_slug}, AS_OF)
    return I.split_rejects(rows)[0].select(*I.RECORD)


def filtered_records(spark: SparkSession, sf: str) -> DataFrame:
    return I.filter_terms(T.products(spark, sf), config_table(spark, CONFIG))


def filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    before = T.products(spark, sf)
    return Q.filter_report(before, I.filter_terms(before, config_table(spark, CONFIG)))


def targets_with_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The targets of a run at two vendors, with the products that each has now."""
    targets = fetch_targets(config_table(spark, CONFIG), ["ASIA", "EUROPE", "AFRICA"], only_categories=["ECONOMY", "SMALL"])
    counts = T.products(spark, sf).groupBy("category", "vendor").agg(F.count("*").alias("n_products"))
    return targets.join(counts, ["category", "vendor"], "left").drop("position", "vendor_position")


def config_with_rows(spark: SparkSession, sf: str) -> DataFrame:
    counts = T.products(spark, sf).groupBy("category").agg(F.count("*").alias("n_products"))
    return config_summary(config_table(spark, CONFIG)).join(counts, "category", "left")


# stream ---------------------------------------------------------------------


def streamed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of prices, folded batch by batch into a metrics table."""
    schema = T.read(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    prices = events.select(
        F.col("ts").cast("date").alias("date"),
        F.col("user_id").cast("string").alias("product_id"),
        F.col("event_type").alias("vendor"),
        F.lit("event").alias("category"),
        F.col("value").alias("price"),
    )
    store = TableStore(spark, scratch_path(spark, "stream-store"), buckets=8)
    maintain_metrics(prices, store, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return store.read("product_metrics")


QUERIES: dict[str, Query] = {
    "sca_1_normalised_names": normalised_names,
    "sca_3_shared_name": shared_names,
    "sca_5_attributes": attributes,
    "sca_7_price_score": price_scores,
    "sca_8_brand": brands,
    "sca_9_numbers": numbers,
    "sca_11_final_score": final_scores,
    "sca_16_dates": dated_texts,
    "mat_5_group_names": group_names,
    "joi_7_gated_name_pairs": name_pairs,
    "joi_7_scored_names": scored_names,
    "mat_1_candidates": candidates,
    "mat_1_candidate_products": candidate_products,
    "top_8_ranked_candidates": ranked_candidates,
    "mat_2_indexed_queue": indexed_queue,
    "out_6_candidate_rows": candidate_rows,
    "mat_2_review_queue": review_queue,
    "mat_2_new_products": new_review_queue,
    "mat_3_assign": assign_reviewed,
    "mat_4_auto_assign": assign_best,
    "nrm_1_json_records": json_records,
    "nrm_2_brand_prefix": brand_prefixes,
    "nrm_6_sized_records": sized_records,
    "nrm_7_page_ids": page_ids,
    "nrm_10_urls": page_urls,
    "nrm_11_html_name": page_names,
    "nrm_12_visible_text": page_texts,
    "nrm_13_heading_pages": heading_pages,
    "nrm_14_slug_pages": slug_pages,
    "nrm_18_slug_names": slug_names,
    "nrm_21_rejects": reject_counts,
    "nrm_22_merge_sources": merged_sources,
    "nrm_23_first_seen": first_hits,
    "flt_1_term_filter": filtered_records,
    "agg_11_filter_report": filter_counts,
    "flt_2_fetch_targets": targets_with_rows,
    "agg_12_config_summary": config_with_rows,
    "str_1_incremental_metrics": streamed_metrics,
}
