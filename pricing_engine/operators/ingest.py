"""Landed payloads to price records: one reader per payload shape, then shared rules.

A reader takes payload rows and returns the record columns plus what the merge
needs.  Rows that give no id, name, price or a known source are not dropped
silently and do not stop the run: ``split_rejects`` sets them apart with a reason.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricing_engine.functions import html as H
from pricing_engine.functions import payload_fields as P
from pricing_engine.functions.text import folded_term, iso_date, safe_number, strip_spaces
from pricing_engine.session import computed_once, staged

# Fixed values
SEARCH, SPECIFIC = "search", "specific"
SOURCES = [SEARCH, SPECIFIC]

RECORD = ["date", "product_id", "vendor", "product_name", "category", "price", "source"]
_CONTEXT = ["vendor", "category", "source", "search_term", "seq", "requested_product_id"]

Reader = Callable[[DataFrame], DataFrame]


def _records(
    payloads: DataFrame,
    product_id: Column,
    name: Column,
    price: Column,
    known_source: Column,
    name_required: bool,
) -> DataFrame:
    return computed_once(
        payloads,
        *_CONTEXT,
        P.blank_to_null(strip_spaces(product_id)).alias("product_id"),
        name.alias("product_name"),
        safe_number(price).alias("price"),
        known_source.alias("known_source"),
        F.lit(name_required).alias("name_required"),
    )


def _json_fields(payloads: DataFrame, fields: list[str], stated: list[str] | None = None) -> DataFrame:
    """The body parsed once, as a variant: ``j`` has its top-level fields as text, ``stated`` which of those keys it has.

    Bodies that are landed as VARIANT are not parsed again.  A null that a key states
    is a value of a variant, so that it differs from an absent key.  What is no JSON
    object, or (unless ``spark.sql.variant.allowDuplicateKeys`` is set) repeats a
    key, has no field.
    """
    landed = isinstance(payloads.schema["body"].dataType, T.VariantType)
    body = F.col("body") if landed else F.try_parse_json("body")
    parsed = computed_once(payloads, *_CONTEXT, body.alias("v"))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(F.col("v"), f"$.{name}", kind)

    # a field is taken out of each body for every use, and nothing prunes those that have none
    keys = [F.struct(*[field(name, "variant").isNotNull().alias(name) for name in stated]).alias("stated")] if stated else []
    return computed_once(
        parsed, *_CONTEXT, F.struct(*[field(name, "string").alias(name) for name in fields]).alias("j"), *keys
    )


def _text(field: str) -> Column:
    return P.blank_to_null(F.col(f"j.{field}"))


def _known_source() -> Column:
    return F.coalesce(F.col("source").isin(SOURCES), F.lit(False))


def read_json_list_price(payloads: DataFrame) -> DataFrame:
    """JSON with ``id``/``slug``, ``brand``, ``name`` and ``price``.

    A ``discount_price`` key replaces the price even when its value is null.
    """
    parsed = _json_fields(payloads, ["id", "slug", "brand", "name", "price", "discount_price"], ["name", "discount_price"])
    null_name = F.col("stated.name") & F.col("j.name").isNull()
    name = F.when(~null_name, F.coalesce("j.name", F.lit("")))
    return _records(
        parsed,
        F.coalesce(_text("id"), _text("slug")),
        P.with_brand(_text("brand"), name),
        F.when(F.col("stated.discount_price"), F.col("j.discount_price")).otherwise(F.col("j.price")),
        _known_source(),
        name_required=False,
    )


_SIZED_FIELDS = [
    "id", "product_id", "sku", "url", "source_url", "brand", "product_brand", "name",
    "product_name", "size", "product_size", "discount_price", "price", "current_price",
]


def read_json_sized(payloads: DataFrame) -> DataFrame:
    """JSON of search hits or details: ``product_*`` or plain keys, size kept apart."""

    def first_of(*fields: str) -> Column:
        return F.coalesce(*[_text(field) for field in fields])

    parsed = _json_fields(payloads, _SIZED_FIELDS)
    specific = F.col("source") == SPECIFIC
    # texts that later steps use several times
    texts = computed_once(
        parsed,
        *_CONTEXT,
        F.when(specific, first_of("id", "sku")).alias("own"),
        strip_spaces(
            F.when(specific, F.col("requested_product_id")).otherwise(
                F.coalesce(first_of("id", "product_id", "sku"), first_of("url", "source_url"))
            )
        ).alias("identifier"),
        first_of("brand", "product_brand").alias("brand"),
        F.coalesce(first_of("name", "product_name"), F.lit("")).alias("title"),
        first_of("size", "product_size").alias("size"),
        F.coalesce("j.discount_price", "j.price", "j.current_price").alias("price"),
    )
    named = computed_once(
        texts,
        *_CONTEXT,
        F.coalesce("own", P.detail_id(F.col("identifier"))).alias("id"),
        P.with_brand(F.col("brand"), F.col("title")).alias("name"),
        "size",
        "price",
    )
    return _records(
        named,
        F.col("id"),
        P.with_size(F.col("name"), F.col("size")),
        F.col("price"),
        _known_source(),
        name_required=False,
    )


def _with_text(payloads: DataFrame, drop_noscript: bool) -> DataFrame:
    text = H.visible_text(F.col("body"), drop_noscript).alias("text")
    return computed_once(payloads, *_CONTEXT, "final_url", "body", text)


def html_heading_reader(site_suffix: str) -> Reader:
    """HTML with the name in a heading and the id in a ``/buy/<id>`` path."""

    def read(payloads: DataFrame) -> DataFrame:
        text = _with_text(payloads, drop_noscript=False)
        product_id = F.coalesce(
            P.buy_id(F.col("final_url")),
            P.page_product_id(F.col("text")),
            P.buy_id(F.col("requested_product_id")),
        )
        return _records(
            text,
            product_id,
            H.page_name(F.col("body"), site_suffix),
            P.first_positive_price(F.col("text")),
            F.lit(True),
            name_required=True,
        )

    return read


def read_html_slug(payloads: DataFrame) -> DataFrame:
    """HTML with the name in the URL's slug, a SKU block and pack prices."""
    text = _with_text(payloads, drop_noscript=True)
    slug = P.product_slug(F.col("final_url"))
    named = computed_once(
        text,
        *_CONTEXT,
        "text",
        F.coalesce(P.slug_name(slug), F.lit("")).alias("name"),
        P.pack_label(F.col("text")).alias("label"),
        P.money_values(F.col("text")).alias("amounts"),
    )
    product_id = F.coalesce(P.sku(F.col("text")), P.product_slug(F.col("requested_product_id")))
    return _records(
        named,
        product_id,
        P.with_pack_label(F.col("name"), F.col("label")),
        P.pack_price(F.col("amounts"), F.col("text")),
        F.lit(True),
        name_required=True,
    )


def normalise(payloads: DataFrame, readers: Mapping[str, Reader], as_of: str) -> DataFrame:
    """Records of all vendors; the payloads of vendors with one reader are read in one scan."""
    vendors: dict[Reader, list[str]] = {}
    for vendor, reader in readers.items():
        vendors.setdefault(reader, []).append(vendor)
    read = [reader(payloads.where(F.col("vendor").isin(names))) for reader, names in vendors.items()]
    rows = reduce(DataFrame.unionByName, read)
    return rows.withColumn("date", iso_date(F.lit(as_of)))


def reject_reason() -> Column:
    """Why a record cannot be used; null for a good one."""
    nameless = F.col("product_name").isNull() | (F.col("name_required") & (F.col("product_name") == ""))
    return (
        F.when(F.col("product_id").isNull(), "missing id")
        .when(nameless, "missing name")
        .when(F.col("price").isNull(), "missing price")
        .when(~F.col("known_source"), "unknown source")
        .when(F.col("date").isNull(), "unreadable date")
    )


def split_rejects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable records, and the others with a ``reason``."""
    marked = records.withColumn("reason", reject_reason())
    good, bad = marked.where(F.col("reason").isNull()), marked.where(F.col("reason").isNotNull())
    return good.drop("reason"), bad


def first_seen(hits: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """One row per key: the one that arrived first."""
    payload = [c for c in hits.columns if c not in keys]
    first = F.min_by(F.struct(*payload), F.struct(*arrival)).alias("first")
    return hits.groupBy(*keys).agg(first).select(*keys, "first.*").select(hits.columns)


def first_search_hits(records: DataFrame, vendors: list[str], arrival: list[str]) -> DataFrame:
    """Search hits of some vendors, once per search term and product; other rows as they are."""
    repeats = (F.col("source") == SEARCH) & F.col("vendor").isin(vendors)
    keys = ["category", "vendor", "search_term", "product_id"]
    once = first_seen(records.where(repeats), keys, arrival)
    return records.where(~F.coalesce(repeats, F.lit(False))).unionByName(once)


def _chained(waiting: DataFrame) -> DataFrame:
    """(_id, _root, _flips): where chains of ``_id`` to ``_to`` end, and whether over an odd number of steps.

    Every round doubles the steps that a row looks ahead, so a chain of n takes log n.
    """
    rows = staged(waiting.select("_id", F.col("_to").alias("_root"), F.lit(True).alias("_flips")), "chains")
    while True:
        ahead = rows.select(F.col("_id").alias("_root"), F.col("_root").alias("_next"), F.col("_flips").alias("_more"))
        both = rows.join(ahead, "_root", "left")
        further = F.coalesce(F.col("_flips") != F.col("_more"), F.col("_flips"))
        moved = F.col("_next").isNotNull()
        rows = staged(both.select("_id", F.coalesce("_next", "_root").alias("_root"), further.alias("_flips"), moved.alias("_moved")), "chains")
        if rows.where("_moved").isEmpty():
            return rows.drop("_moved")
        rows = rows.drop("_moved")


def _needed_fetches(direct: DataFrame, arrival: list[str]) -> DataFrame:
    """Direct fetches whose raw identifier no earlier needed fetch of the run has given.

    A fetch with no open fetch before it that gives its identifier is settled at once.
    One that waits for a single other is needed if that one is not, so chains of these
    are followed to their ends by doubling.  What waits for several waits for the next
    round, which carries identifiers of open fetches only.
    """
    scope = ["category", "vendor"]
    rows = staged(direct.withColumns({"_order": F.struct(*arrival), "_id": F.monotonically_increasing_id()}), "fetches")
    asks, gives = F.col("requested_product_id").alias("_asks"), F.col("product_id").alias("_gives")
    left = rows.select(*scope, "_id", "_order", asks, gives)
    needed = left.where("false")
    while True:
        known = needed.groupBy(*scope, F.col("_gives").alias("_asks")).agg(F.min("_order").alias("_given"))
        openly = left.groupBy(*scope, F.col("_gives").alias("_asks")).agg(
            F.min("_order").alias("_open"), F.count("*").alias("_givers"), F.min("_id").alias("_to")
        )
        joined = left.join(known, [*scope, "_asks"], "left").join(openly, [*scope, "_asks"], "left")
        late = F.coalesce(F.col("_order") > F.col("_given"), F.lit(False))
        waits = F.coalesce(F.col("_order") > F.col("_open"), F.lit(False))
        judged = joined.withColumn("_needed", F.when(late, False).when(~waits, True))
        judged = staged(judged.select(left.columns + ["_needed", "_givers", "_to"]), "judged")
        single = judged.where(F.col("_needed").isNull() & (F.col("_givers") == 1))
        if not single.isEmpty():
            ends = judged.where(F.col("_needed").isNotNull()).select(F.col("_id").alias("_root"), F.col("_needed").alias("_end"))
            told = _chained(single).join(ends, "_root").select("_id", (F.col("_end") != F.col("_flips")).alias("_told"))
            judged = judged.join(told, "_id", "left").withColumn("_needed", F.coalesce("_needed", "_told"))
        judged = staged(judged.select(left.columns + ["_needed"]), "judged")
        needed = needed.unionByName(judged.where("_needed").select(left.columns))
        left = judged.where(F.col("_needed").isNull()).select(left.columns)
        if left.isEmpty():
            return rows.join(needed.select("_id"), "_id", "left_semi").drop("_order", "_id")


def merge_sources(records: DataFrame, arrival: list[str]) -> DataFrame:
    """One record per category, vendor and product out of search hits and direct fetches.

    The last search hit wins among search hits.  A direct fetch overrides it, the last
    one among them, unless its raw identifier names a product found by search or given
    by an earlier direct fetch that was itself needed.
    """
    key = ["category", "vendor", "product_id"]
    payload = F.struct(*[c for c in records.columns if c not in key])
    order = F.struct(*arrival)
    hits = records.where(F.col("source") == SEARCH).groupBy(*key).agg(F.max_by(payload, order).alias("hit"))
    found = hits.select("category", "vendor", F.col("product_id").alias("requested_product_id"))
    # a fetch without a raw identifier is always needed
    direct = records.where(F.col("source") == SPECIFIC).join(
        found, ["category", "vendor", "requested_product_id"], "left_anti"
    )
    needed = _needed_fetches(direct.select(records.columns), arrival)
    fetched = needed.groupBy(*key).agg(F.max_by(payload, order).alias("fetch"))
    chosen = F.coalesce("fetch", "hit").alias("last")
    merged = hits.join(fetched, key, "full_outer").select(*key, chosen)
    return merged.select(*key, "last.*").select(records.columns)


def _folded(terms: Column) -> Column:
    folded = F.transform(F.coalesce(terms, F.array().cast("array<string>")), folded_term)
    return F.filter(folded, lambda t: t != "")


def filter_terms(records: DataFrame, config: DataFrame) -> DataFrame:
    """Records whose name passes the terms of their category.

    Terms are plain substrings in any case: none of the excluded ones, all of the
    required ones, and one of the alternatives if there are any.
    """
    rules = config.select(
        "category",
        _folded(F.col("must_include")).alias("_all"),
        _folded(F.col("or_include")).alias("_any"),
        _folded(F.col("must_exclude")).alias("_none"),
    )
    name = F.lower("product_name")
    allowed = (
        ~F.exists("_none", lambda t: F.contains(name, t))
        & F.forall("_all", lambda t: F.contains(name, t))
        & ((F.size("_any") == 0) | F.exists("_any", lambda t: F.contains(name, t)))
    )
    joined = records.join(rules, "category", "left")
    return joined.where(F.coalesce(allowed, F.lit(True))).select(records.columns)
