"""Queries over the stored tables: history, registry, metrics, groups, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricing_engine.functions import scoring as S
from pricing_engine.operators import groups as G
from pricing_engine.operators import history as H
from pricing_engine.operators import metrics as M
from pricing_engine.operators import quality as Q
from pricing_engine.plans import analysis as A
from pricing_engine.plans import dashboard as D
from pricing_engine.session import staged
from pricing_engine.sources import sample_tables as T
from pricing_engine.sources.tables import conform, valid_prices

Query = Callable[[SparkSession, str], DataFrame]

SPLIT_DATE = "1998-07-01"
ONE_PRODUCT, ONE_VENDOR = "7", "ASIA"
ONE_CATEGORY = "PROMO"
SEARCH_TEXT, SEARCH_STATUS, SEARCH_VENDOR = "gear 1", S.DISCOUNTED, "ASIA"
CATEGORY_TEXT = "M"

_STORED_LINES = "l_linenumber <= 4"
_NEW_LINES = "l_linenumber >= 3"


def scan_history(spark: SparkSession, sf: str) -> DataFrame:
    """Dates and prices arrive as text, as from CSV; every 50th price is unreadable."""
    raw = T.observations(spark, sf)
    broken = F.pmod(F.col("product_id").cast("bigint"), F.lit(50)) == 0
    text = raw.withColumn("date", F.date_format("date", "yyyy-MM-dd'T'00:00:00'Z'")).withColumn(
        "price", F.when(broken, F.lit("n/a")).otherwise(F.col("price").cast("string"))
    )
    return valid_prices(conform(text, "price_history"))


def dedupe_history(spark: SparkSession, sf: str) -> DataFrame:
    stored = H.keep_last(T.observations(spark, sf, _STORED_LINES), H.HISTORY_KEY)
    return H.upsert_history(stored, T.observations(spark, sf, _NEW_LINES))


def upsert_registry(spark: SparkSession, sf: str) -> DataFrame:
    stored = H.keep_last(H.product_rows(T.records(spark, sf, _STORED_LINES)), H.PRODUCT_KEY)
    return H.upsert_registry(stored, H.product_rows(T.records(spark, sf, _NEW_LINES)))


def _before(spark: SparkSession, sf: str) -> DataFrame:
    return M.batch_metrics(T.observations(spark, sf, f"l_shipdate < '{SPLIT_DATE}'"))


def _after(spark: SparkSession, sf: str) -> DataFrame:
    return T.observations(spark, sf, f"l_shipdate >= '{SPLIT_DATE}'")


def incremental_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.fold_metrics(_before(spark, sf), _after(spark, sf))


def compare_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.compare_metrics(_before(spark, sf), M.batch_metrics(_after(spark, sf)))


def latest_batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.fold_latest_batch(_before(spark, sf), T.price_history(spark, sf))


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n_rows", "n_invalid", "n_after_dedupe", "n_products")]
    return Q.history_report(T.observations(spark, sf)).select(*counts, "vendors")


def next_group_id(spark: SparkSession, sf: str) -> DataFrame:
    return T.membership(spark, sf).agg(G.highest_and_one().alias("next_group_id"))


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    return G.priced_members(T.membership(spark, sf), H.latest_prices(T.price_history(spark, sf)))


def _analysis(spark: SparkSession, sf: str) -> DataFrame:
    return A.analyse_snapshot(H.product_snapshot(T.price_history(spark, sf)), T.membership(spark, sf))


def analysis(spark: SparkSession, sf: str) -> DataFrame:
    return A.category_lists(_analysis(spark, sf))


def analysis_from_tables(spark: SparkSession, sf: str) -> DataFrame:
    return A.category_lists(
        A.analyse_groups(T.price_history(spark, sf), T.group_bounds(spark, sf), T.membership(spark, sf))
    )


def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = A.category_summary(_analysis(spark, sf))
    ids = [
        F.array_join(F.transform(name, lambda e: e["group_id"].cast("string")), ",").alias(name)
        for name in (A.TOP_CHEAPEST, A.TOP_DISCOUNTED)
    ]
    return summary.select("category", F.col("n_at_low").cast("bigint").alias("n_at_low"), *ids)


def _product_status(spark: SparkSession, sf: str, precedence: str) -> DataFrame:
    """Status of single products, of which many were seen once (minimum = maximum)."""
    seen = H.product_snapshot(T.price_history(spark, sf))
    status = S.price_status(F.col("current_price"), F.col("min_price"), F.col("max_price"), precedence)
    return seen.select("product_id", "vendor", "current_price", status.alias("status"))


def discounts(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).select("group_id", "current_price", "discount")


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("category", "rank", "group_id", "group_name", "current_price", "best_vendor", "discount")


def _members(spark: SparkSession, sf: str) -> DataFrame:
    snapshot = H.product_snapshot(T.price_history(spark, sf))
    return D.dashboard_members(T.membership(spark, sf), snapshot, snapshot)


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return D.snapshot_members(T.membership(spark, sf), H.product_snapshot(T.price_history(spark, sf)))


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return D.snapshot_groups(_known(spark, sf))


def groups_from_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The same groups from separate tables of latest prices and bounds."""
    return D.dashboard_groups(_members(spark, sf), T.group_bounds(spark, sf))


def search(spark: SparkSession, sf: str) -> DataFrame:
    members = staged(_known(spark, sf), "members")
    return D.search_groups(D.snapshot_groups(members), members, SEARCH_TEXT, SEARCH_STATUS, SEARCH_VENDOR).select(
        "group_id", "group_name", "category", "best_vendor", "status"
    )


def members_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Members with a seventh of the prices zeroed and a seventh missing, in display order."""
    seventh = F.pmod(F.col("product_id").cast("bigint"), F.lit(7))
    price = F.when(seventh == 0, 0.0).when(seventh != 1, F.col("current_price"))
    return D.ordered_members(_members(spark, sf).withColumn("current_price", price)).select(
        "group_id", "product_id", "vendor", "current_price"
    )


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.report_rows(analysis(spark, sf))


def unmatched_products(spark: SparkSession, sf: str) -> DataFrame:
    return G.unmatched_products(T.products(spark, sf), known_members(spark, sf))


def known_members(spark: SparkSession, sf: str) -> DataFrame:
    """Membership as of an earlier run: a fifth of the parts at one vendor is missing."""
    new = (F.col("group_id") % 5 == 0) & (F.col("vendor") == ONE_VENDOR)
    return T.membership(spark, sf).where(~new)


def products_with_max(spark: SparkSession, sf: str) -> DataFrame:
    """Every product with its highest price of all times; a seventh of them has no metrics yet."""
    from pricing_engine.operators.matching import with_max_price

    known = T.metrics(spark, sf).where(F.pmod(F.col("product_id").cast("bigint"), F.lit(7)) != 0)
    return with_max_price(T.products(spark, sf), known).select(
        "product_id", "vendor", "product_name", "max_price"
    )


def nested_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with their members inside, the array as JSON text.

    Both come from one written snapshot and membership, so the lines are reduced once.
    """
    snapshot = staged(H.product_snapshot(T.price_history(spark, sf)), "snapshot")
    membership = staged(T.membership(spark, sf), "membership")
    groups = D.snapshot_groups(D.snapshot_members(membership, snapshot))
    nested = D.nested_groups(groups, D.dashboard_members(membership, snapshot, snapshot))
    return nested.withColumn("members", F.to_json("members", {"ignoreNullFields": "false"}))


QUERIES: dict[str, Query] = {
    "src_1_price_history": scan_history,
    "src_2_products": T.products,
    "win_4_dedupe_history": dedupe_history,
    "win_5_upsert_registry": upsert_registry,
    "win_1_latest_price": lambda s, d: H.latest_prices(T.price_history(s, d)),
    "flt_4_latest_batch": lambda s, d: H.latest_batch(T.price_history(s, d)),
    "flt_7_product_history": lambda s, d: H.product_history(T.price_history(s, d), ONE_PRODUCT, ONE_VENDOR),
    "agg_1_batch_metrics": lambda s, d: M.batch_metrics(T.observations(s, d)),
    "agg_3_incremental_metrics": incremental_metrics,
    "joi_1_compare_metrics": compare_metrics,
    "agg_4_latest_batch_metrics": latest_batch_metrics,
    "agg_5_group_metrics": T.group_bounds,
    "agg_7_quality_report": quality_report,
    "agg_8_next_group_id": next_group_id,
    "agg_10_category_counts": lambda s, d: G.groups_per_category(_groups(s, d)),
    "joi_3_priced_members": _priced,
    "win_2_best_offer": lambda s, d: G.best_offers(_priced(s, d), "newest"),
    "win_3_best_offer_simple": lambda s, d: G.best_offers(_priced(s, d), "stored"),
    "sca_13_discount": discounts,
    "sca_14_status": lambda s, d: _product_status(s, d, "cheapest_first"),
    "sca_15_status_full_first": lambda s, d: _product_status(s, d, "full_first"),
    "top_1_cheapest": lambda s, d: _ranked(A.top_cheapest(_analysis(s, d))),
    "top_2_discounted": lambda s, d: _ranked(A.top_discounted(_analysis(s, d))),
    "top_3_at_low": lambda s, d: A.at_low(_analysis(s, d)).drop("status"),
    "top_4_cheapest": lambda s, d: _ranked(D.dashboard_top_cheapest(_groups(s, d))),
    "top_5_discounted": lambda s, d: _ranked(D.dashboard_top_discounted(_groups(s, d))),
    "top_6_alphabetical": lambda s, d: D.alphabetical(_groups(s, d)).select("category", "group_id", "group_name"),
    "top_7_members": members_in_order,
    "out_1_analysis": analysis,
    "out_1_analysis_from_tables": analysis_from_tables,
    "out_1_category_summary": category_summary,
    "out_2_groups": _groups,
    "out_2_groups_from_tables": groups_from_tables,
    "out_2_members": _members,
    "out_2_nested_groups": nested_groups,
    "out_3_category": lambda s, d: D.category_page(_groups(s, d), ONE_CATEGORY),
    "out_4_history_texts": lambda s, d: D.history_texts(
        H.product_history(T.price_history(s, d), ONE_PRODUCT, ONE_VENDOR)
    ),
    "out_5_report_rows": report_rows,
    "flt_8_search": search,
    "flt_9_category_search": lambda s, d: D.search_categories(_groups(s, d), CATEGORY_TEXT),
    "sca_17_category_titles": lambda s, d: D.category_titles(_groups(s, d)),
    "joi_9_unmatched_products": unmatched_products,
    "joi_5_products_with_max": products_with_max,
}
