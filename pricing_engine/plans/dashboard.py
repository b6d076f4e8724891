"""Dashboard tables: one row per group, one row per member, and the searches.

Members are a table of their own, or nested in numbered chunks of bounded size: a
group with very many members is several rows, and none of them gathers it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricing_engine.functions import scoring as S
from pricing_engine.functions.text import category_label, money_text
from pricing_engine.operators.history import PRODUCT_KEY
from pricing_engine.operators.numbering import number_rows
from pricing_engine.plans.analysis import TOP_K, top_per_category

# Fixed value: the price that a member without one sorts by
NO_PRICE_RANK = 999

CHUNK = 1_000  # members of one array
_MEMBER = [*PRODUCT_KEY, "product_name", "current_price", "last_seen_date", "max_price", "min_price", "last_updated"]


def dashboard_members(
    membership: DataFrame, latest: DataFrame, metrics: DataFrame, products: DataFrame | None = None
) -> DataFrame:
    """Every member with its current price, date and bounds, null where unknown."""
    rows = membership
    if "product_name" not in rows.columns and products is not None:
        rows = rows.join(products.select(*PRODUCT_KEY, "product_name"), PRODUCT_KEY, "left")
    return (
        rows.select("group_id", *PRODUCT_KEY, "product_name")
        .join(latest.select(*PRODUCT_KEY, "current_price", "last_seen_date"), PRODUCT_KEY, "left")
        .join(
            metrics.select(*PRODUCT_KEY, "max_price", "min_price", "last_updated"),
            PRODUCT_KEY,
            "left",
        )
    )


def member_order() -> list[Column]:
    """Group, then price with missing and zero last at 999, then vendor and product."""
    price = F.coalesce(F.nullif("current_price", F.lit(0.0)), F.lit(float(NO_PRICE_RANK)))
    return [F.col("group_id"), price, F.col("vendor"), F.col("product_id")]


def ordered_members(members: DataFrame) -> DataFrame:
    return members.orderBy(*member_order())


def nested_members(members: DataFrame, size: int = CHUNK) -> DataFrame:
    """group_id, chunk (from 0) and members, an array of up to ``size`` in stored order.

    Members are numbered over all groups at once, range by range, and chunks follow from
    the distance to the group's first number.
    """
    price = F.coalesce(F.nullif("current_price", F.lit(0.0)), F.lit(float(NO_PRICE_RANK)))
    numbered = number_rows(members.withColumn("_price", price), ["group_id", "_price", "vendor", "product_id"], 0, "_place")
    numbered = numbered.drop("_price")  # the numbering is written, so both uses read the same numbers
    first = numbered.groupBy("group_id").agg(F.min("_place").alias("_first"))
    chunk = F.expr(f"CAST((_place - _first) DIV {size} AS INT)").alias("chunk")
    placed = numbered.join(first, "group_id").select("group_id", chunk, F.struct("_place", *_MEMBER).alias("member"))
    nested = placed.groupBy("group_id", "chunk").agg(F.sort_array(F.collect_list("member")).alias("members"))
    return nested.withColumn("members", F.transform("members", lambda m: m.dropFields("_place")))


def nested_groups(groups: DataFrame, members: DataFrame, size: int = CHUNK) -> DataFrame:
    """The dashboard's groups with their members inside: a row for every chunk of them."""
    return groups.join(nested_members(members, size), "group_id")


def snapshot_members(membership: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every member with its group's name and category and all that the snapshot knows of it.

    One join, where latest prices and bounds come from the same snapshot.
    """
    known = ["current_price", "last_seen_date", "max_price", "min_price", "last_updated"]
    rows = membership.select("group_id", "group_name", "category", *PRODUCT_KEY, "product_name")
    return rows.join(snapshot.select(*PRODUCT_KEY, *known), PRODUCT_KEY, "left")


def _offers() -> list[Column]:
    cheapest = F.when(
        F.col("current_price").isNotNull(), F.struct("current_price", "vendor", "product_id")
    )
    return [
        F.count("*").alias("n_members"),
        F.min_by(F.struct("vendor", "current_price"), cheapest).alias("best"),
    ]


def snapshot_groups(members: DataFrame) -> DataFrame:
    """One row per group that has a priced member, from one aggregate of its members."""
    return _shown_groups(
        members.groupBy("group_id", "group_name", "category").agg(
            *_offers(),
            F.max("max_price").alias("max_price"),
            F.min("min_price").alias("min_price"),
            F.max("last_updated").alias("last_updated"),
        )
    )


def dashboard_groups(members: DataFrame, grouped_metrics: DataFrame) -> DataFrame:
    """One row per group that has a priced member, with bounds from a table of their own."""
    return _shown_groups(grouped_metrics.join(members.groupBy("group_id").agg(*_offers()), "group_id"))


def _shown_groups(groups: DataFrame) -> DataFrame:
    current, low, high = F.col("current_price"), F.col("group_min_price"), F.col("group_max_price")
    return (
        groups.where(F.col("best").isNotNull())
        .select(
            "group_id",
            "group_name",
            "category",
            F.col("best.current_price").alias("current_price"),
            F.col("best.vendor").alias("best_vendor"),
            F.col("max_price").alias("group_max_price"),
            F.col("min_price").alias("group_min_price"),
            "last_updated",
            "n_members",
            (F.col("n_members") > 1).alias("is_multi"),
        )
        .withColumn("discount", S.dashboard_discount(current, high))
        .withColumn("status", S.price_status(current, low, high, "full_first"))
    )


def dashboard_top_cheapest(groups: DataFrame, k: int = TOP_K) -> DataFrame:
    order = [F.col("current_price"), F.col("group_name"), F.col("group_id")]
    return top_per_category(groups, order, k)


def dashboard_top_discounted(groups: DataFrame, k: int = TOP_K) -> DataFrame:
    order = [F.desc("discount"), F.col("current_price"), F.col("group_name"), F.col("group_id")]
    return top_per_category(groups, order, k)


def alphabetical(groups: DataFrame) -> DataFrame:
    return groups.orderBy("category", F.lower("group_name"), "group_id")


def category_page(groups: DataFrame, category: str) -> DataFrame:
    """Groups of one category; empty for an unknown one."""
    return groups.where(F.col("category") == category)


def _shown(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def search_groups(
    groups: DataFrame,
    members: DataFrame,
    text: str = "",
    status: str = "",
    vendor: str = "",
) -> DataFrame:
    """Groups whose shown row, or shown member rows, hold a text; by status and vendor.

    Empty arguments do not restrict.  Member rows are shown for groups of several.
    """
    query = text.strip().lower()
    price = F.col("current_price")
    group_text = _shown(
        F.col("group_name"),
        S.status_badge(F.col("status"), F.col("discount")),
        category_label(F.col("best_vendor")),
        money_text(price),
        F.col("last_updated").cast("string"),
    )
    member_text = _shown(
        category_label(F.col("vendor")),
        F.col("product_name"),
        F.coalesce(money_text(price), F.lit("—")),
        F.col("last_seen_date").cast("string"),
    )
    found = groups.where(F.col("status") == status) if status else groups
    if not query and not vendor:
        return found
    hits = members.groupBy("group_id").agg(
        F.max(F.contains(member_text, F.lit(query))).alias("text_hit"),
        F.max(F.col("vendor") == vendor).alias("vendor_hit"),
    )
    joined = found.join(hits, "group_id")
    if query:
        member_hit = F.col("is_multi") & F.col("text_hit")
        joined = joined.where(F.contains(group_text, F.lit(query)) | member_hit)
    if vendor:
        joined = joined.where("vendor_hit")
    return joined.select(groups.columns)


def search_categories(groups: DataFrame, text: str) -> DataFrame:
    """Categories with their number of groups, those whose label holds a text."""
    query = text.strip().lower()
    label = F.lower(category_label(F.col("category")))
    return (
        groups.where(F.contains(label, F.lit(query)))
        .groupBy("category")
        .agg(F.count("*").alias("n_groups"))
    )


def category_titles(groups: DataFrame) -> DataFrame:
    """Page titles: the category in capitals and how many products it tracks."""
    counts = groups.groupBy("category").agg(F.count("*").alias("n_groups"))
    return counts.withColumn("title", F.upper(category_label(F.col("category"))))


def history_texts(series: DataFrame) -> DataFrame:
    """A price series with dates as ``yyyy-MM-dd`` text."""
    return series.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "price")
