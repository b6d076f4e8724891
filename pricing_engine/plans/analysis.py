"""Price analysis per group and the ranked lists per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricing_engine.functions import scoring as S
from pricing_engine.functions.text import money_text, percent_text
from pricing_engine.operators.groups import best_offers, priced_members
from pricing_engine.operators.history import PRODUCT_KEY, latest_prices

AT_LOW, TOP_CHEAPEST, TOP_DISCOUNTED = (
    "cheapest_products",
    "top_five_cheapest",
    "top_five_most_discounted",
)
TOP_K = 5
_GROUP = ["group_id", "group_name", "category", "current_price", "best_vendor", "discount", "status"]


def _cheapest_first() -> list[Column]:
    return [F.col(c) for c in ("current_price", "group_name", "best_vendor", "group_id")]


def _discounted_first() -> list[Column]:
    return [F.desc("discount"), *_cheapest_first()]


def _judged(groups: DataFrame, precedence: str) -> DataFrame:
    usable = groups.dropna(subset=["category", "current_price", "max_price", "min_price"])
    return (
        usable.where(F.col("max_price") > 0)
        .withColumn("discount", S.discount(F.col("current_price"), F.col("max_price")))
        .withColumn(
            "status",
            S.price_status(F.col("current_price"), F.col("min_price"), F.col("max_price"), precedence),
        )
        .select(_GROUP)
    )


def analyse_groups(
    history: DataFrame,
    grouped_metrics: DataFrame,
    membership: DataFrame,
    precedence: str = "cheapest_first",
) -> DataFrame:
    """Best current offer, discount and status per group, from the stored tables."""
    offers = best_offers(priced_members(membership, latest_prices(history)))
    return _judged(grouped_metrics.join(offers, "group_id"), precedence)


def analyse_snapshot(
    snapshot: DataFrame, membership: DataFrame, precedence: str = "cheapest_first"
) -> DataFrame:
    """The same from a product snapshot, with bounds and best offer in one aggregate.

    Equals ``analyse_groups`` on fresh metrics as long as each group has one name
    and one category.
    """
    members = membership.select("group_id", "group_name", "category", *PRODUCT_KEY)
    return analyse_members(members.join(snapshot.drop("category"), PRODUCT_KEY), precedence)


def analyse_members(members: DataFrame, precedence: str = "cheapest_first") -> DataFrame:
    """The same from members with their bounds and, where known, their current price."""
    order = F.struct("current_price", -F.unix_date("last_seen_date"), "vendor", "product_id")
    priced = F.when(F.col("current_price").isNotNull(), order)
    groups = members.groupBy("group_id", "group_name", "category").agg(
        F.max("max_price").alias("max_price"),
        F.min("min_price").alias("min_price"),
        F.min_by(F.struct("vendor", "current_price"), priced).alias("best"),
    )
    groups = groups.select(
        "group_id",
        "group_name",
        "category",
        "max_price",
        "min_price",
        F.col("best.vendor").alias("best_vendor"),
        F.col("best.current_price").alias("current_price"),
    )
    return _judged(groups, precedence)


def top_per_category(groups: DataFrame, order: list[Column], k: int = TOP_K) -> DataFrame:
    """The first ``k`` groups of each category; every task keeps ``k`` before the shuffle."""
    window = Window.partitionBy("category").orderBy(*order)
    return groups.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def top_cheapest(groups: DataFrame, k: int = TOP_K) -> DataFrame:
    return top_per_category(groups, _cheapest_first(), k)


def top_discounted(groups: DataFrame, k: int = TOP_K) -> DataFrame:
    return top_per_category(groups, _discounted_first(), k)


def at_low(groups: DataFrame) -> DataFrame:
    """All groups at their all-time low, by category in cheapest-first order."""
    return groups.where(F.col("status") == S.CHEAPEST).orderBy("category", *_cheapest_first())


def category_lists(groups: DataFrame) -> DataFrame:
    """The three lists of every category in tall form.

    ``rank`` numbers the two short lists.  The list of groups at their low has no
    bound, so it carries no rank: a category with a third of all groups would need
    one task to count through it.  Its order is price, name, vendor, group.
    """
    columns = ["category", "list_name", "rank", *[c for c in _GROUP if c != "category"]]

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("list_name", F.lit(name)).select(columns)

    low = groups.where(F.col("status") == S.CHEAPEST).withColumn("rank", F.lit(None).cast("int"))
    return (
        listed(low, AT_LOW)
        .unionByName(listed(top_cheapest(groups), TOP_CHEAPEST))
        .unionByName(listed(top_discounted(groups), TOP_DISCOUNTED))
    )


def category_summary(groups: DataFrame) -> DataFrame:
    """One row per category: its short lists as ordered arrays, its low list as a count."""
    entry = F.struct("rank", *[c for c in _GROUP if c != "category"])

    def nested(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("category").agg(F.array_sort(F.collect_list(entry)).alias(name))

    lows = groups.groupBy("category").agg(
        F.sum(F.when(F.col("status") == S.CHEAPEST, 1).otherwise(0)).alias("n_at_low")
    )
    return lows.join(nested(top_cheapest(groups), TOP_CHEAPEST), "category").join(
        nested(top_discounted(groups), TOP_DISCOUNTED), "category"
    )


def report_rows(lists: DataFrame) -> DataFrame:
    """The lists as display texts, one row per line of the text report."""
    return lists.select(
        F.upper("category").alias("category"),
        "list_name",
        "rank",
        F.col("group_name").alias("product"),
        "best_vendor",
        money_text(F.col("current_price")).alias("price"),
        percent_text(F.col("discount")).alias("percent_off"),
        "status",
    )
