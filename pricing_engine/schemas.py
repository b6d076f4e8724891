"""Table schemas and the required-column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _DATE, _L = T.StringType(), T.DoubleType(), T.DateType(), T.LongType()
_SA = T.ArrayType(_S)

PRICE_HISTORY = _struct(date=_DATE, product_id=_S, vendor=_S, category=_S, price=_D)
PRODUCTS = _struct(
    product_id=_S, vendor=_S, product_name=_S, category=_S, source=_S, last_seen=_DATE
)
PRODUCT_METRICS = _struct(
    product_id=_S, vendor=_S, max_price=_D, min_price=_D, last_updated=_DATE
)
PRODUCT_MATCH = _struct(
    group_id=_L, group_name=_S, category=_S, product_id=_S, vendor=_S, product_name=_S
)
GROUP_METRICS = _struct(
    group_id=_L, group_name=_S, category=_S, max_price=_D, min_price=_D, last_updated=_DATE
)
# views that the engine keeps beside its tables
LATEST_PRICES = _struct(product_id=_S, vendor=_S, current_price=_D, last_seen_date=_DATE, category=_S)
GROUP_MEMBERS = _struct(
    group_id=_L, group_name=_S, category=_S, product_id=_S, vendor=_S, product_name=_S,
    current_price=_D, last_seen_date=_DATE, max_price=_D, min_price=_D, last_updated=_DATE,
)
GROUP_OFFERS = _struct(
    group_id=_L, group_name=_S, category=_S, current_price=_D, best_vendor=_S, discount=_D, status=_S
)
CATEGORY_LISTS = _struct(
    category=_S, list_name=_S, rank=T.IntegerType(), group_id=_L, group_name=_S, current_price=_D,
    best_vendor=_S, discount=_D, status=_S,
)
DASHBOARD_GROUPS = _struct(
    group_id=_L, group_name=_S, category=_S, current_price=_D, best_vendor=_S, group_max_price=_D, group_min_price=_D,
    last_updated=_DATE, n_members=_L, is_multi=T.BooleanType(), discount=_D, status=_S,
)
NAME_INDEX = _struct(category=_S, brand=_S, name=_S, group_id=_L, product_id=_S, vendor=_S)
RUN_LOG = _struct(run=_S, step=_S, counter=_S, value=_L)
CATEGORY_CONFIG = _struct(
    position=T.IntegerType(),
    category=_S,
    search_terms=_SA,
    vendors=_SA,
    specific_products=T.MapType(_S, _SA),
    must_include=_SA,
    or_include=_SA,
    must_exclude=_SA,
)
PAYLOADS = _struct(
    vendor=_S,
    category=_S,
    source=_S,
    search_term=_S,
    seq=_L,
    status_code=T.IntegerType(),
    request_url=_S,
    final_url=_S,
    requested_product_id=_S,
    body=_S,
)
DECISIONS = _struct(product_id=_S, vendor=_S, group_id=_L, accept=T.BooleanType())
# on groups that products of the same run open
NEW_DECISIONS = _struct(
    product_id=_S, vendor=_S, leader_product_id=_S, leader_vendor=_S, accept=T.BooleanType()
)

TABLES = {
    "price_history": PRICE_HISTORY,
    "products": PRODUCTS,
    "product_metrics": PRODUCT_METRICS,
    "product_match": PRODUCT_MATCH,
    "grouped_product_metrics": GROUP_METRICS,
    "latest_prices": LATEST_PRICES,
    "group_members": GROUP_MEMBERS,
    "group_offers": GROUP_OFFERS,
    "category_lists": CATEGORY_LISTS,
    "run_log": RUN_LOG,
    "name_index": NAME_INDEX,
    "price_series": PRICE_HISTORY,
    "dashboard_groups": DASHBOARD_GROUPS,
}

# what the partitions of a stored table follow: the date itself, or a hash into buckets
PARTITIONED_BY = {
    "price_history": ["date"],
    "products": ["product_id", "vendor"],
    "product_metrics": ["product_id", "vendor"],
    "product_match": ["product_id", "vendor"],
    "latest_prices": ["product_id", "vendor"],
    "group_members": ["group_id"],
    "group_offers": ["category"],
    "category_lists": ["category"],
    "price_series": ["product_id", "vendor"],
    "dashboard_groups": ["category"],
    "name_index": ["category", "brand"],
}

# the order in which each stored table, or each partition of it, is written
SORT_ORDER = {
    "price_history": ["date", "vendor", "category", "product_id"],
    "products": ["vendor", "category", "product_name"],
    "product_metrics": ["vendor", "product_id"],
    "product_match": ["category", "group_id", "vendor", "product_id"],
    "grouped_product_metrics": ["group_id"],
    "latest_prices": ["vendor", "product_id"],
    "group_members": ["group_id", "vendor", "product_id"],
    "group_offers": ["category", "current_price", "group_name", "best_vendor", "group_id"],
    "category_lists": ["category", "list_name", "rank", "current_price", "group_name", "best_vendor", "group_id"],
    "run_log": ["run", "step", "counter"],
    "price_series": ["vendor", "product_id", "date", "category"],
    "dashboard_groups": ["category", "group_name", "group_id"],
    "name_index": ["category", "brand", "name", "group_id", "vendor", "product_id"],
}


class MissingColumnsError(ValueError):
    """A table lacks columns that the job needs."""


def require_columns(df: DataFrame, required: Iterable[str], table: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"{table} lacks required columns: {missing}")
    return df


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
