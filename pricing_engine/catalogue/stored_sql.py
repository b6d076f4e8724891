"""DuckDB equivalents of the queries over the stored tables."""

from __future__ import annotations

from pricing_engine.catalogue.stored import (
    CATEGORY_TEXT,
    ONE_CATEGORY,
    ONE_PRODUCT,
    ONE_VENDOR,
    SEARCH_STATUS,
    SEARCH_TEXT,
    SEARCH_VENDOR,
    SPLIT_DATE,
)

NAME = """
CASE WHEN p_partkey % 16 = 0 THEN p_brand || ' ' || p_name || ' ' || p_size || ' pack'
     WHEN p_partkey % 4 = 1 THEN p_brand || ' ' || p_name || ' (' || (p_partkey % 400 + 1000) || ') ' || p_size || ' pack'
     WHEN p_partkey % 4 = 2 THEN p_brand || ' ' || p_name || ' & case - ' || (p_partkey % 400 + 1000) || ' ' || p_size || ' pk'
     WHEN p_partkey % 4 = 3 THEN p_brand || ', ' || p_name || ' / ' || p_size || 'ml ' || (p_partkey % 400 + 1000)
     ELSE p_brand || ' ' || p_name || ' ' || p_size || ' ply ' || (p_partkey % 400 + 1000) END
"""

LINES = f"""
vendors AS (SELECT s_suppkey, r_name AS vendor FROM supplier
            JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lines AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS product_id, vendor,
         {NAME} AS product_name, p_type AS category, l_extendedprice AS price,
         CASE WHEN l_partkey % 3 = 0 THEN 'specific' ELSE 'search' END AS source,
         (CAST(l_orderkey * 8 + l_linenumber AS HUGEINT) * 1000000000000 + l_suppkey) * 100000
           + datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS arrival,
         l_partkey, l_linenumber, l_shipdate
  FROM lineitem JOIN vendors ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""

HISTORY = f"""{LINES},
history AS (SELECT date, product_id, vendor, category, price FROM lines
  QUALIFY row_number() OVER (PARTITION BY date, product_id, vendor, category ORDER BY arrival DESC) = 1)"""

LISTINGS = """
listings AS (SELECT l_partkey AS group_id, product_id, vendor, product_name, category,
                    any_value(source) AS source, max(date) AS last_seen
             FROM lines GROUP BY ALL)"""

SNAPSHOT = f"""{HISTORY}, {LISTINGS},
bounds AS (SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated
           FROM history GROUP BY ALL),
latest AS (SELECT product_id, vendor, price AS current_price, date AS last_seen_date, category FROM history
           QUALIFY row_number() OVER (PARTITION BY product_id, vendor ORDER BY date DESC, category DESC) = 1),
grouped AS (SELECT group_id, product_name AS group_name, category, max(max_price) AS max_price,
                   min(min_price) AS min_price, max(last_updated) AS last_updated
            FROM listings LEFT JOIN bounds USING (product_id, vendor) GROUP BY ALL),
priced AS (SELECT group_id, product_id, vendor, current_price, last_seen_date
           FROM listings JOIN latest USING (product_id, vendor)),
offers AS (SELECT group_id, vendor AS best_vendor, current_price FROM priced
           QUALIFY row_number() OVER (PARTITION BY group_id
             ORDER BY current_price, last_seen_date DESC, vendor, product_id) = 1),
analysis AS (
  SELECT group_id, group_name, category, current_price, best_vendor,
         round_even(greatest((max_price - current_price) / max_price * 100, 0) * 10, 0) / 10 AS discount,
         CASE WHEN current_price = min_price THEN 'cheapest' WHEN current_price = max_price THEN 'full price'
              ELSE 'discounted' END AS status
  FROM grouped JOIN offers USING (group_id) WHERE max_price > 0)"""

DASHBOARD = f"""{SNAPSHOT},
members AS (SELECT group_id, product_id, vendor, product_name, current_price, last_seen_date,
                   max_price, min_price, last_updated
            FROM listings LEFT JOIN latest USING (product_id, vendor) LEFT JOIN bounds USING (product_id, vendor)),
simple_offers AS (SELECT group_id, vendor AS best_vendor, current_price FROM members
                  WHERE current_price IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY current_price, vendor, product_id) = 1),
sizes AS (SELECT group_id, count(*) AS n_members FROM members GROUP BY ALL),
groups AS (
  SELECT group_id, group_name, category, current_price, best_vendor, max_price AS group_max_price,
         min_price AS group_min_price, last_updated, n_members, n_members > 1 AS is_multi,
         CASE WHEN max_price > 0 THEN
           CAST(printf('%.1f', greatest((max_price - current_price) / max_price * 100, 0)) AS DOUBLE)
           ELSE 0.0 END AS discount,
         CASE WHEN max_price <> 0 AND current_price = max_price THEN 'full price'
              WHEN min_price <> 0 AND current_price = min_price THEN 'cheapest' ELSE 'discounted' END AS status
  FROM grouped JOIN simple_offers USING (group_id) JOIN sizes USING (group_id))"""

LISTS = f"""{SNAPSHOT},
top_cheap AS (SELECT *, row_number() OVER (PARTITION BY category
    ORDER BY current_price, group_name, best_vendor, group_id) AS rank FROM analysis),
top_off AS (SELECT *, row_number() OVER (PARTITION BY category
    ORDER BY discount DESC, current_price, group_name, best_vendor, group_id) AS rank FROM analysis),
lists AS (
  SELECT category, 'cheapest_products' AS list_name, CAST(NULL AS INTEGER) AS rank, group_id, group_name,
         current_price, best_vendor, discount, status FROM analysis WHERE status = 'cheapest'
  UNION ALL SELECT category, 'top_five_cheapest', CAST(rank AS INTEGER), group_id, group_name, current_price,
         best_vendor, discount, status FROM top_cheap WHERE rank <= 5
  UNION ALL SELECT category, 'top_five_most_discounted', CAST(rank AS INTEGER), group_id, group_name, current_price,
         best_vendor, discount, status FROM top_off WHERE rank <= 5)"""

TWO_BATCHES = f"""{LINES},
rows AS (SELECT 0 AS batch, * FROM lines WHERE l_linenumber <= 4
         UNION ALL SELECT 1, * FROM lines WHERE l_linenumber >= 3)"""

SPLIT = f"""{HISTORY},
old AS (SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated
        FROM lines WHERE l_shipdate < '{SPLIT_DATE}' GROUP BY ALL),
new AS (SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated
        FROM lines WHERE l_shipdate >= '{SPLIT_DATE}' GROUP BY ALL)"""

_RANKED = "category, CAST(rank AS INTEGER) AS rank, group_id, group_name, current_price, best_vendor, discount"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _status(order: str) -> str:
    return _with(
        SNAPSHOT,
        f"SELECT product_id, vendor, current_price, CASE {order} ELSE 'discounted' END AS status"
        " FROM latest JOIN bounds USING (product_id, vendor)",
    )


_SEARCH_GROUP = """lower(concat_ws(' ', group_name, '-' || printf('%.1f%%', discount), replace(best_vendor, '_', ' '),
  '$' || printf('%.2f', current_price), CAST(last_updated AS VARCHAR)))"""
_SEARCH_MEMBER = """lower(concat_ws(' ', replace(vendor, '_', ' '), product_name,
  coalesce('$' || printf('%.2f', current_price), '—'), CAST(last_seen_date AS VARCHAR)))"""

ORACLES: dict[str, str] = {
    "src_1_price_history": _with(
        LINES, "SELECT date, product_id, vendor, category, price FROM lines WHERE l_partkey % 50 <> 0"
    ),
    "src_2_products": _with(
        f"{LINES}, {LISTINGS}", "SELECT product_id, vendor, product_name, category, source, last_seen FROM listings"
    ),
    "win_4_dedupe_history": _with(
        TWO_BATCHES,
        """SELECT date, product_id, vendor, category, price FROM rows QUALIFY row_number() OVER (
           PARTITION BY date, product_id, vendor, category ORDER BY batch DESC, arrival DESC) = 1""",
    ),
    "win_5_upsert_registry": _with(
        TWO_BATCHES,
        """SELECT product_id, vendor, product_name, category, source, date AS last_seen FROM rows
           QUALIFY row_number() OVER (PARTITION BY product_id, vendor ORDER BY batch DESC, arrival DESC) = 1""",
    ),
    "win_1_latest_price": _with(SNAPSHOT, "SELECT product_id, vendor, current_price, last_seen_date, category FROM latest"),
    "flt_4_latest_batch": _with(HISTORY, "SELECT * FROM history WHERE date = (SELECT max(date) FROM history)"),
    "flt_7_product_history": _with(
        HISTORY,
        f"SELECT date, price FROM history WHERE product_id = '{ONE_PRODUCT}' AND vendor = '{ONE_VENDOR}' ORDER BY date",
    ),
    "agg_1_batch_metrics": _with(
        LINES,
        "SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated"
        " FROM lines GROUP BY ALL",
    ),
    "agg_3_incremental_metrics": _with(
        LINES,
        "SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated"
        " FROM lines GROUP BY ALL",
    ),
    "joi_1_compare_metrics": _with(
        SPLIT,
        """SELECT product_id, vendor, old.max_price AS stored_max_price, old.min_price AS stored_min_price,
           new.max_price AS latest_max_price, new.min_price AS latest_min_price,
           greatest(old.max_price, new.max_price) AS max_price, least(old.min_price, new.min_price) AS min_price,
           greatest(old.last_updated, new.last_updated) AS last_updated
           FROM old FULL JOIN new USING (product_id, vendor)""",
    ),
    "agg_4_latest_batch_metrics": _with(
        SPLIT,
        """SELECT product_id, vendor, max(hi) AS max_price, min(lo) AS min_price, max(day) AS last_updated FROM (
           SELECT product_id, vendor, max_price AS hi, min_price AS lo, last_updated AS day FROM old UNION ALL
           SELECT product_id, vendor, price, price, date FROM history
           WHERE date = (SELECT max(date) FROM history)) GROUP BY ALL""",
    ),
    "agg_5_group_metrics": _with(SNAPSHOT, "SELECT * FROM grouped"),
    "agg_7_quality_report": _with(
        HISTORY,
        """SELECT (SELECT count(*) FROM lines) AS n_rows, CAST(0 AS BIGINT) AS n_invalid, count(*) AS n_after_dedupe,
           count(DISTINCT product_id) AS n_products, string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS vendors
           FROM history""",
    ),
    "agg_8_next_group_id": _with(
        f"{LINES}, {LISTINGS}", "SELECT coalesce(max(group_id), 0) + 1 AS next_group_id FROM listings"
    ),
    "agg_10_category_counts": _with(DASHBOARD, "SELECT category, count(*) AS n_groups FROM groups GROUP BY ALL"),
    "joi_3_priced_members": _with(SNAPSHOT, "SELECT * FROM priced"),
    "win_2_best_offer": _with(SNAPSHOT, "SELECT * FROM offers"),
    "win_3_best_offer_simple": _with(DASHBOARD, "SELECT * FROM simple_offers"),
    "sca_13_discount": _with(SNAPSHOT, "SELECT group_id, current_price, discount FROM analysis"),
    "sca_14_status": _status("WHEN current_price = min_price THEN 'cheapest' WHEN current_price = max_price THEN 'full price'"),
    "sca_15_status_full_first": _status(
        "WHEN current_price = max_price THEN 'full price' WHEN current_price = min_price THEN 'cheapest'"
    ),
    "top_1_cheapest": _with(LISTS, f"SELECT {_RANKED} FROM top_cheap WHERE rank <= 5"),
    "top_2_discounted": _with(LISTS, f"SELECT {_RANKED} FROM top_off WHERE rank <= 5"),
    "top_3_at_low": _with(
        SNAPSHOT,
        "SELECT group_id, group_name, category, current_price, best_vendor, discount FROM analysis"
        " WHERE status = 'cheapest'",
    ),
    "top_4_cheapest": _with(
        DASHBOARD,
        f"""SELECT {_RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY category
            ORDER BY current_price, group_name, group_id) AS rank FROM groups) WHERE rank <= 5""",
    ),
    "top_5_discounted": _with(
        DASHBOARD,
        f"""SELECT {_RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY category
            ORDER BY discount DESC, current_price, group_name, group_id) AS rank FROM groups) WHERE rank <= 5""",
    ),
    "top_6_alphabetical": _with(
        DASHBOARD, "SELECT category, group_id, group_name FROM groups ORDER BY category, lower(group_name), group_id"
    ),
    "top_7_members": _with(
        DASHBOARD,
        """SELECT group_id, product_id, vendor, price AS current_price FROM (
             SELECT *, CASE WHEN group_id % 7 = 0 THEN 0.0 WHEN group_id % 7 <> 1 THEN current_price END AS price
             FROM members) ORDER BY group_id, coalesce(nullif(price, 0), 999), vendor, product_id""",
    ),
    "out_1_analysis": _with(LISTS, "SELECT * FROM lists"),
    "out_1_analysis_from_tables": _with(LISTS, "SELECT * FROM lists"),
    "out_1_category_summary": _with(
        LISTS,
        """SELECT category, count(*) FILTER (list_name = 'cheapest_products') AS n_at_low,
           string_agg(group_id, ',' ORDER BY rank) FILTER (list_name = 'top_five_cheapest') AS top_five_cheapest,
           string_agg(group_id, ',' ORDER BY rank) FILTER (list_name = 'top_five_most_discounted')
             AS top_five_most_discounted
           FROM lists GROUP BY category""",
    ),
    "out_2_groups": _with(DASHBOARD, "SELECT * FROM groups"),
    "out_2_groups_from_tables": _with(DASHBOARD, "SELECT * FROM groups"),
    "out_2_members": _with(DASHBOARD, "SELECT * FROM members"),
    "out_2_nested_groups": _with(
        DASHBOARD,
        """SELECT *, CAST(0 AS INTEGER) AS chunk FROM groups JOIN (
             SELECT group_id, CAST(to_json(list(struct_pack(product_id, vendor, product_name, current_price,
                      last_seen_date, max_price, min_price, last_updated)
                    ORDER BY coalesce(nullif(current_price, 0), 999), vendor, product_id)) AS VARCHAR) AS members
             FROM members GROUP BY group_id) USING (group_id)""",
    ),
    "out_3_category": _with(DASHBOARD, f"SELECT * FROM groups WHERE category = '{ONE_CATEGORY}'"),
    "out_4_history_texts": _with(
        HISTORY,
        f"""SELECT strftime(date, '%Y-%m-%d') AS date, price FROM history
            WHERE product_id = '{ONE_PRODUCT}' AND vendor = '{ONE_VENDOR}'""",
    ),
    "out_5_report_rows": _with(
        LISTS,
        """SELECT upper(category) AS category, list_name, rank, group_name AS product, best_vendor,
           '$' || printf('%.2f', current_price) AS price, printf('%.1f%%', discount) AS percent_off, status FROM lists""",
    ),
    "flt_8_search": _with(
        DASHBOARD,
        f"""SELECT group_id, group_name, category, best_vendor, status FROM groups
            WHERE status = '{SEARCH_STATUS}'
              AND group_id IN (SELECT group_id FROM members WHERE vendor = '{SEARCH_VENDOR}')
              AND (contains({_SEARCH_GROUP}, '{SEARCH_TEXT}') OR is_multi AND group_id IN (
                SELECT group_id FROM members WHERE contains({_SEARCH_MEMBER}, '{SEARCH_TEXT}')))""",
    ),
    "flt_9_category_search": _with(
        DASHBOARD,
        f"""SELECT category, count(*) AS n_groups FROM groups
            WHERE contains(lower(replace(category, '_', ' ')), lower('{CATEGORY_TEXT}')) GROUP BY ALL""",
    ),
    "sca_17_category_titles": _with(
        DASHBOARD,
        "SELECT category, count(*) AS n_groups, upper(replace(category, '_', ' ')) AS title FROM groups GROUP BY ALL",
    ),
    "joi_9_unmatched_products": _with(
        f"{LINES}, {LISTINGS}",
        f"""SELECT product_id, vendor, product_name, category, source, last_seen FROM listings
            WHERE group_id % 5 = 0 AND vendor = '{ONE_VENDOR}'""",
    ),
    "joi_5_products_with_max": _with(
        f"{HISTORY}, {LISTINGS}",
        """SELECT product_id, vendor, product_name, max_price FROM listings LEFT JOIN (
             SELECT product_id, vendor, max(price) AS max_price FROM history
             WHERE CAST(product_id AS BIGINT) % 7 <> 0 GROUP BY ALL) USING (product_id, vendor)""",
    ),
}
