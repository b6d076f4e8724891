"""DuckDB equivalents of the queries that go through files."""

from __future__ import annotations

from pricing_engine.catalogue.names_sql import AS_OF, JSON_ROWS, _recursive, _with
from pricing_engine.catalogue.stored_sql import ORACLES as STORED
from pricing_engine.catalogue.stored_sql import HISTORY, LINES, LISTINGS, LISTS, SNAPSHOT

# the vendors of a category that have a reader, and the terms of its names
_FETCHED = "((category = 'ECONOMY' AND vendor IN ('ASIA', 'EUROPE')) OR (category = 'SMALL' AND vendor = 'ASIA'))"
_KEPT = """CASE category
  WHEN 'ECONOMY' THEN contains(lower(product_name), 'brand')
    AND (contains(lower(product_name), 'ring') OR contains(lower(product_name), 'rod'))
    AND NOT contains(lower(product_name), 'hot') AND NOT contains(lower(product_name), 'old')
  ELSE NOT contains(lower(product_name), 'ml') END"""

# bounds of all observations, those included that a later one of their date has replaced
_SEEN = """seen AS (SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated
         FROM lines GROUP BY ALL)"""

# records of a run before the term filter, with fetches that earlier ones have made redundant left out
_MERGED = f""", found AS (SELECT DISTINCT category, vendor, product_id AS raw FROM good WHERE source = 'search' AND {_FETCHED}),
        direct AS (SELECT d.*, row_number() OVER (PARTITION BY category, vendor ORDER BY d.seq) AS place
                   FROM good d ANTI JOIN found USING (category, vendor, raw) WHERE d.source = 'specific' AND {_FETCHED}),
        walk AS (SELECT DISTINCT category, vendor, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS given FROM direct
                 UNION ALL
                 SELECT d.category, d.vendor, d.place, CASE WHEN list_contains(w.given, d.raw) THEN w.given
                          ELSE list_append(w.given, d.product_id) END
                 FROM walk w JOIN direct d ON d.category = w.category AND d.vendor = w.vendor AND d.place = w.place + 1),
        used AS (SELECT d.* EXCLUDE (place) FROM direct d JOIN walk w ON d.category = w.category
                   AND d.vendor = w.vendor AND d.place = w.place + 1 WHERE d.raw IS NULL OR NOT list_contains(w.given, d.raw)),
        merged AS (SELECT * FROM (SELECT 0 AS step, * FROM good WHERE source = 'search' AND {_FETCHED}
                                  UNION ALL BY NAME SELECT 1 AS step, * FROM used)
                   QUALIFY row_number() OVER (PARTITION BY category, vendor, product_id ORDER BY step DESC, seq DESC) = 1)"""

ORACLES: dict[str, str] = {
    "src_1_history_csv": _with(
        HISTORY, "SELECT date, product_id, vendor, category, price FROM history WHERE CAST(product_id AS BIGINT) % 50 <> 0"
    ),
    "src_2_products_scan": _with(
        f"{LINES}, {LISTINGS}", "SELECT product_id, vendor, product_name, category, source, last_seen FROM listings"
    ),
    "src_3_metrics_csv": _with(SNAPSHOT, "SELECT product_id, vendor, max_price, min_price, last_updated FROM bounds"),
    "src_6_absent_metrics": _with(SNAPSHOT, "SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated FROM lines GROUP BY ALL"),
    "src_4_membership_version": _with(
        f"{LINES}, {LISTINGS}",
        "SELECT group_id, product_name AS group_name, category, product_id, vendor, product_name FROM listings",
    ),
    "src_5_group_bounds_json": _with(SNAPSHOT, "SELECT * FROM grouped"),
    "snk_2_history_merges": STORED["win_4_dedupe_history"],
    "snk_3_registry_versions": STORED["win_5_upsert_registry"],
    "snk_4_bucketed_metrics": _with(
        SNAPSHOT,
        "SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated FROM lines GROUP BY ALL",
    ),
    "snk_2_interleaved_writers": _with(HISTORY, "SELECT date, product_id, vendor, category, price FROM history"),
    "snk_5_group_bounds_versions": _with(
        f"{LINES}, {LISTINGS}, allbounds AS (SELECT product_id, vendor, max(price) AS hi, min(price) AS lo, max(date) AS seen FROM lines GROUP BY ALL)",
        """SELECT l.group_id, l.product_name AS group_name, l.category, max(hi) AS max_price, min(lo) AS min_price, max(seen) AS last_updated
           FROM listings l LEFT JOIN allbounds b ON l.product_id = b.product_id AND l.vendor = b.vendor GROUP BY ALL""",
    ),
    "out_1_incremental_lists": _with(LISTS.replace("listings LEFT JOIN bounds", "listings LEFT JOIN seen").replace("bounds AS", f"{_SEEN},\nbounds AS"), "SELECT * FROM lists"),
    "win_1_incremental_members": _with(
        f"{SNAPSHOT}, {_SEEN}",
        """SELECT group_id, product_name AS group_name, category, product_id, vendor, product_name, current_price, last_seen_date,
                  max_price, min_price, last_updated
           FROM listings JOIN (SELECT * EXCLUDE (category) FROM latest) USING (product_id, vendor) JOIN seen USING (product_id, vendor)""",
    ),
    "str_1_stream_history": _with(HISTORY, "SELECT date, product_id, vendor, category, price FROM history"),
    "str_1_stream_registry": _with(
        LINES,
        """SELECT product_id, vendor, product_name, category, source, date AS last_seen FROM lines
           QUALIFY row_number() OVER (PARTITION BY product_id, vendor ORDER BY arrival DESC) = 1""",
    ),
    "pip_1_daily_history": _recursive(
        JSON_ROWS,
        f"""{_MERGED}
        SELECT date, product_id, vendor, category, price FROM merged WHERE {_KEPT}""",
    ),
    "out_3_served_category": STORED["out_3_category"],
    "flt_7_served_history": STORED["flt_7_product_history"],
    "pip_2_metrics_only": _with(
        HISTORY,
        """SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated
           FROM history WHERE date = (SELECT max(date) FROM history) GROUP BY ALL""",
    ),
    "pip_1_daily_metrics": _recursive(
        JSON_ROWS,
        f"""{_MERGED}
        SELECT product_id, vendor, max(price) AS max_price, min(price) AS min_price, max(date) AS last_updated
        FROM merged WHERE {_KEPT} GROUP BY ALL""",
    ),
    "pip_1_run_counters": _recursive(
        JSON_ROWS,
        f"""{_MERGED}
        SELECT '{AS_OF}' AS run, step, counter, value FROM (
          SELECT 'parse' AS step, 'rows' AS counter, count(*) AS value FROM judged WHERE {_FETCHED}
          UNION ALL SELECT 'parse', 'rejected', count(reason) FROM judged WHERE {_FETCHED}
          UNION ALL SELECT 'merge', 'rows', count(*) FROM merged
          UNION ALL SELECT 'filter', 'rows', count(*) FROM merged WHERE {_KEPT})""",
    ),
    "pip_1_daily_rejects": _with(
        JSON_ROWS,
        f"SELECT vendor, reason, count(*) AS n_rows FROM judged WHERE reason IS NOT NULL AND {_FETCHED} GROUP BY ALL",
    ),
}
