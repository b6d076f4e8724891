"""DuckDB equivalents of the queries over names, payloads and the stream.

The ratio scores have no SQL form; their queries are tested against brute force.
"""

from __future__ import annotations

from pricing_engine.catalogue.names import AS_OF, SHOP_URL
from pricing_engine.catalogue.stored import ONE_VENDOR
from pricing_engine.catalogue.stored_sql import LINES, LISTINGS, NAME, SNAPSHOT


# The unit words and attribute patterns of the names
_UNITS = "('g','kg','ml','l','m','ply','pack','pk','pcs','pieces')"
_PLY = "nullif(regexp_extract(name, '\\b(\\d+)\\s*ply\\b', 1), '')"
_PACK = "nullif(regexp_extract(name, '\\b(\\d+)\\s*(pack|pk|pcs|pieces)\\b', 1), '')"
_SIZE = "\\b(\\d+(?:\\.\\d+)?)\\s*(g|kg|ml|l|m)\\b"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def _normalised(name: str) -> str:
    spelled = f"replace(lower({name}), '&', ' and ')"
    return f"trim(regexp_replace(translate({spelled}, '-/,()', '     '), '\\s+', ' ', 'g'))"


def _title(text: str) -> str:
    """Letters after a non-letter in capitals; texts here are ASCII."""
    runs = f"regexp_extract_all({text}, '([A-Za-z]+|[^A-Za-z]+)')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


def _numbers(name: str) -> str:
    parts = f"string_split({name}, ' ')"
    bare = (
        f"list_filter({parts}, lambda t, i: regexp_full_match(t, '\\d+')"
        f" AND coalesce({parts}[i + 1], '') NOT IN {_UNITS})"
    )
    return f"array_to_string(list_sort(list_distinct({bare})), '@')"


NAMES = f"""
names AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, {NAME} AS product_name, p_type AS category,
                 {_normalised(NAME)} AS name FROM part)"""

FEATURES = f"""{NAMES},
features AS (SELECT DISTINCT category, name, split_part(name, ' ', 1) AS brand,
  replace({_numbers("name")}, '@', ' ') AS numbers, {_PLY} AS ply, {_PACK} AS pack,
  nullif(regexp_extract(name, '{_SIZE}', 1), '') || nullif(regexp_extract(name, '{_SIZE}', 2), '') AS size,
  length(name) AS n FROM names)"""

# floor on the name score: (70 - 25) / 0.75, with slack for rounding
_GATED = f"""{FEATURES},
pairs AS (
  SELECT l.category, l.name AS l_name, r.name AS r_name,
    CASE WHEN l.ply <> r.ply THEN 25 ELSE 0 END + CASE WHEN l.pack <> r.pack THEN 20 ELSE 0 END
      + CASE WHEN l.size <> r.size THEN 20 ELSE 0 END AS penalty,
    concat_ws('; ',
      CASE WHEN l.ply <> r.ply THEN 'Different ply: ' || l.ply || ' vs ' || r.ply END,
      CASE WHEN l.pack <> r.pack THEN 'Different pack count: ' || l.pack || ' vs ' || r.pack END,
      CASE WHEN l.size <> r.size THEN 'Different size: ' || l.size || ' vs ' || r.size END) AS penalty_reasons,
    65 + 0.35 * 200.0 * least(l.n, r.n) / (l.n + r.n) AS best
  FROM features l JOIN features r ON l.category = r.category AND l.brand = r.brand AND l.name < r.name
    AND (l.numbers = r.numbers OR l.numbers = '' OR r.numbers = ''))"""

JSON_ROWS = f"""{LINES},
payloads AS (
  SELECT vendor, p_type AS category, CAST('{AS_OF}' AS DATE) AS date,
    CASE WHEN l_orderkey % 17 = 0 THEN 'gift' WHEN l_linenumber <= 4 THEN 'search' ELSE 'specific' END AS source,
    'term' || (l_linenumber % 2) AS search_term,
    (CAST(l_orderkey * 8 + l_linenumber AS HUGEINT) * 1000000000000 + l_suppkey) * 100000
           + datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS seq,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE '/buy/' || l_partkey END AS raw,
    CASE WHEN l_orderkey % 11 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS id,
    CASE WHEN l_orderkey % 22 <> 0 THEN 'slug-' || l_partkey END AS slug,
    p_brand AS brand, p_name AS name, p_size || ' pack' AS size, l_partkey,
    CASE WHEN l_orderkey % 13 <> 0 THEN l_extendedprice END AS price, l_orderkey % 19 = 0 AS null_discount
  FROM lineitem JOIN vendors ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
records AS (
  SELECT date, coalesce(id, slug) AS product_id, vendor, brand || ' ' || name AS product_name, category,
         CASE WHEN NOT null_discount THEN price END AS price, source, search_term, seq, raw FROM payloads),
judged AS (
  SELECT *, CASE WHEN product_id IS NULL THEN 'missing id' WHEN price IS NULL THEN 'missing price'
                 WHEN source = 'gift' THEN 'unknown source' END AS reason FROM records),
good AS (SELECT * EXCLUDE (reason) FROM judged WHERE reason IS NULL)"""

_RECORD = "date, product_id, vendor, product_name, category, price, source"
_SEQ = "CAST(seq AS VARCHAR) AS seq"

_URL_PATH = "coalesce(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ''), url)"


def _path_of(url: str) -> str:
    return _URL_PATH.replace("url", f"({url})")


def _id_of(text: str, *patterns: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({text}, '{p}', 1), '')" for p in ("^(\\d+)$", *patterns))
    return f"coalesce({found})"


_BUY_URL = "regexp_replace(url, '/(en|fr|de|es)/', '/buy/', 'g')"
_PRODUCT_URL = "regexp_replace(url, '/(en|fr|de|es)/', '/product/', 'g')"


def _unescaped(text: str) -> str:
    """The references that occur in the pages."""
    for reference, char in (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{reference}', '{char}', 'g')"
    return text


def _silenced(html: str, *tags: str) -> str:
    text = f"regexp_replace({html}, '(?s)<!--.*?-->|<![^>]*>|<\\?[^>]*>', chr(1), 'g')"
    for tag in tags:
        text = f"regexp_replace({text}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(1), 'g')"
    return text


def _nodes(markup: str, glue: str) -> str:
    tag = """(?s)</?[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
    pieces = f"string_split(regexp_replace({markup}, '{tag}', chr(1), 'g'), chr(1))"
    strip = "regexp_replace({0}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')".format(_unescaped("p"))
    return f"array_to_string(list_filter(list_transform({pieces}, lambda p: {strip}), lambda p: p <> ''), {glue})"


def _element(tag: str) -> str:
    silent = _silenced("html", "script", "style", "template")
    return _nodes(f"regexp_extract({silent}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)", "' '")


_GIVEN = """CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '/product/p-' || page_id || '/' ELSE ' slug-' || page_id || '/ ' END"""
_GIVEN_BUY = f"replace({_GIVEN}, 'product', 'buy')"

_SPELLINGS = [
    "p_brand || ' ' || p_name || ' ' || p_size || ' Pack & more (new)'",
    "p_name || ' of ' || p_brand || ' / ' || p_size || ' pack'",
    "p_size || '-PACK-' || p_brand || '-' || upper(p_name)",
]
_SHARED = f"""
spelled AS (SELECT p_partkey, {", ".join(
    f"string_split({_normalised(text)}, ' ') AS words_{i}" for i, text in enumerate(_SPELLINGS)
)} FROM part),
shared AS (SELECT p_partkey, list_filter(words_0, lambda w: list_contains(words_1, w)
             AND list_contains(words_2, w)) AS words FROM spelled)"""

GROUP_NAMES = f"""{NAMES},
members AS (SELECT concat_ws('/', p_brand, p_type, p_size) AS group_id, p_partkey, product_name,
              string_split(name, ' ') AS words
            FROM names JOIN part ON CAST(p_partkey AS VARCHAR) = product_id),
heads AS (SELECT group_id, count(*) AS n, arg_min(product_name, p_partkey) AS first_name,
                 arg_min(words, p_partkey) AS first_words FROM members GROUP BY ALL),
counted AS (SELECT group_id, word, count(DISTINCT p_partkey) AS n
            FROM (SELECT group_id, p_partkey, unnest(words) AS word FROM members) GROUP BY ALL),
common AS (SELECT group_id, list(word) AS shared FROM counted JOIN heads USING (group_id, n) GROUP BY ALL),
kept AS (SELECT group_id, n, first_name,
                list_filter(first_words, lambda w: list_contains(coalesce(shared, []), w)) AS words
         FROM heads LEFT JOIN common USING (group_id))"""

_PAGES = f"""
landed AS (SELECT *, '{SHOP_URL}' AS base, replace(lower(p_name), ' ', '-') AS slug,
                  printf('%.2f', p_retailprice) AS shown FROM part WHERE p_partkey % 9 <> 0)"""

ORACLES: dict[str, str] = {
    "sca_1_normalised_names": _with(NAMES, "SELECT product_id, product_name, name FROM names"),
    "sca_3_shared_name": _with(
        _SHARED, f"SELECT p_partkey, {_title('array_to_string(words, chr(32))')} AS name FROM shared"
    ),
    "sca_5_attributes": _with(
        NAMES,
        f"""SELECT product_id, {_PLY} AS ply, {_PACK} AS pack, nullif(regexp_extract(name, '{_SIZE}', 1), '') AS size_value,
            nullif(regexp_extract(name, '{_SIZE}', 2), '') AS size_unit FROM names""",
    ),
    "sca_7_price_score": _with(
        SNAPSHOT,
        """SELECT product_id, vendor, CASE WHEN gap <= 5 THEN 100 WHEN gap <= 10 THEN 85 WHEN gap <= 15 THEN 70
             WHEN gap <= 25 THEN 45 ELSE 20 END AS price_score,
           'max_price ' || printf('%.2f', max_price) || ' vs ' || printf('%.2f', group_max) || '; difference='
             || printf('%.1f%%', gap) AS price_reason
           FROM (SELECT product_id, vendor, b.max_price, g.max_price AS group_max,
                   (g.max_price - b.max_price) / g.max_price * 100 AS gap
                 FROM listings JOIN bounds b USING (product_id, vendor) JOIN grouped g USING (group_id))""",
    ),
    "sca_8_brand": _with(NAMES, "SELECT product_id, split_part(name, ' ', 1) AS brand FROM names"),
    "sca_9_numbers": _with(
        NAMES, f"SELECT product_id, replace({_numbers('name')}, '@', ',') AS numbers FROM names"
    ),
    "sca_11_final_score": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(printf('%.2f',
    CASE WHEN l_returnflag <> 'N' THEN name_score * 0.75::DOUBLE + points * 0.25::DOUBLE ELSE name_score END) AS DOUBLE)
  AS final_score
FROM (SELECT *, (l_quantity * 200 + l_linenumber * 7 + l_suppkey % 100) / 100::DOUBLE AS name_score,
             CAST(trunc(l_tax * 1000) AS INTEGER)::DOUBLE AS points FROM lineitem)""",
    "sca_16_dates": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS DATE) END AS date FROM events",
    "mat_5_group_names": _with(
        GROUP_NAMES,
        f"""SELECT group_id, CASE WHEN n > 1 AND len(words) > 0 THEN
              {_title("array_to_string(words, ' ')")} ELSE first_name END AS group_name FROM kept""",
    ),
    "joi_7_gated_name_pairs": _with(
        _GATED,
        "SELECT category, l_name, r_name, penalty, penalty_reasons FROM pairs WHERE best - penalty >= 60 - 0.02",
    ),
    "mat_3_assign": _with(
        f"{LINES}, {LISTINGS}",
        f""", known AS (SELECT group_id, product_name AS group_name, category, product_id, vendor, product_name
             FROM listings WHERE NOT (group_id % 5 = 0 AND vendor = '{ONE_VENDOR}')),
        fresh AS (SELECT * FROM listings WHERE group_id % 5 = 0 AND vendor = '{ONE_VENDOR}'),
        ids AS (SELECT DISTINCT group_id, group_name FROM known),
        options AS (SELECT f.*, 1 AS place, f.group_id + 1 AS target FROM fresh f UNION ALL
                    SELECT f.*, 2, f.group_id FROM fresh f),
        taken AS (SELECT product_id, vendor, product_name, category, target, group_name FROM options
                  JOIN (SELECT group_id AS target, group_name FROM ids) USING (target) WHERE group_id % 10 = 0
                  QUALIFY row_number() OVER (PARTITION BY product_id, vendor ORDER BY place) = 1),
        single AS (SELECT *, row_number() OVER (ORDER BY vendor, category, product_name, product_id) AS place
                   FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM taken t
                     WHERE t.product_id = f.product_id AND t.vendor = f.vendor))
        SELECT * FROM known
        UNION ALL SELECT target, group_name, category, product_id, vendor, product_name FROM taken
        UNION ALL SELECT place + (SELECT max(group_id) FROM known), product_name, category, product_id, vendor,
                         product_name FROM single""",
    ),
    "nrm_1_json_records": _with(JSON_ROWS, f"SELECT {_RECORD}, {_SEQ} FROM good"),
    "nrm_2_brand_prefix": """
SELECT p_partkey, CASE WHEN contains(lower(full_name), lower(size)) THEN full_name ELSE full_name || ' ' || size END
  AS product_name
FROM (SELECT *, CASE WHEN contains(lower(sized), lower(p_brand)) THEN sized ELSE p_brand || ' ' || sized END AS full_name
      FROM (SELECT *, p_size || ' Pack' AS size,
              CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) || ' ' || p_name ELSE p_name END
              || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_size || ' pack' ELSE '' END AS sized FROM part))""",
    "nrm_6_sized_records": _with(
        JSON_ROWS,
        f"""SELECT date, coalesce(id, CASE WHEN source = 'specific' THEN CAST(l_partkey AS VARCHAR) END) AS product_id,
            vendor, brand || ' ' || name || ' ' || size AS product_name, category, price, source, {_SEQ}
            FROM payloads WHERE (id IS NOT NULL OR source = 'specific') AND price IS NOT NULL AND source <> 'gift'""",
    ),
    "nrm_7_page_ids": f"""
SELECT page_id, {_id_of("url", "/productdetails/(\\d+)", "(\\d+)$")} AS detail_id,
  {_id_of("replace(url, '/', '-')", "-(\\d+)$")} AS slug_id, {_URL_PATH} AS path,
  nullif(regexp_extract({_path_of(_BUY_URL)}, '/buy/(\\d+)', 1), '') AS buy_id,
  coalesce(nullif(regexp_extract({_path_of(_PRODUCT_URL)}, '/product/([^/]+)/?', 1), ''),
           nullif(trim({_PRODUCT_URL}, '/'), '')) AS slug
FROM pages""",
    "nrm_10_urls": f"""
SELECT page_id,
  CASE WHEN starts_with(trim(given), 'http') THEN trim(given) WHEN starts_with(trim(given), '/product/')
    THEN '{SHOP_URL}' || trim(given) ELSE '{SHOP_URL}/product/' || trim(trim(given), '/') || '/' END AS wrapped_url,
  CASE WHEN starts_with(trim(buy), 'http') THEN trim(buy) WHEN starts_with(trim(buy), '/buy/')
    THEN '{SHOP_URL}' || trim(buy) END AS buy_url
FROM (SELECT page_id, {_GIVEN} AS given, {_GIVEN_BUY} AS buy FROM pages)""",
    "nrm_11_html_name": f"SELECT page_id, coalesce(nullif({_element('h1')}, ''), {_element('title')}) AS name FROM pages",
    "nrm_12_visible_text": f"""
SELECT page_id, {_nodes(_silenced("html", "script", "style", "template", "noscript"), "chr(10)")} AS text FROM pages""",
    "nrm_13_heading_pages": _with(
        _PAGES,
        f"""SELECT CAST('{AS_OF}' AS DATE) AS date, CAST(CASE WHEN p_partkey % 8 <> 0 THEN p_partkey
              WHEN p_partkey % 4 <> 0 THEN p_partkey + 5 ELSE p_partkey END AS VARCHAR) AS product_id, 'shop' AS vendor,
            CASE WHEN p_partkey % 5 <> 0 THEN p_brand || ' ' || p_name || ' & co' ELSE p_name END AS product_name,
            p_type AS category, CAST(shown AS DOUBLE) AS price, 'specific' AS source
            FROM landed WHERE p_partkey % 7 <> 0""",
    ),
    "nrm_14_slug_pages": _with(
        _PAGES,
        f"""SELECT CAST('{AS_OF}' AS DATE) AS date,
              CASE WHEN p_partkey % 5 <> 0 THEN 'K-' || p_partkey ELSE 'p_' || p_partkey END AS product_id,
              'shop' AS vendor, CASE WHEN p_partkey % 8 <> 0 THEN 'P ' || p_partkey ELSE 'P' END
              || CASE p_partkey % 3 WHEN 0 THEN ' (4 Packs)' WHEN 1 THEN ' (1 Pack)' ELSE '' END AS product_name,
              p_type AS category, CASE WHEN p_partkey % 2 = 0 THEN 77.5 ELSE CAST(shown AS DOUBLE) END AS price,
              'specific' AS source FROM landed""",
    ),
    "nrm_18_slug_names": f"SELECT p_partkey, {_title('lower(p_name) || chr(32) || lower(p_type)')} AS name FROM part",
    "nrm_21_rejects": _with(
        JSON_ROWS,
        "SELECT vendor, reason, count(*) AS n_rows FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    ),
    "nrm_22_merge_sources": _recursive(
        JSON_ROWS,
        f""", asked AS (SELECT * REPLACE (CASE WHEN source = 'specific' AND raw IS NOT NULL
                          AND TRY_CAST(product_id AS BIGINT) % 5 = 0
                          THEN CAST(TRY_CAST(product_id AS BIGINT) + 1 AS VARCHAR) ELSE raw END AS raw) FROM good),
        found AS (SELECT DISTINCT category, vendor, product_id AS raw FROM good WHERE source = 'search'),
        direct AS (SELECT d.*, row_number() OVER (PARTITION BY category, vendor ORDER BY d.seq) AS place
                   FROM asked d ANTI JOIN found USING (category, vendor, raw) WHERE d.source = 'specific'),
        walk AS (SELECT DISTINCT category, vendor, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS given FROM direct
                 UNION ALL
                 SELECT d.category, d.vendor, d.place, CASE WHEN list_contains(w.given, d.raw) THEN w.given
                          ELSE list_append(w.given, d.product_id) END
                 FROM walk w JOIN direct d ON d.category = w.category AND d.vendor = w.vendor AND d.place = w.place + 1),
        used AS (SELECT d.* EXCLUDE (place) FROM direct d JOIN walk w ON d.category = w.category
                   AND d.vendor = w.vendor AND d.place = w.place + 1
                 WHERE d.raw IS NULL OR NOT list_contains(w.given, d.raw)),
        ranked AS (SELECT 0 AS step, * FROM good WHERE source = 'search' UNION ALL BY NAME SELECT 1 AS step, * FROM used)
        SELECT {_RECORD}, {_SEQ} FROM ranked
        QUALIFY row_number() OVER (PARTITION BY category, vendor, product_id ORDER BY step DESC, ranked.seq DESC) = 1""",
    ),
    "nrm_23_first_seen": _with(
        JSON_ROWS,
        f"""SELECT {_RECORD}, search_term, {_SEQ} FROM good WHERE NOT (source = 'search' AND vendor = '{ONE_VENDOR}')
        UNION ALL SELECT {_RECORD}, search_term, {_SEQ} FROM (
          SELECT * FROM good WHERE source = 'search' AND vendor = '{ONE_VENDOR}' QUALIFY row_number() OVER (
            PARTITION BY category, vendor, search_term, product_id ORDER BY good.seq) = 1)""",
    ),
    "flt_1_term_filter": _with(
        f"{LINES}, {LISTINGS}",
        """SELECT product_id, vendor, product_name, category, source, last_seen FROM listings
           WHERE CASE category
             WHEN 'ECONOMY' THEN contains(lower(product_name), 'brand')
               AND (contains(lower(product_name), 'ring') OR contains(lower(product_name), 'rod'))
               AND NOT contains(lower(product_name), 'hot') AND NOT contains(lower(product_name), 'old')
             WHEN 'SMALL' THEN NOT contains(lower(product_name), 'ml')
             WHEN 'PROMO' THEN contains(lower(product_name), 'pk') OR contains(lower(product_name), 'case')
             ELSE true END""",
    ),
    "agg_11_filter_report": _with(
        f"{LINES}, {LISTINGS}",
        """SELECT category, count(*) AS original, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS removed
           FROM (SELECT category, CASE category
             WHEN 'ECONOMY' THEN contains(lower(product_name), 'brand')
               AND (contains(lower(product_name), 'ring') OR contains(lower(product_name), 'rod'))
               AND NOT contains(lower(product_name), 'hot') AND NOT contains(lower(product_name), 'old')
             WHEN 'SMALL' THEN NOT contains(lower(product_name), 'ml')
             WHEN 'PROMO' THEN contains(lower(product_name), 'pk') OR contains(lower(product_name), 'case')
             ELSE true END AS kept FROM listings) GROUP BY ALL""",
    ),
    "flt_2_fetch_targets": _with(
        f"{LINES}, {LISTINGS}",
        """SELECT * FROM (VALUES ('ECONOMY', 'ASIA', 2::BIGINT, 2::BIGINT), ('ECONOMY', 'EUROPE', 2, 2),
             ('SMALL', 'ASIA', 0, 3)) t(category, vendor, n_search_terms, n_specific)
           LEFT JOIN (SELECT category, vendor, count(*) AS n_products FROM listings GROUP BY ALL)
             USING (category, vendor)""",
    ),
    "agg_12_config_summary": _with(
        f"{LINES}, {LISTINGS}",
        """SELECT * FROM (VALUES ('ECONOMY', 'ASIA, EUROPE, NOWHERE', 2::BIGINT), ('SMALL', 'ASIA', 0), ('PROMO', '', 1))
             t(category, vendors, n_search_terms)
           LEFT JOIN (SELECT category, count(*) AS n_products FROM listings GROUP BY ALL) USING (category)""",
    ),
    "str_1_incremental_metrics": """
SELECT CAST(user_id AS VARCHAR) AS product_id, event_type AS vendor, max(value) AS max_price, min(value) AS min_price,
       max(CAST(ts AS DATE)) AS last_updated FROM events GROUP BY ALL""",
}
