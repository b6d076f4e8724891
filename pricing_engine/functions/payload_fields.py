"""Fields of landed vendor payloads: ids, URLs, names and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricing_engine.functions.text import collapse_spaces, strip_spaces, title_case

# Where ids, prices and pack labels stand in URLs and page texts
DETAIL_URL_ID = r"/productdetails/(\d+)"
TRAILING_ID = r"(\d+)$"
SLUG_ID = r"-(\d+)$"
BUY_PATH_ID = r"/buy/(\d+)"
PRODUCT_PATH_SLUG = r"/product/([^/]+)/?"
PLAIN_PRICE = r"\$(\d+(?:\.\d{1,2})?)"
MONEY = r"A?\$\s*(\d+(?:\.\d{1,2})?)"
PAGE_PRODUCT_ID = r"(?i)Product ID:\s*(\d+)"
SKU = r"(?i)\bSKU\b\s*([A-Za-z0-9_-]+)"
PER_ITEM = r"(?i)per\s+item"
ONE_PACK = r"(?i)\),\s*1\s+Pack\b"
MANY_PACKS = r"(?i)\b(\d+)\s+Packs\b"
URL_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The captured group of the first match, null when there is none."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def with_brand(brand: Column, name: Column) -> Column:
    """``brand name`` unless the name holds the brand already, in any case."""
    missing = F.coalesce(blank_to_null(brand).isNotNull() & ~F.contains(F.lower(name), F.lower(brand)), F.lit(False))
    return strip_spaces(F.when(missing, F.concat_ws(" ", brand, name)).otherwise(name))


def with_size(name: Column, size: Column) -> Column:
    """``name size`` unless the name holds the size already, in any case."""
    missing = F.coalesce(blank_to_null(size).isNotNull() & ~F.contains(F.lower(name), F.lower(size)), F.lit(False))
    return F.when(missing, strip_spaces(F.concat_ws(" ", name, size))).otherwise(name)


def detail_id(identifier: Column) -> Column:
    """Digits as they are, else the id in a detail URL, else trailing digits."""
    value = strip_spaces(identifier)
    return F.coalesce(
        first_match(value, r"^(\d+)$"),
        first_match(value, DETAIL_URL_ID),
        first_match(value, TRAILING_ID),
    )


def slug_id(identifier: Column) -> Column:
    """Digits as they are, else the digits after the last dash of a slug."""
    value = strip_spaces(identifier)
    return F.coalesce(first_match(value, r"^(\d+)$"), first_match(value, SLUG_ID))


def url_path(value: Column) -> Column:
    """The path of a URL or of a bare path; the whole value if it has no path."""
    return F.coalesce(first_match(value, URL_PATH), value)


def buy_id(value: Column) -> Column:
    return first_match(url_path(value), BUY_PATH_ID)


def product_slug(value: Column) -> Column:
    """The slug in a ``/product/<slug>`` path, else the value without outer slashes."""
    bare = F.btrim(strip_spaces(value), F.lit("/"))
    return F.coalesce(first_match(url_path(value), PRODUCT_PATH_SLUG), blank_to_null(bare))


def absolute_url(identifier: Column, base_url: str, path_prefix: str, wrap_slugs: bool) -> Column:
    """Full URLs kept, paths under ``path_prefix`` put below the base, slugs wrapped.

    Null marks an identifier that gives no URL.
    """
    value = strip_spaces(identifier)
    url = F.when(value.startswith("http://") | value.startswith("https://"), value).when(
        value.startswith(path_prefix), F.concat(F.lit(base_url), value)
    )
    if wrap_slugs:
        slug = F.btrim(value, F.lit("/"))
        url = url.when(value != "", F.concat(F.lit(base_url + path_prefix), slug, F.lit("/")))
    return url


def slug_name(slug: Column) -> Column:
    words = F.regexp_replace(F.btrim(strip_spaces(slug), F.lit("/")), "[-_]+", " ")
    return title_case(collapse_spaces(words))


def _amounts(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.transform(found, lambda amount: amount.cast("double"))


def money_values(text: Column) -> Column:
    return _amounts(text, MONEY)


def first_positive_price(text: Column) -> Column:
    return F.get(F.filter(_amounts(text, PLAIN_PRICE), lambda x: x > 0), F.lit(0))


def halve_repeated(values: Column) -> Column:
    """The first half of a sequence that is rendered twice; other sequences whole."""
    half = F.floor(F.size(values) / 2).cast("int")
    twice = (F.size(values) % 2 == 0) & (
        F.slice(values, F.lit(1), half) == F.slice(values, half + 1, half)
    )
    return F.when((F.size(values) > 0) & twice, F.slice(values, F.lit(1), half)).otherwise(values)


def pack_price(amounts: Column, text: Column) -> Column:
    """The first price; on pages priced per item, the full price of the last pack.

    Such pages list, after the selected price, pairs of pack price and item price.
    """
    values = halve_repeated(amounts)
    first = F.get(values, F.lit(0))
    full = F.filter(values, lambda x, i: i % 2 == 1)
    by_pack = text.rlike(PER_ITEM) & (F.size(values) >= 3)
    return F.when(by_pack, F.try_element_at(full, F.lit(-1))).otherwise(first)


def page_product_id(text: Column) -> Column:
    return first_match(text, PAGE_PRODUCT_ID)


def sku(text: Column) -> Column:
    return first_match(text, SKU)


def pack_label(text: Column) -> Column:
    """``1 Pack`` after a bracket, else the last plural pack option, else null."""
    flat = collapse_spaces(text)
    last = F.try_element_at(F.regexp_extract_all(flat, F.lit(MANY_PACKS), 1), F.lit(-1))
    return F.when(flat.rlike(ONE_PACK), F.lit("1 Pack")).when(
        last.isNotNull(), F.concat(last, F.lit(" Packs"))
    )


def with_pack_label(name: Column, label: Column) -> Column:
    missing = F.coalesce(~F.contains(F.lower(name), F.lower(label)), F.lit(False))
    return F.when(missing, F.concat(name, F.lit(" ("), label, F.lit(")"))).otherwise(name)
