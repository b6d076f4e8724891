"""Column functions over product names and other short texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricing_engine.functions.rounding import fixed_text

# Fixed values -------------------------------------------------------------
# Characters that count as white space in names scraped from web pages.
SPACE = (
    r"[ \t\n\x0b\f\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a"
    r"\u2028\u2029\u202f\u205f\u3000]"
)
# Words that bind a number before them to a measure.
UNIT_WORDS = ["g", "kg", "ml", "l", "m", "ply", "pack", "pk", "pcs", "pieces"]
PLY_PATTERN = r"(?U)\b(\d+)\s*ply\b"
PACK_PATTERN = r"(?U)\b(\d+)\s*(pack|pk|pcs|pieces)\b"
SIZE_PATTERN = r"(?U)\b(\d+(?:\.\d+)?)\s*(g|kg|ml|l|m)\b"
# --------------------------------------------------------------------------


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalised_name(name: Column) -> Column:
    """Lower case, ``&`` spelled out, separators to blanks, blanks collapsed."""
    spelled = F.replace(F.lower(name), F.lit("&"), F.lit(" and "))
    return collapse_spaces(F.translate(spelled, "-/,()", "     "))


def folded_term(term: Column) -> Column:
    return F.lower(strip_spaces(term))


def tokens(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda t: t != "")


def brand(normalised: Column) -> Column:
    """The first token; empty when the name has none."""
    return F.coalesce(F.get(F.split(normalised, " "), F.lit(0)), F.lit(""))


def title_case(text: Column) -> Column:
    """A capital after every non-letter: ``carman's 100ml`` gives ``Carman'S 100Ml``."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_tokens(first: Column, others: Column) -> Column:
    """Tokens of ``first``, in order and with repeats, found in every array of ``others``."""
    return F.filter(first, lambda t: F.forall(others, lambda o: F.array_contains(o, t)))


def shared_token_name(names: Column) -> Column:
    """Title-cased tokens common to all names; the first name if there are none."""
    first = F.get(names, F.lit(0))
    split_names = F.transform(names, lambda n: tokens(normalised_name(n)))
    common = _bound(split_names, lambda s: shared_tokens(F.get(s, F.lit(0)), s))

    def name(shared: Column) -> Column:
        return (
            F.when(F.size(names) == 0, F.lit(""))
            .when((F.size(names) == 1) | (F.size(shared) == 0), first)
            .otherwise(title_case(F.array_join(shared, " ")))
        )

    return _bound(common, name)


def _first_group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def ply_count(normalised: Column) -> Column:
    return _first_group(normalised, PLY_PATTERN, 1)


def pack_count(normalised: Column) -> Column:
    return _first_group(normalised, PACK_PATTERN, 1)


def size_value(normalised: Column) -> Column:
    return _first_group(normalised, SIZE_PATTERN, 1)


def size_unit(normalised: Column) -> Column:
    return _first_group(normalised, SIZE_PATTERN, 2)


def standalone_numbers(normalised: Column) -> Column:
    """Sorted distinct whole numbers that no unit word follows."""
    parts = F.split(normalised, " ")

    def is_bare(token: Column, i: Column) -> Column:
        follower = F.coalesce(F.get(parts, i + 1), F.lit(""))
        return token.rlike(r"(?U)^\d+$") & ~follower.isin(UNIT_WORDS)

    return F.array_sort(F.array_distinct(F.filter(parts, is_bare)))


def iso_date(text: Column) -> Column:
    """The wall date of an ISO text, without zone conversion; null when unreadable."""
    cleaned = strip_spaces(text.cast("string"))
    return F.coalesce(
        cleaned.try_cast("date"),
        F.to_date(F.try_to_timestamp(cleaned, F.lit("yyyyMMdd"))),
    )


def safe_number(value: Column) -> Column:
    """A double, or null for text that is no number and for NaN."""
    return F.nullif(value.try_cast("double"), F.lit(float("nan")))


def category_label(category: Column) -> Column:
    return F.replace(category, F.lit("_"), F.lit(" "))


def money_text(price: Column) -> Column:
    return F.concat(F.lit("$"), fixed_text(price, 2))


def percent_text(value: Column) -> Column:
    return F.concat(fixed_text(value, 1), F.lit("%"))
