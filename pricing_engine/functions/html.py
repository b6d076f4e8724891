"""Text of landed HTML pages, as regex chains that stay in the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricing_engine.functions.text import strip_spaces

# Markup that holds no text, and the shape of a tag
COMMENTS = r"(?s)<!--.*?-->|<![^>]*>|<\?[^>]*>"
SILENT_BLOCKS = ["script", "style", "template"]
# possessive: the matcher steps over a tag of any length without recursion or backtracking
TAG = r"""(?s)</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""

_BREAK = "\u0001"
# the usual names first, since a map literal is searched in order
_USUAL = ["amp", "nbsp", "quot", "lt", "gt", "apos", "dollar", "period", "comma", "ndash", "mdash", "rsquo", "euro"]
_ENTITIES = json.dumps(
    {f"{name};": html5[f"{name};"] for name in _USUAL} | {name: html5[name] for name in _USUAL if name in html5} | html5
)


def _code_point(number: Column) -> Column:
    """The character of a code point; UTF-32 bytes decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def unescape(text: Column) -> Column:
    """Named (HTML 5) and numeric references, resolved once.

    Some old names need no semicolon; others stay text without it.
    """
    known = F.from_json(F.lit(_ENTITIES), "map<string,string>")

    def resolve(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]*+);?", 1)
        rest = F.regexp_replace(piece, r"^(?:#[xX][0-9a-fA-F]++|#[0-9]++|[A-Za-z0-9]++);?", "")
        digits = F.regexp_replace(name, "^#[xX]?0*+", "")
        # longer ones than these are no code points
        number = (
            F.when(name.rlike("^#[0-9]+$") & (F.length(digits) <= 7), digits.try_cast("bigint"))
            .when(name.rlike("^#[xX]") & (F.length(digits) <= 6), F.conv(digits, 16, 10).try_cast("bigint"))
        )
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        ended = F.when(F.startswith(F.substr(piece, F.length(name) + 1), F.lit(";")), F.concat(name, F.lit(";")))
        char = F.coalesce(
            F.when(valid, _code_point(number)), F.try_element_at(known, ended), F.try_element_at(known, name)
        )
        return (
            F.when(i == 0, piece)
            .when(char.isNotNull(), F.concat(char, rest))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(text, "&")
    return F.when(
        F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, resolve), "")
    ).otherwise(text)


def _without_silent_parts(html: Column, drop_noscript: bool) -> Column:
    text = F.regexp_replace(html, COMMENTS, _BREAK)
    for tag in SILENT_BLOCKS + (["noscript"] if drop_noscript else []):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", _BREAK)
    return text


def _text_nodes(markup: Column) -> Column:
    """Text between tags, each piece unescaped and stripped, empty ones left out."""
    pieces = F.split(F.regexp_replace(markup, TAG, _BREAK), _BREAK)
    return F.filter(F.transform(pieces, lambda p: strip_spaces(unescape(p))), lambda p: p != "")


def visible_text(html: Column, drop_noscript: bool = False) -> Column:
    """Text nodes joined by newlines, without scripts, styles and comments."""
    return F.array_join(_text_nodes(_without_silent_parts(html, drop_noscript)), "\n")


def element_text(html: Column, tag: str) -> Column:
    """Text of the first ``tag`` element joined by blanks; empty if there is none."""
    inner = F.regexp_extract(_without_silent_parts(html, False), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.array_join(_text_nodes(inner), " ")


def page_name(html: Column, site_suffix: str = "") -> Column:
    """The first heading, else the title without the site's suffix, else empty."""
    title = element_text(html, "title")
    if site_suffix:
        title = F.replace(title, F.lit(site_suffix), F.lit(""))
    return F.coalesce(F.nullif(element_text(html, "h1"), F.lit("")), strip_spaces(title))
