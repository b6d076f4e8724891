"""Line dedup by site-relative frequency: lines on too large a share of a host's pages go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricing_engine.llm.common import content_key, fresh_name

MAX_RATIO = 0.1
MIN_PAGES = 2  # a line on a single page is nobody's boilerplate, whatever its ratio

HIDDEN = r"(?is)<(?:script\b[^>]*+>.*?</script\s*+>|style\b[^>]*+>.*?</style\s*+>|!--.*?-->)"
BREAKS = (
    r"(?i)</?(?:article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main"
    r"|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*+>"
)


def page_text(html: Column) -> Column:
    """Lines of a page: block tags break lines, other tags, scripts and comments go."""
    shown = F.regexp_replace(html, HIDDEN, " ")
    return F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), r"<[^>]*+>", "")


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and a leading ``www.``; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def _line_key(line: Column) -> Column:
    """128 bits that stand for a line without blanks around it; null for a blank line."""
    line = F.btrim(line, F.lit(" \t\r\f\x0b"))
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b")))


def drop_frequent_lines(
    pages: DataFrame,
    host: str,
    text: str,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    counted_lines: bool = True,
) -> DataFrame:
    """``pages`` with ``text`` rid of boilerplate and, if ``counted_lines``, n_lines and n_dropped (long).

    A line (compared without blanks at its ends) is boilerplate of its host if it
    stands on at least ``min_pages`` of the host's pages and on more than
    ``max_ratio`` of them.  ``text`` is a string whose lines end with ``\\n``, or an
    array of lines; it comes out as a string.  Blank lines stay.  Null texts stay null
    with 0 lines; a null host is a host of its own; every row is a page, repeated rows
    too.  Columns n_lines and n_dropped replace such columns of ``pages``.

    A page's lines are made distinct within its row, so that counting needs one
    shuffle of partial counts by (host, line), and a line common to a whole host is
    summed before it is sent.  Texts are shuffled once, to the pages that lose lines,
    which are told by host and text.
    """
    a, b, of_a, of_b, gone = (fresh_name(pages, n) for n in ("key_a", "key_b", "of_a", "of_b", "gone"))
    rows = pages.select("*", *content_key([host, text], a, b))
    every = F.col(text) if isinstance(pages.schema[text].dataType, T.ArrayType) else F.split(F.col(text), "\n")
    lines = F.filter(F.transform(every, _line_key), lambda k: k.isNotNull())
    exploded = rows.select(
        F.col(a).alias(of_a), F.col(b).alias(of_b), F.col(host).alias("host"), F.explode(F.array_distinct(lines)).alias("line")
    )
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    counts = exploded.groupBy("host", "line").agg(F.count("*").alias("on")).filter(F.col("on") >= min_pages)
    frequent = (
        counts.join(totals, counts["host"].eqNullSafe(totals["host"]))
        .filter(F.col("on") > F.col("pages") * max_ratio)
        .select(counts["host"].alias("of"), F.col("line").alias("frequent"))
    )
    hits = exploded.join(
        frequent,
        (exploded["line"]["a"] == frequent["frequent"]["a"])
        & (exploded["line"]["b"] == frequent["frequent"]["b"])
        & exploded["host"].eqNullSafe(frequent["of"]),
    )
    # at most 1 / max_ratio lines of a host for each line of its mean page
    hits = hits.groupBy(of_a, of_b).agg(F.collect_set("line").alias(gone))
    joined = rows.join(hits, (F.col(a) == F.col(of_a)) & (F.col(b) == F.col(of_b)), "left")
    left = F.when(F.col(gone).isNull(), every).otherwise(
        F.filter(every, lambda s: ~F.coalesce(F.array_contains(F.col(gone), _line_key(s)), F.lit(False)))
    )
    counted = joined.withColumn(gone, left)

    def number(of: Column) -> Column:
        return F.when(F.col(text).isNull(), 0).otherwise(F.size(of)).cast("long")

    n_lines, n_kept = number(every), number(F.col(gone))
    shown = F.array_join(gone, "\n").alias(text)
    counts = [n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")] if counted_lines else []
    taken = ("n_lines", "n_dropped") if counted_lines else ()
    return counted.select(*[shown if c == text else F.col(c) for c in pages.columns if c.lower() not in taken], *counts)
