"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate, the mean number of its copies in the mix.  Among all
rates up to a bound that give a source its target of words, those closest in
relative entropy to one copy of everything are ``min(bound, exp(l * size / mean))``:
the dual has one multiplier ``l`` per source, and its gradient is the words missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricing_engine.llm.common import word_count
from pricing_engine.operators.numbering import number_rows
from pricing_engine.session import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SALTS = 64  # parts of the documents of one source and size, ranked apart
_EXACT = "decimal(38,9)"  # sums of these don't depend on their order


def _key(source: Column) -> Column:
    """A source as a key that joins nulls as well and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """(key, source_size, docs, target) of the sources of ``sizes`` (key, size).

    Sources in order of their key get the weights in turn.  A target stops at
    ``most`` times its source's size; the excess is shared by weight among the
    others until none is above.  One row is fetched per round; the number of
    rounds is at most that of the sources, in practice a handful.
    """
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = number_rows(totals, ["key"], 0, "place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = staged(ranked.withColumn("weight", turn.cast("long")), "sources")
    level, bound = 0.0, F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("weight") * F.lit(level) > bound
        row = sources.agg(
            F.sum(F.when(full, bound)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weights")
        ).first()
        if not row.weights:
            break
        after = (share * total - (row.held or 0)) / row.weights
        if after <= level:
            break
        level = after
    target = F.least((F.col("weight") * F.lit(level)).cast("double"), bound.cast("double"))
    return sources.select("key", "source_size", "docs", target.alias("target"))


def _rate(most: int) -> Column:
    tilt = F.col("multiplier") * F.col("size") * F.col("docs") / F.col("source_size")
    held = F.least(F.exp(F.least(tilt, F.lit(50.0))), F.lit(float(most)))
    return F.when(F.col("target") <= 0, 0.0).when(
        F.col("target") >= F.col("source_size") * most, float(most)
    ).otherwise(held)


def balance(cells: DataFrame, targets: DataFrame, most: int = MOST_COPIES, tolerance: float = 1e-7, max_steps: int = 60) -> DataFrame:
    """(key, multiplier) that meet the targets, by Newton steps on all sources at once.

    ``cells`` counts the documents of each (key, size): sums over cells are sums
    over documents.  A step is one aggregate of the gradient and the curvature;
    a step that leaves the interval known to hold the root halves it instead.
    Sums are exact decimals, so every rerun takes the same steps.
    """
    state = staged(targets.select("*", F.lit(0.0).alias("multiplier"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("error")), "duals")
    for _ in range(max_steps):
        words = (F.col("number") * F.col("size")).cast("double") * F.col("rate")
        slope = F.when(F.col("rate") < most, words * F.col("size") * F.col("docs") / F.col("source_size")).otherwise(0.0)
        sums = (
            cells.join(state, "key").withColumn("rate", _rate(most))
            .groupBy("key")
            .agg(F.sum(words.cast(_EXACT)).cast("double").alias("words"), F.sum(slope.cast(_EXACT)).cast("double").alias("slope"))
        )
        miss = F.col("words") - F.col("target")
        low = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        spread = F.abs("multiplier") + 1
        halved = F.when(low.isNull(), high - 2 * spread).when(high.isNull(), low + 2 * spread).otherwise((low + high) / 2)
        bounded = F.when(inside & (F.abs(newton - F.col("multiplier")) <= 4 * spread), newton).otherwise(halved)
        settled = (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * most)
        error = F.when(settled, 0.0).otherwise(F.abs(miss) / F.col("target"))
        moved = F.when(error > tolerance, bounded).otherwise(F.col("multiplier"))
        joined = state.join(sums, "key")
        state = staged(
            joined.select(
                "key", "source_size", "docs", "target", moved.alias("multiplier"), low.alias("low"), high.alias("high"),
                error.alias("error"),
            ),
            "duals",
        )
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
    return state.select("key", "multiplier")


def _cell_copies(cells: DataFrame, most: int) -> DataFrame:
    """Whole copies of each cell of (key, size): near number * rate, and near the target in words.

    Running sums by falling size are rounded, so that a source's copies are right
    within one; what is then missing or over in words is settled with the largest
    sizes that fit, pass by pass, until no size fits: each pass brings every source
    that is not there nearer by one size at least.  A source has at most as many
    cells as distinct document sizes.
    """
    order = Window.partitionBy("key").orderBy(F.desc("size"))
    due = F.sum((F.col("number") * F.col("rate")).cast(_EXACT)).over(order)
    whole = F.floor(due + F.lit(0.5)).cast("long")
    cells = cells.withColumn("upto", whole)
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0))
    copies = F.least(F.greatest(copies, F.lit(0)), F.col("number") * most)
    cells = staged(cells.withColumn("copies", copies).drop("upto"), "cells")
    while True:
        over = cells.groupBy("key").agg(
            (F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("missing")
        )
        room = F.when(F.col("missing") > 0, F.col("number") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") <= F.abs("missing")) & (room > 0)
        picked = (
            cells.join(over.filter("missing <> 0"), "key").filter(fits)
            .groupBy("key").agg(F.max(F.struct("size", room.alias("room"), "missing")).alias("best"))
            .select(
                "key", F.col("best.size").alias("size"),
                (F.signum("best.missing") * F.least("best.room", F.floor(F.abs("best.missing") / F.col("best.size")))).cast("long").alias("change"),
            )
        )
        picked = staged(picked, "changes")
        if picked.isEmpty():
            break
        cells = staged(
            cells.join(picked, ["key", "size"], "left")
            .withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change"),
            "cells",
        )
    return cells


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    salts: int = SALTS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): its copies in the mix.

    Columns: doc_id, source, ``keep``, size (words), source_size, target, rate,
    copies, taken (size * copies).  Which documents of one source and size get an
    extra copy is settled by a hash of their id, so reruns agree; a hot source and
    size is dealt over ``salts`` parts.  Null text has size 0; documents without
    words, and sources without words, get no copies; null sources are one source,
    the last; repeated rows count one by one; no rows give no rows.
    """
    size = word_count(F.col("text"))
    rows = docs.select(F.col("doc_id"), F.col("source"), *keep, size.alias("size"))
    rows = staged(rows.withColumn("key", _key(F.col("source"))), "sizes")
    targets = staged(source_targets(rows.select("key", "size"), weights, share, most), "targets")
    cells = staged(rows.filter("size > 0").groupBy("key", "size").agg(F.count("*").alias("number")), "cells")
    duals = balance(cells, targets.filter("source_size > 0"), most)
    rated = cells.join(targets.join(duals, "key"), "key").withColumn("rate", _rate(most))
    cells = _cell_copies(rated.select("key", "size", "number", "rate", "target"), most)

    mark = F.xxhash64(F.col("doc_id"), F.col("size"))
    rows = rows.withColumn("mark", mark).withColumn("salt", F.pmod("mark", F.lit(salts)))
    parts = rows.filter("size > 0").groupBy("key", "size", "salt").agg(F.count("*").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("key", "size").orderBy("salt"))
    def share_of(docs: str) -> Column:
        return F.expr(f"cast(copies AS decimal(19,0)) * cast({docs} AS decimal(19,0)) DIV cast(number AS decimal(19,0))")

    parts = (
        parts.withColumn("upto", upto).join(cells, ["key", "size"])
        .select("key", "size", "salt", "held", "rate", (share_of("upto") - share_of("upto - held")).alias("quota"))
    )
    place = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("mark", "doc_id", *keep))
    placed = rows.withColumn("place", place).join(parts, ["key", "size", "salt"], "left")
    each = F.floor(F.col("quota") / F.col("held"))
    copies = each + F.when(F.col("place") <= F.col("quota") - each * F.col("held"), 1).otherwise(0)
    copies = F.coalesce(copies, F.lit(0)).cast("long")
    return placed.join(targets.select("key", "source_size", "target"), "key").select(
        "doc_id", "source", *keep, "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"),
        copies.alias("copies"), (F.col("size") * copies).alias("taken"),
    )
