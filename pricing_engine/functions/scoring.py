"""Scores, discount and price status as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricing_engine.functions.rounding import exact_round, fixed_text

# Fixed values -------------------------------------------------------------
PLY_PENALTY, PACK_PENALTY, SIZE_PENALTY = 25, 20, 20
# (largest price difference in percent, score); beyond the last one FAR_PRICE_SCORE
PRICE_STEPS = [(5, 100), (10, 85), (15, 70), (25, 45)]
FAR_PRICE_SCORE = 20
NAME_WEIGHT, PRICE_WEIGHT = 0.75, 0.25
TOKEN_SET_WEIGHT, TOKEN_SORT_WEIGHT, PARTIAL_WEIGHT = 0.50, 0.35, 0.15
# wording of the reasons
NO_PRICE = "Missing max_price for one or both products"
BAD_PRICE = "Invalid max_price for one or both products"
PRICE_TEXT, VERSUS, DIFFERENCE_TEXT = "max_price ", " vs ", "; difference="
DIFFERENT_PLY, DIFFERENT_PACK, DIFFERENT_SIZE = "Different ply: ", "Different pack count: ", "Different size: "
DEFAULT_MIN_SCORE = 70
CHEAPEST, FULL_PRICE, DISCOUNTED = "cheapest", "full price", "discounted"
# --------------------------------------------------------------------------
ROUNDING_SLACK = 0.02


def price_gap(left: Column, right: Column) -> Column:
    """Difference of two positive prices in percent of the higher one, else null."""
    high, low = F.greatest(left, right), F.least(left, right)
    return F.when((left > 0) & (right > 0), (high - low) / high * 100)


def price_points(gap: Column) -> Column:
    """The price score of a difference in percent; null where there is none."""
    points = F.when(gap.isNull(), None)
    for limit, score in PRICE_STEPS:
        points = points.when(gap <= limit, score)
    return points.otherwise(FAR_PRICE_SCORE).cast("int")


def price_score(left: Column, right: Column) -> Column:
    return price_points(price_gap(left, right))


def price_reason(left: Column, right: Column) -> Column:
    return (
        F.when(
            left.isNull() | right.isNull(),
            F.lit(NO_PRICE),
        )
        .when(
            (left <= 0) | (right <= 0),
            F.lit(BAD_PRICE),
        )
        .otherwise(
            F.concat(
                F.lit(PRICE_TEXT),
                fixed_text(left, 2),
                F.lit(VERSUS),
                fixed_text(right, 2),
                F.lit(DIFFERENCE_TEXT),
                fixed_text(price_gap(left, right), 1),
                F.lit("%"),
            )
        )
    )


def _differs(left: Column, right: Column) -> Column:
    return F.coalesce(left != right, F.lit(False))


def size_text(side: Column) -> Column:
    return F.concat(side["size_value"], side["size_unit"])


def attribute_penalty(left: Column, right: Column) -> Column:
    """Points off for ply, pack or size that both names state and that differ."""
    points = F.lit(0)
    for field, penalty in (("ply", PLY_PENALTY), ("pack", PACK_PENALTY)):
        points += F.when(_differs(left[field], right[field]), penalty).otherwise(0)
    return points + F.when(_differs(size_text(left), size_text(right)), SIZE_PENALTY).otherwise(0)


def penalty_reasons(left: Column, right: Column) -> Column:
    """The penalties in words, ``; `` between them; empty when there are none."""

    def reason(label: str, a: Column, b: Column) -> Column:
        return F.when(_differs(a, b), F.concat(F.lit(label), a, F.lit(VERSUS), b))

    return F.concat_ws(
        "; ",
        reason(DIFFERENT_PLY, left["ply"], right["ply"]),
        reason(DIFFERENT_PACK, left["pack"], right["pack"]),
        reason(DIFFERENT_SIZE, size_text(left), size_text(right)),
    )


def mixed_score(name_score: Column, price: Column) -> Column:
    return F.coalesce(name_score * NAME_WEIGHT + price * PRICE_WEIGHT, name_score)


def final_score(name_score: Column, price: Column) -> Column:
    return exact_round(mixed_score(name_score, price), 2)


def name_score_floor(min_score: float) -> float:
    """A lower bound on the name score of every pair that can reach ``min_score``.

    At best the price score is 100 or missing.  The slack covers the rounding of
    both scores to two decimals.
    """
    return min(min_score, (min_score - PRICE_WEIGHT * 100) / NAME_WEIGHT) - ROUNDING_SLACK


def raw_discount(current: Column, highest: Column) -> Column:
    return (highest - current) / highest * 100


def discount(current: Column, highest: Column) -> Column:
    """Percent below the highest price, floored at 0, scaled and rounded half to even."""
    return F.rint(F.greatest(raw_discount(current, highest), F.lit(0.0)) * 10) / 10


def dashboard_discount(current: Column, highest: Column) -> Column:
    """As ``discount``, but 0 without a positive maximum and rounded on the binary value."""
    floored = F.greatest(raw_discount(current, highest), F.lit(0.0))
    return F.when(highest > 0, exact_round(floored, 1)).otherwise(F.lit(0.0))


def price_status(
    current: Column, lowest: Column, highest: Column, precedence: str = "cheapest_first"
) -> Column:
    """``cheapest``, ``full price`` or ``discounted``.

    ``cheapest_first`` lets the minimum win where minimum and maximum agree;
    ``full_first`` lets the maximum win and ignores a bound that is zero or null.
    """
    if precedence == "cheapest_first":
        return (
            F.when(current == lowest, CHEAPEST)
            .when(current == highest, FULL_PRICE)
            .otherwise(DISCOUNTED)
        )
    if precedence == "full_first":
        return (
            F.when((highest != 0) & (current == highest), FULL_PRICE)
            .when((lowest != 0) & (current == lowest), CHEAPEST)
            .otherwise(DISCOUNTED)
        )
    raise ValueError(f"unknown precedence: {precedence}")


def status_badge(status: Column, off: Column) -> Column:
    return (
        F.when(status == CHEAPEST, F.lit("✓ low"))
        .when(status == DISCOUNTED, F.concat(F.lit("-"), fixed_text(off, 1), F.lit("%")))
        .otherwise(F.lit("full"))
    )
