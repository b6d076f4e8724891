"""Final scores of all pairs of a small table, without any blocking or tiling.

The scores of single pairs have tests of their own; here they are given to every pair,
to check which pairs the operators find and what they do with them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pricing_engine.functions import scoring as S
from pricing_engine.functions import text as T
from pricing_engine.functions.ratios import score_names
from pricing_engine.operators.name_pairs import name_features

_FEATURES = ["ply", "pack", "size_value", "size_unit"]


def name_scores(spark, names):
    """{(left, right): name score} of all ordered pairs of product names."""
    frame = spark.createDataFrame([(n,) for n in sorted(set(names))], "product_name string")
    features = name_features(frame.withColumn("name", T.normalised_name("product_name")))
    sides = [features.select(*[F.col(c).alias(f"{p}_{c}") for c in features.columns]) for p in "lr"]
    pairs = sides[0].crossJoin(sides[1])
    of = {p: {c: F.col(f"{p}_{c}") for c in _FEATURES} for p in "lr"}
    only = [F.array_join(F.array_except(f"{a}_sorted_tokens", f"{b}_sorted_tokens"), " ") for a, b in ("lr", "rl")]
    shared = F.length(F.array_join(F.array_intersect("l_sorted_tokens", "r_sorted_tokens"), " "))
    apart = (F.col("l_brand") != F.col("r_brand")) & (F.col("l_brand") != "") & (F.col("r_brand") != "")
    apart |= (F.col("l_numbers") != F.col("r_numbers")) & (F.col("l_numbers") != "") & (F.col("r_numbers") != "")
    table = pairs.select(
        "l_product_name", "r_product_name", "l_name", "r_name",
        F.col("l_sorted_name").alias("l_sorted"), F.col("r_sorted_name").alias("r_sorted"),
        only[0].alias("l_only"), only[1].alias("r_only"), shared.alias("shared"),
        S.attribute_penalty(of["l"], of["r"]).alias("penalty"), apart.alias("apart"),
    ).toPandas()
    scored = score_names(table, floor=-1000.0)["name_score"]
    scored[table["apart"]] = 0.0
    return dict(zip(zip(table["l_product_name"], table["r_product_name"]), scored.tolist()))


def final_scores(spark, pairs):
    """{index: final score} of pairs ((name, price), (name, price)), in their order."""
    names = name_scores(spark, [side[0] for pair in pairs for side in pair])
    rows = [(i, names[a[0], b[0]], a[1], b[1]) for i, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["i", "score", "a", "b"]).astype({"a": "object", "b": "object"}), "i int, score double, a double, b double")
    price = S.price_score(F.col("a"), F.col("b"))
    return {r.i: r.final for r in frame.select("i", S.final_score(F.col("score"), price).alias("final")).collect()}


def scorer(spark, rows):
    """A function that gives the final score of two rows (id, vendor, name, category, price)."""
    kinds = sorted({(r[2], r[4]) for r in rows}, key=str)
    pairs = [(a, b) for a in kinds for b in kinds]
    found = final_scores(spark, pairs)
    table = {pair: found[i] for i, pair in enumerate(pairs)}
    return lambda a, b: table[(a[2], a[4]), (b[2], b[4])]
