"""Language identification by mixture inference over character n-grams.

Each language is a distribution over hashed letter trigrams, counted from labelled
texts.  A text's language proportions are estimated by expectation-maximisation, and
the set of languages it holds by likelihood less a penalty for each further one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricing_engine.llm.common import slices

BUCKETS = 1 << 16
SMOOTHING = 0.5  # added to each count
PENALTY = 3.0  # log-likelihood that a further language must add, times log(trigrams) / 2
STEPS = 30
UNDETERMINED = "und"
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the trigrams of a whole text's letters; runs of others count as one blank."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    points = np.where(_letters()[points], points, np.uint32(32))
    blank = points == 32
    points = points[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = points[:-2] * _MULTIPLIERS[0] + points[1:-1] * _MULTIPLIERS[1] + points[2:] * _MULTIPLIERS[2]
    buckets = ((mixed ^ (mixed >> np.uint32(15))) * _MULTIPLIERS[0]) >> np.uint32(16)
    if len(buckets) < 5_000:
        return np.unique(buckets.astype(np.int64), return_counts=True)
    counts = np.bincount(buckets, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    chances: np.ndarray  # (BUCKETS, languages)


def fit(labelled: DataFrame) -> Model:
    """A model of ``labelled`` (text, lang); rows with a null lang or text are left out.

    Tasks count trigrams per language; the driver gets a count per language and bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buckets, counts = trigrams(text)
                if len(buckets):
                    totals.setdefault(lang, np.zeros(BUCKETS, np.int64))[buckets] += counts
        for lang, counts in totals.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found)), pa.array(found), pa.array(counts[found])], names=["lang", "bucket", "n"]
            )

    rows = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(set(found["lang"]))
    chances = np.full((BUCKETS, len(languages)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    chances[found["bucket"].to_numpy(np.int64), found["lang"].map(place).to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    return Model(languages, (chances / chances.sum(axis=0)).astype(np.float32))


def proportions(chances: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation-maximisation, and their log-likelihood."""
    share = np.full(chances.shape[1], 1 / chances.shape[1])
    total = counts.sum()
    for _ in range(steps):
        mixed = chances @ share
        after = share * ((counts / mixed) @ chances) / total
        moved = np.abs(after - share).max()
        share = after
        if moved < 1e-3:
            break
    return share, float(counts @ np.log(chances @ share))


def mixture(model: Model, text: str | None, penalty: float = PENALTY) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(languages of a text, most first; their proportions; proportions if it held all); no letters: none."""
    buckets, counts = trigrams(text)
    if not len(buckets) or not model.languages:
        return [], np.empty(0), np.empty(0)
    chances, weights = model.chances[buckets].astype(np.float64), counts.astype(np.float64)
    every, _ = proportions(chances, weights)
    alone = weights @ np.log(chances)
    first = int(alone.argmax())
    order = [first, *(int(i) for i in np.argsort(-every, kind="stable") if i != first)]
    chosen, share, best = [first], np.ones(1), float(alone[first])
    cost = penalty * np.log(weights.sum() + 1) / 2
    for size in range(2, len(order) + 1):
        trial, likelihood = proportions(chances[:, order[:size]], weights)
        if likelihood - cost * (size - 1) <= best - cost * (len(chosen) - 1):
            break
        chosen, share, best = order[:size], trial, likelihood
    rank = np.argsort(-share, kind="stable")
    return [chosen[i] for i in rank], share[rank], every


def identified(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, languages and shares of every row of ``docs`` (text).

    ``lang_pred`` has the largest share of the languages that the text is found to
    hold (``languages``, ``shares``); ``score`` is its share if the text could hold
    all.  A text that is null or without letters, or a model without languages, gives
    ``und``, score 0 and no languages.  Any number of rows; repeated rows alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                    found, share, every = mixture(own, text)
                    if found:
                        rows.append((own.languages[found[0]], min(1.0, float(every[found[0]])), [own.languages[i] for i in found], share.tolist()))
                    else:
                        rows.append((UNDETERMINED, 0.0, [], []))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                found_ = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([*columns, *found_], names=[*keep, "lang_pred", "score", "languages", "shares"])

    schema = docs.select(*keep).schema
    for name, kind in (("lang_pred", "string"), ("score", "double")):
        schema = schema.add(name, kind)
    schema = schema.add("languages", T.ArrayType(T.StringType())).add("shares", T.ArrayType(T.DoubleType()))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
