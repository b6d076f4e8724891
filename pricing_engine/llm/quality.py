"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel over standardised statistics of a text.
The normal equations are summed per partition and fold, so any number of labelled
rows fits; scores of rows left out of a fit are calibrated by isotonic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricing_engine.llm.common import slices, words_of
from pricing_engine.session import staged

FOLDS = 4
FEATURES = 256
WIDTH = 3.0  # of the kernel, in standard deviations times the root of the statistics' number
RIDGE = 1e-3
BINS = 2_000  # steps of the raw score that the calibration tells apart
THRESHOLD = 0.7
_PARTS = 32  # rows of the normal equations that one task sums

_RARE = re.compile(r"[^\w\s.,;:'\"?!()\-]")
_SHOUT = re.compile(r"[!?]{2,}")
_TIGHT = re.compile(r"\w[^\w\s'\-]+\w")
STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "distinct_words", "upper", "digits", "blank", "rare",
    "marks_at_end", "shouts", "bars", "tight", "capital_words", "short_words", "long_words", "stops", "commas",
    "repeated_words", "repeated_pairs", "repeated_lines", "mean_line", "worst_upper", "worst_rare", "worst_shouts",
    "worst_repeats",
)
PIECE = 60  # words of a piece, for the worst part of a text


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of ``STATISTICS``; null is as empty."""
    text = text or ""
    words, n = words_of(text), len(text)
    if not words:
        return [float(np.log1p(n))] + [0.0] * (len(STATISTICS) - 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    k = len(words)
    upper = sum(map(str.isupper, words))
    rare, shouts = len(_RARE.findall(text)), len(_SHOUT.findall(text))
    bare = [w.strip(".,;:!?'\"()").lower() for w in words]
    distinct = len(set(bare))
    pairs = len(set(zip(bare, bare[1:]))) if k > 1 else 1
    lines = [x for x in text.split("\n") if x.strip()]
    worst = [0.0, 0.0, 0.0, 0.0]
    for at in range(0, k, PIECE):
        at = min(at, max(0, k - PIECE))  # the last piece overlaps the one before
        piece = words[at : at + PIECE]
        joined, size = " ".join(piece), len(piece)
        parts = (
            sum(map(str.isupper, piece)), len(_RARE.findall(joined)), len(_SHOUT.findall(joined)),
            size - len(set(bare[at : at + PIECE])),
        )
        worst = [max(a, b / size) for a, b in zip(worst, parts)]
    return [
        float(np.log1p(n)), float(np.log1p(k)), float(lengths.mean()), float(lengths.std()), distinct / k, upper / k,
        sum(map(str.isdigit, text)) / n if not text.isascii() else len(re.findall("[0-9]", text)) / n,
        1 - float(lengths.sum()) / n, rare / k,
        sum(not w[-1].isalnum() for w in words) / k, shouts / k, text.count("|") / k, len(_TIGHT.findall(text)) / k,
        sum(w[0].isupper() for w in words) / k, float((lengths <= 2).mean()), float((lengths >= 12).mean()),
        len(re.findall(r"[.!?]\s", text)) / k, text.count(",") / k, 1 - distinct / k, 1 - pairs / max(1, k - 1),
        1 - len(set(lines)) / len(lines), float(np.log1p(k / len(lines))), *worst,
    ]


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` and ``stats``, an array of the text's statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                stats = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, stats], names=[*keep, "stats"])

    schema = docs.select(*keep).schema.add("stats", T.ArrayType(T.DoubleType()))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """All that scoring needs; a few hundred numbers, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # calibrated scores there

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale, self.directions, self.phases) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.levels)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    z = np.clip((stats - mean) / scale, -8, 8) @ directions + phases
    return np.hstack([np.sqrt(2 / len(phases)) * np.cos(z), np.ones((len(z), 1))])


def isotonic(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to the means ``values`` with weights ``counts``."""
    blocks: list[list[float]] = []
    for v, c in zip(values.tolist(), counts.tolist()):
        blocks.append([v, c, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, c2, n2 = blocks.pop()
            v1, c1, n1 = blocks[-1]
            blocks[-1] = [(v1 * c1 + v2 * c2) / (c1 + c2), c1 + c2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.empty(0)


def _matrix(batches: Iterator[pa.RecordBatch], index: int) -> np.ndarray:
    return batches.column(index).flatten().to_numpy(zero_copy_only=False).reshape(batches.num_rows, -1)


def fit(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, folds: int = FOLDS) -> Model:
    """A model from ``labelled``: stats (array), label (0 or 1) and fold (0 .. folds - 1).

    Rows with a null label are left out.  Without labelled rows every score is 0.5;
    with labels of one kind only, scores lean to it (one row of either kind is added).
    The driver sees sums of fixed size and counts of ``BINS`` steps of the score.
    """
    rows = labelled.filter("label IS NOT NULL").select(
        "stats", F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold")
    )
    size = len(STATISTICS)
    moments = rows.select(
        F.count("*").alias("n"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(size)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(size)],
    ).first()
    if not moments.n:
        zero = np.zeros(size)
        return Model(zero, zero + 1, np.zeros((size, features)), np.zeros(features), np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean = np.array([moments[f"m{i}"] for i in range(size)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(size)])
    scale[scale < 1e-9] = 1.0
    random = np.random.default_rng(20)
    directions = random.normal(size=(size, features)) / (width * np.sqrt(size) / 2)
    phases = random.uniform(0, 2 * np.pi, features)
    most = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, most, most + 1))
        for batch in batches:
            x = fourier(_matrix(batch, 0), mean, scale, directions, phases)
            y, own = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(folds):
                part = x[own == k]
                total[k, :, :most] += part.T @ part
                total[k, :, most] += part.T @ y[own == k]
        ids = [(k, i) for k in range(folds) for i in range(0, most, _PARTS)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in ids], pa.int32()), pa.array([i for _, i in ids], pa.int32()),
                pa.array([total[k, i : i + _PARTS].tobytes() for k, i in ids], pa.binary()),
            ],
            names=["fold", "at", "sums"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                part = np.frombuffer(data)
                held[k, i] = held[k, i] + part if (k, i) in held else part
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in held], pa.int32()), pa.array([i for _, i in held], pa.int32()),
                pa.array([v.tobytes() for v in held.values()], pa.binary()),
            ],
            names=["fold", "at", "sums"],
        )

    schema = "fold int, at int, sums binary"
    summed = rows.mapInArrow(sums, schema).repartition("fold", "at").mapInArrow(add, schema)
    equations = np.zeros((folds, most, most + 1))
    for k, i, data in summed.collect():
        equations[k, i : i + _PARTS] += np.frombuffer(bytes(data)).reshape(-1, most + 1)

    def solved(e: np.ndarray) -> np.ndarray:
        n = max(1.0, e[-1, most - 1])
        return np.linalg.solve(e[:, :most] + ridge * n * np.eye(most), e[:, most])

    whole = equations.sum(axis=0)
    apart = np.stack([solved(whole - equations[k]) for k in range(folds)])

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = fourier(_matrix(batch, 0), mean, scale, directions, phases)
            raw = (x * apart[batch.column(2).to_numpy()]).sum(axis=1)
            steps = np.clip(np.rint(raw * BINS / 2), -BINS, 2 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(steps), batch.column(1)], names=["step", "label"])

    seen = rows.mapInArrow(outside, "step int, label double").groupBy("step").agg(
        F.sum("label").alias("good"), F.count("*").alias("n")
    ).orderBy("step").collect()
    steps = np.array([r.step for r in seen]) * 2 / BINS
    good, n = np.array([r.good for r in seen]), np.array([float(r.n) for r in seen])
    # a row of either kind at the ends keeps scores off 0 and 1 where rows are few
    steps = np.concatenate([[steps[0] - 1e-6], steps, [steps[-1] + 1e-6]])
    levels = isotonic(np.concatenate([[0.0], good / n, [1.0]]), np.concatenate([[1.0], n, [1.0]]))
    return Model(mean, scale, directions, phases, solved(whole), steps, levels)


def learned(stats: DataFrame, labels: DataFrame, use: Column, folds: int = FOLDS) -> Model:
    """A model of ``labels`` (doc_id, quality) for ``stats`` (doc_id, stats) where ``use`` holds.

    Labels of ids without a text and null labels are left out; repeated rows count
    one by one, null ids never match.
    """
    known = labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").alias("label"))
    rows = stats.filter(use).join(known, F.col("doc_id") == F.col("labelled_id"))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")
    return fit(staged(rows.select("stats", "label", own.alias("fold")), "labelled"), folds=folds)


def scored(stats: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``stats`` and ``score``, the chance of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch, len(keep))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])

    rows = stats.select(*keep, "stats")
    return rows.mapInArrow(run, stats.select(*keep).schema.add("score", "double"))


def accepted(docs: DataFrame, labels: DataFrame, use: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that score ``threshold`` or more, with all their columns.

    Null texts are scored as empty ones.  The model is learned as in :func:`learned`
    from one pass over the texts; a second one scores and filters, so no text is
    staged or shuffled.
    """
    model = learned(staged(with_statistics(docs), "stats"), labels, use)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                stats = np.array([statistics(t) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(run, docs.schema)
