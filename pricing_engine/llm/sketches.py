"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every shingle hash of a text below a fixed fraction of all values, so
that long texts have long sketches and sketches of parts merge into that of the
whole.  For texts too short for that it also keeps the ``FLOOR`` least hashes.
A sketch is complete up to a known height, and two are compared below the lower one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricing_engine.llm.common import shingle_hashes, slices, words_of

SHINGLE = 5
FRACTION = 1 / 16
FLOOR = 32
_ALL = (1 << 64) - 1


def sketch(text: str | None, width: int = SHINGLE, fraction: float = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """The distinct shingle hashes to keep, ascending; none for texts without words."""
    return reduced(np.unique(shingle_hashes(words_of(text), width)), fraction, floor)


def reduced(hashes: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """Of distinct ascending hashes, those that a sketch keeps."""
    below = int(np.searchsorted(hashes, np.uint64(int(fraction * _ALL))))
    return hashes[: max(below, floor)]


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """The sketch of the two texts' shingles together."""
    return reduced(np.union1d(a, b), fraction, floor)


def height(kept: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> int:
    """Up to here a sketch holds all hashes of its text."""
    return _ALL if len(kept) < floor else max(int(fraction * _ALL), int(kept[-1]))


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> tuple[float, float, float]:
    """(resemblance, part of a that is in b, part of b that is in a), estimated, 0 to 1.

    Sketches without hashes are like each other (1) and unlike all others (0).
    """
    if not len(a) or not len(b):
        return (float(len(a) == len(b)),) * 3
    least = np.uint64(min(height(a, fraction, floor), height(b, fraction, floor)))
    a, b = a[: np.searchsorted(a, least, "right")], b[: np.searchsorted(b, least, "right")]
    if not len(a) or not len(b):
        return (float(len(a) == len(b)),) * 3
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / len(a), both / len(b)


def to_text(kept: np.ndarray) -> str:
    """16 hex digits for each hash, ascending."""
    return kept.astype(">u8").tobytes().hex()


def from_text(digits: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(digits), ">u8").astype(np.uint64)


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``after``."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _cuts_above(value: Column, falling: list[int], base: int) -> Column:
    """How many of the falling numbers are above ``value``, as a binary search."""
    if not falling:
        return F.lit(base)
    half = len(falling) // 2
    return F.when(value >= falling[half], _cuts_above(value, falling[:half], base)).otherwise(
        _cuts_above(value, falling[half + 1 :], base + half + 1)
    )


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, kept_edited double, kept_next double"
)


def compared_with_next(docs: DataFrame, ranges: int = 0) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The next document is the next lower doc_id; after the last comes the first.  Null
    texts count as empty; rows of one id follow by text, null ids come last; a single
    row is its own next; no rows give no rows.  near_*: resemblance; kept_*: the part
    of the document's own sketch that is found in the other.

    Rows are dealt once, into ranges of ids that are read in falling order, each with
    a copy of the first row of the next range; only ids, one a range, reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    width = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / width for i in range(1, width)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # part 0 holds the ids from the highest cut on; nulls are in the last part of all
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(_cuts_above(F.col("doc_id"), cuts, 0))
    parts = rows.withColumn("part", part.cast("int"))
    tops = parts.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()
    before = {b.part: a.part for a, b in zip(tops, tops[1:])}
    if tops:
        before[tops[0].part] = tops[-1].part  # the first document follows the last
    ends = spark.createDataFrame([(t.part, t.top, before[t.part]) for t in tops], "of int, top long, goes_to int")  # a row a range
    # the first row of a part, to be read after the last row of the part before
    heads = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("goes_to").agg(F.min("text").alias("text"))
    tail = heads.select(
        F.col("goes_to").alias("part"), F.lit(1).alias("last"), F.lit(None).cast("long").alias("doc_id"), "text"
    )
    both = parts.select("part", F.lit(0).alias("last"), "doc_id", "text").unionByName(tail)
    ordered = both.repartition("part").sortWithinPartitions("part", "last", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # doc_id, text and sketch of the row before
        size = 0
        for batch in batches:
            for last, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own = sketch(text)
                if held is not None:
                    out.append(_row(*held, text, own))
                    size += len(held[1])
                held = None if last else (doc_id, text, own)
                if size > 4_000_000:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    return ordered.mapInArrow(run, SCHEMA)


def _row(doc_id: int, text: str, own: np.ndarray, after: str, following: np.ndarray) -> tuple:
    changed = edited(text, after)
    other = sketch(changed)
    near, kept, _ = likeness(own, other)
    near_next, kept_next, _ = likeness(own, following)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return doc_id, len(text), digest, to_text(own), to_text(other), near, near_next, kept, kept_next


_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text), without any shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                marks = [to_text(sketch(t)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


__all__ = ["compared_with_next", "edited", "fingerprints", "from_text", "likeness", "merged", "sketch", "to_text"]
