"""Shared parts: reading tables, folds, row keys, words and shingle hashes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricing_engine.session import staged

# A word: a run without the seven ASCII blanks (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# Texts per slice of an Arrow batch, in bytes: bounds a task's memory.
SLICE_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def content_key(columns: list[str], a: str, b: str) -> list[Column]:
    """128 bits that stand for a row's values, as two columns.

    Unlike a row number it needs no staged copy: every scan gives a row the same key.
    Equal rows have equal keys.
    """
    values = [F.col(c) for c in columns]
    values += [F.isnull(v) for v in values]  # hashes pass over nulls
    return [F.xxhash64(*values).alias(a), F.xxhash64(F.lit(7), *values).alias(b)]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text) if text else []


def lower_ascii(text: str) -> str:
    return text.translate(_UPPER) if not text.isascii() else text.lower()


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ``size`` bytes of text, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.cumsum([0 if x is None else x for x in pc.binary_length(column).to_pylist()])
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def shingle_hashes(words: list[str], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by spaces, repeats included.

    Fewer words give one shingle of all of them, no words none.
    """
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        runs = [" ".join(words)]
    else:
        joined = " ".join(words).encode()
        ends = np.cumsum([len(w) for w in words]) if joined.isascii() else np.cumsum([len(w.encode()) for w in words])
        ends += np.arange(len(words))
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        view = memoryview(joined)
        return np.array(
            [digest(view[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())],
            np.uint64,
        )
    return np.array([xxhash.xxh64_intdigest(r.encode(), seed) for r in runs], np.uint64)


def crc_fold(doc_id: int | None, folds: int) -> int | None:
    """The plain form of :func:`fold`, for tests."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for all nodes of ``edges``: root is the least node reachable.

    Large-star and small-star rounds: every node is linked to the least node it
    knows of, first its larger neighbours, then its smaller ones, until a round
    changes nothing.  Logarithmically many rounds in practice, each a shuffle of
    the links; every round is a written table, so lost executors cost one round.
    A hub's neighbours are reduced by partial aggregates, never gathered.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    pairs = staged(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        pairs = staged(small.filter("u <> v").distinct(), "links")
        seen, mark = mark, pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).groupBy("node").agg(F.min("root").alias("root"))
