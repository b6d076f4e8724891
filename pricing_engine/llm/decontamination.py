"""Benchmark decontamination: passages query a BM25 index of test items.

The index holds the items' words with their BM25 weights, divided by the score that
an item gets from its own text, so that 1 is a full match whatever the item's length.
Block-max WAND finds all items above a threshold for each passage; a hit counts if
the words of both the item's question and its answer are found there in order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricing_engine.llm.common import slices
from pricing_engine.session import staged

K1, B = 1.2, 0.75
LEAST_SCORE = 0.5
LEAST_OVERLAP = 0.8
PASSAGE = 64  # words; twice, four times as many and so on for longer items
RANGE = 8  # items of a block; items are ordered by length, so that a block's weights are alike
CLOSED = 0.4  # of the least score: what the unopened lists may reach
CHUNK = 512  # passages scored at a time
INDEX_ITEMS = 20_000  # items of an index that a task holds, about; more make more indexes
INDEX_CHARS = 20_000_000  # characters of them
_DROPPED = re.compile(r"[^\w\s]+|_+")


def terms(text: str | None) -> list[str]:
    """Words between white space in lower case, without characters other than letters and digits."""
    return _DROPPED.sub("", text.lower()).split() if text else []


def parts(text: str) -> tuple[list[str], list[str]]:
    """Terms of the question and of the answer: cut after the first ``?``, else in the middle."""
    head, mark, tail = text.partition("?")
    question, answer = terms(head), terms(tail)
    if mark and question and answer:
        return question, answer
    words = terms(text)
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


@dataclass(frozen=True)
class Index:
    """Postings of each term lie between two ``starts``, as do its blocks between two ``block_starts``."""

    items: list[tuple[int, str]]
    vocabulary: dict[str, int]
    starts: np.ndarray
    places: np.ndarray  # of items, ascending within a term
    weights: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray  # place // RANGE, ascending within a term
    block_keys: np.ndarray  # term * blocks of the index + block, ascending
    maxima: np.ndarray  # of the weights in a block
    highest: np.ndarray  # of the weights of a term
    rank: np.ndarray  # of a term by its highest weight
    by_rank: np.ndarray
    passage: int


def build(items: list[tuple[int, str]], number: int, mean: float, frequency: dict[str, int], passage: int) -> Index:
    """An index of ``items`` with the statistics of all items; items without words are never found."""
    items = sorted(items, key=lambda x: (len(terms(x[1])), x[1], x[0]))
    vocabulary: dict[str, int] = {}
    lists: list[list[tuple[int, float]]] = []
    for place, (_, text) in enumerate(items):
        words = terms(text)
        weights = {}
        for t, n in Counter(words).items():
            rare = np.log1p((number - frequency[t] + 0.5) / (frequency[t] + 0.5))
            weights[t] = rare * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean))
        own = sum(weights.values())
        for t, weight in weights.items():
            if t not in vocabulary:
                vocabulary[t] = len(lists)
                lists.append([])
            lists[vocabulary[t]].append((place, weight / own))
    places = np.array([p for x in lists for p, _ in x], np.int64)
    weights = np.array([w for x in lists for _, w in x])
    starts = np.cumsum([0, *map(len, lists)])
    owner = np.repeat(np.arange(len(lists)), np.diff(starts))
    first = np.ones(len(places), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (places[1:] // RANGE != places[:-1] // RANGE)
    cuts = np.flatnonzero(first)
    maxima = np.maximum.reduceat(weights, cuts) if len(cuts) else np.empty(0)
    highest = np.maximum.reduceat(weights, starts[:-1]) if len(lists) else np.empty(0)
    block_starts = np.searchsorted(owner[cuts], np.arange(len(lists) + 1))
    blocks = places[cuts] // RANGE
    by_rank = np.argsort(highest, kind="stable")
    rank = np.empty_like(by_rank)
    rank[by_rank] = np.arange(len(by_rank))
    keys = owner[cuts] * -(-len(items) // RANGE) + blocks
    return Index(items, vocabulary, starts, places, weights, block_starts, blocks, keys, maxima, highest, rank, by_rank, passage)


def _spans(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all entries of ``keys``, index of the key of each)."""
    return _ranges(starts[keys], starts[keys + 1] - starts[keys])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of the ranges one after the other, index of the range of each)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + (starts - np.cumsum(sizes) + sizes)[owner], owner


def retrieve(index: Index, passages: np.ndarray, found: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(passage, place of item, score) of all scores of ``least`` or more.

    ``found`` are the distinct terms of each of ``passages``, by rising highest weight.
    Block-max WAND, on many passages of a text at once: of a passage's terms, those of
    low weight that cannot reach a part of ``least`` together open no list.  Blocks of
    the others' lists stay where their largest weights, and those terms' highest ones,
    add up to ``least``, and are scored where the largest weights of all terms in that
    very block still do.
    """
    least -= 1e-9
    tops = index.highest[found]
    sums = np.cumsum(tops)
    first = np.concatenate(([True], passages[1:] != passages[:-1]))
    nth = np.cumsum(first) - 1
    upto = sums - (sums - tops)[first][nth]
    opened = upto >= least * CLOSED
    closed = np.zeros(nth[-1] + 1)
    np.maximum.at(closed, nth[~opened], upto[~opened])
    entries, owner = _spans(index.block_starts, found[opened])
    number = -(-len(index.items) // RANGE)
    bound = np.bincount(nth[opened][owner] * number + index.blocks[entries], index.maxima[entries], len(closed) * number)
    cells = np.flatnonzero(bound >= least - np.repeat(closed, number))
    bound = bound[cells]
    if not len(cells):
        return []
    out = []
    # the same with the block's weights for the unopened terms, for the cells left
    ends = np.append(np.flatnonzero(first)[1:], len(found))
    rest, owner = _ranges(np.concatenate(([0], ends[:-1]))[cells // number], np.bincount(nth[~opened], minlength=len(ends))[cells // number])
    wanted = found[rest] * number + cells[owner] % number
    keys = np.minimum(np.searchsorted(index.block_keys, wanted), len(index.block_keys) - 1)
    bound += np.bincount(owner, np.where(index.block_keys[keys] == wanted, index.maxima[keys], 0.0), len(cells))
    for cell in cells[bound >= least].tolist():
        k, block = divmod(cell, number)
        mine = found[ends[k - 1] if k else 0 : ends[k]]
        entries, _ = _spans(index.starts, mine)
        entries = entries[index.places[entries] // RANGE == block]
        scores = np.bincount(index.places[entries] - block * RANGE, index.weights[entries], RANGE)
        for i in np.flatnonzero(scores >= least).tolist():
            out.append((int(passages[ends[k] - 1]), block * RANGE + i, float(scores[i])))
    return out


def overlap(part: list[str], words: list[str]) -> float:
    """Share of the part's words that ``words`` has in order, in runs of two or more; 1 for no words."""
    if not part:
        return 1.0
    runs = SequenceMatcher(None, part, words, autojunk=False).get_matching_blocks()
    return sum(r.size for r in runs if r.size > 1 or len(part) == 1) / len(part)


def hits(index: Index, text: str | None, least: float, least_overlap: float) -> list[tuple]:
    """(item_id, from word, to word, score, question overlap, answer overlap) of a whole text.

    Passages overlap by half, so three quarters or more of an item that stands in the
    text stand in a passage; the overlap is taken there and half a passage around.
    """
    words = terms(text)
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int64, len(words))
    if not (ids >= 0).any():
        return []
    step = index.passage // 2
    number = max(1, -(-(len(ids) - step) // step))
    at = np.flatnonzero(ids >= 0)
    both = np.concatenate((at // step, at // step - 1))
    there = (both >= 0) & (both < number)
    size = len(index.highest)
    # terms by rank of their highest weight, so that one sort orders them within passages
    pairs = np.unique(both[there] * size + np.concatenate((index.rank[ids[at]],) * 2)[there])
    best: dict[int, tuple] = {}
    cuts = np.searchsorted(pairs, np.arange(0, number + CHUNK, CHUNK) * size)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a == b:
            continue
        for j, place, score in retrieve(index, pairs[a:b] // size, index.by_rank[pairs[a:b] % size], least):
            if place in best and score <= best[place][3]:
                continue
            a, b = j * step, min(len(words), (j + 2) * step)
            wide = words[max(0, a - step) : b + step]
            item_id, item_text = index.items[place]
            question, answer = (overlap(p, wide) for p in parts(item_text))
            if min(question, answer) >= least_overlap:
                best[place] = (item_id, a, b, score, question, answer)
    return [best[k] for k in sorted(best)]


_WORDS = "item_id long, text string, words array<string>"


def indexes(items: DataFrame, most: int = INDEX_ITEMS) -> Iterator[Index]:
    """Indexes of all ``items`` (item_id, text), about ``most`` items each, with common statistics.

    What a task holds of them is bounded by ``most`` and ``INDEX_CHARS``.  Words and
    lengths are counted over all items; one block of items is fetched at a time.  Items
    are apart by length, so that passages are as wide as an index's own items need.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([terms(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, words], names=["item_id", "text", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    halvings = F.ceil(F.log2(F.greatest(F.size("words") / PASSAGE, F.lit(1.0))))
    rows = rows.mapInArrow(split, _WORDS).withColumn("passage", (F.pow(F.lit(2), halvings) * PASSAGE).cast("int"))
    rows = staged(rows, "items")
    total, length = rows.agg(F.count("*"), F.avg(F.size("words"))).first()
    counted = rows.select(F.explode(F.array_distinct("words")).alias("t")).groupBy("t").count()
    widths = rows.groupBy("passage").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy("passage")
    for width in widths.collect():  # a row for each doubling of length
        blocks = max(-(-width.n // most), -(-width.chars // INDEX_CHARS))
        for block in range(blocks):
            own = rows.filter((F.col("passage") == width.passage) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block))
            mine = own.select(F.explode("words").alias("t")).distinct()
            frequency = {r[0]: r[1] for r in counted.join(mine, "t").collect()}
            held = [(r.item_id, r.text) for r in own.select("item_id", "text").collect()]
            yield build(held, total, max(1.0, float(length)), frequency, width.passage)


SCHEMA = (
    "item_id long, from_word int, to_word int, score double, question_overlap double, answer_overlap double"
)


def contaminated(
    docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP
) -> DataFrame:
    """doc_id, item_id, the best passage (words from, to), its score and overlaps, for every leak.

    Null or empty texts have none; items without words are never found; repeated rows
    and items give rows of their own; no rows or no items, no rows.  Documents are
    read once for every ``INDEX_ITEMS`` items and every doubling of their length, and
    never shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = f"doc_id long, {SCHEMA}"
    found = None
    for index in indexes(items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    out = [
                        (doc_id, *row)
                        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        for row in hits(held.value, text, least, least_overlap)
                    ]
                    if out:
                        yield _batch(out)

        one = rows.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(
    docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP
) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, with all their columns."""
    at = docs.columns.index("text")
    for index in indexes(items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    kept = [not hits(held.value, t, least, least_overlap) for t in batch.column(at).to_pylist()]
                    yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    names = ["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
