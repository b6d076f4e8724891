"""SimHash near-dedup: 64-bit fingerprints, linked exactly through vantage-point trees.

Two fingerprints within ``radius`` bits agree on one of ``radius + 1`` bands of their
bits (a band that differs costs a bit).  So each band has a tree of its own, over the
Hamming distance of that band's bits, in which linked fingerprints lie at distance
zero of each other, and the triangle bound ``|d(x, v) - d(y, v)| <= d(x, y)`` sends
them to the same side of every vantage point ``v``.  Shards that are still too large
(near copies in masses) are split on by the distance of all 64 bits; there linked
fingerprints may be ``radius`` apart, so those within ``radius`` of a boundary are
also sent to the shard beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricing_engine.llm.common import connected, lower_ascii, shingle_hashes, slices, words_of
from pricing_engine.session import staged

BITS = 64
RADIUS = 4
SHINGLE = 4
SAMPLE = 20_000  # fingerprints that vantage points and medians are taken from, at most
SHARD = 1_000  # fingerprints of a shard, about, by the sample's measure
MAX_DEPTH = 40


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def text_fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Fingerprint of a whole text: words of its lower-cased (A-Z) form, shingles of ``width``."""
    return fingerprint(shingle_hashes(words_of(lower_ascii(text)), width)) if text else 0


def with_fingerprints(docs: DataFrame, name: str, width: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` and the fingerprint of ``text`` as a signed long ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                marks = np.array([text_fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(marks)], names=[*keep, name])

    schema = docs.select(*keep).schema.add(name, "long")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def _distance(values: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(vantage)).astype(np.int16)


def band_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks of ``radius + 1`` runs of bits, of near equal length."""
    edges = [round(i * bits / (radius + 1)) for i in range(radius + 2)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


class Tree:
    """A vantage-point tree: nodes hold a vantage, its mask, a boundary and a slack.

    Built on the driver from a bounded sample; only its nodes are kept.
    """

    def __init__(self, sample: np.ndarray, mask: int, radius: int, shard: float, scale: float) -> None:
        """``scale``: fingerprints that one of the sample stands for."""
        self.nodes: list[tuple[int, int, int, int, int, int]] = []  # vantage, mask, boundary, slack, near, far
        self.leaves = 0
        self.root = self._grow(sample, mask, 0, radius, shard / scale, 0)

    def _grow(self, points: np.ndarray, mask: int, slack: int, radius: int, most: float, depth: int) -> int:
        if len(points) > most and len(points) > 1 and depth < MAX_DEPTH:
            for at, by, reach in ((mask, slack, 0),) if slack else ((mask, 0, 0), ((1 << BITS) - 1, radius, 0)):
                split = self._split(points, at, by)
                if split:
                    vantage, boundary, near, far = split
                    k = len(self.nodes)
                    self.nodes.append((0, 0, 0, 0, 0, 0))
                    a = self._grow(points[near], at, by, radius, most, depth + 1)
                    b = self._grow(points[far], at, by, radius, most, depth + 1)
                    self.nodes[k] = (vantage, at, boundary, by, a, b)
                    return k
        self.leaves += 1
        return -self.leaves

    @staticmethod
    def _split(points: np.ndarray, mask: int, slack: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
        """The most even of a few vantages' splits at their median distance.

        Near: distance <= boundary + slack; far: distance > boundary - slack.  No
        split is taken that leaves more than 3/4 of the points on a side.
        """
        best, masked = None, points & np.uint64(mask)
        for vantage in dict.fromkeys(masked[:: max(1, len(masked) // 8)][:8].tolist()):
            d = _distance(masked, vantage)
            for boundary in {int(np.median(d)), int(np.median(d)) - 1}:
                near, far = d <= boundary + slack, d > boundary - slack
                worst = max(near.sum(), far.sum())
                if best is None or worst < best[0]:
                    best = worst, vantage, boundary, near, far
        return best[1:] if best and best[0] <= 0.75 * len(points) else None

    def shards(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indices of the points to look for there), every point in one leaf or more."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node, rows
                continue
            vantage, mask, boundary, slack, near, far = self.nodes[node]
            d = _distance(points[rows] & np.uint64(mask), vantage)
            todo.append((near, rows[d <= boundary + slack]))
            todo.append((far, rows[d > boundary - slack]))


def _links(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
    """(members, first member) of the groups of over one point within ``radius`` steps.

    A group is grown by comparing each new member with the points that are in no
    group yet, so masses of near copies cost one comparison each, not a square.
    """
    left = np.unique(points)
    while len(left):
        first, left = int(left[0]), left[1:]
        frontier, members = [first], []
        while frontier and len(left):
            near = np.bitwise_count(left ^ np.uint64(frontier.pop())) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                frontier.extend(found.tolist())
                members.append(found)
        if members:
            yield np.concatenate(members), first


def linked_fingerprints(
    marks: DataFrame, name: str, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD
) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``radius`` bits, through any chain.

    ``marks`` holds distinct fingerprints (signed longs) in column ``name``.  Inside
    a shard only links to the first of each group are given, so the links grow with
    the fingerprints, not with the pairs.  The driver sees a sample of fixed size;
    shards are dealt out by key and read as a sorted stream, one in memory at a time.
    """
    spark = marks.sparkSession
    total = marks.count()
    picked = marks.orderBy(F.xxhash64(name)).limit(sample).collect()
    known = np.array([r[0] for r in picked], np.int64).view(np.uint64)
    scale = max(1.0, total / max(1, len(known)))
    trees = [Tree(known, mask, radius, shard, scale) for mask in band_masks(radius)]
    # boundaries of a tree differ from those of a band's own: leaves are numbered over all trees
    offsets = np.cumsum([0, *[t.leaves + 1 for t in trees]]).tolist()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree, offset in zip(trees, offsets):
                for leaf, rows in tree.shards(points):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), offset + leaf, np.int64)), pa.array(points[rows].view(np.int64))],
                        names=["shard", "mark"],
                    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for shards, marks_ in ((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches):
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for part, own in zip(np.split(marks_, cuts), np.split(shards, cuts)):
                if not len(own):
                    continue
                if current is not None and own[0] != current:
                    yield from links(held)
                    held = []
                current = own[0]
                held.append(part)
        if held:
            yield from links(held)

    def links(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        groups = list(_links(np.concatenate(parts).view(np.uint64), radius))
        if groups:
            a = np.concatenate([g for g, _ in groups]).view(np.int64)
            b = np.concatenate([np.full(len(g), f, np.uint64) for g, f in groups]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    del spark
    routed = marks.select(F.col(name)).mapInArrow(route, "shard long, mark long")
    sorted_ = routed.repartition("shard").sortWithinPartitions("shard", "mark")
    return sorted_.mapInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, mark (fingerprint, signed) and component_id of every row of ``docs``.

    A component holds the documents that links of ``radius`` bits or fewer connect;
    its id is the least doc_id in it.  Texts that are null or have no word have
    fingerprint zero, linked like any other.  Repeated rows and ids are rows of
    their own in one component or more; a component without any id has a null one.
    No rows give no rows.  Equal fingerprints are reduced to one before any search,
    so a group of exact copies of any size costs one fingerprint.
    """
    marked = staged(with_fingerprints(docs, "mark", width, tuple(dict.fromkeys(["doc_id", *keep]))), "marks")
    distinct = staged(marked.groupBy("mark").agg(F.min("doc_id").alias("least")), "distinct")
    links = linked_fingerprints(distinct.select("mark"), "mark", radius)
    roots = connected(links, "a", "b")
    rooted = distinct.join(roots, distinct["mark"] == roots["node"], "left").select(
        "mark", F.coalesce("root", "mark").alias("root"), "least"
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("mark", "root").join(least, "root").withColumnRenamed("mark", "own")
    return marked.join(named, marked["mark"] == named["own"]).select(
        *dict.fromkeys(["doc_id", *keep]), "mark", "root", "component_id"
    )
