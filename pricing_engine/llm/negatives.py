"""Hard negatives: rows of another label that score close below an anchor's positives.

Rows lie in Parquet blocks along a Hilbert curve through their vectors.  Each block,
and each tray of blocks, has a zone map: least and greatest value of every dimension.
Interval arithmetic on a zone map bounds the scores of all its rows for an anchor, so
an anchor reads only the blocks whose bounds meet one of its score windows.  Anchors
travel in packs of neighbours along the curve; a pack is sent to each tray that one
of its anchors must read, and a block is multiplied only with the anchors that need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pricing_engine.llm.hilbert import hilbert_keys
from pricing_engine.session import staged

BITS = 8  # of each dimension in the curve's key
ROWS = 1024  # of a block; a row's number in its block takes 10 bits
BLOCKS = 64  # of a tray
PACK = 256  # anchors that travel together; trays whose zone maps do
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_BLOCK = (
    "block long, tray long, dims int, ids array<long>, labels array<long>, picked array<boolean>, "
    "xs array<long>, lows array<long>, highs array<long>"
)
_ANCHOR = "uid long, anchor_id long, dims int, label long, x array<long>, windows array<struct<low:long,high:long>>"
_PACKED = "dims int, uids array<long>, wanted array<long>, anchors array<long>, window_lows array<long>, window_highs array<long>, widths array<int>"
_FOUND = "uid long, place int, score long, found_id long, found_uid long"


def whole_vectors(vector: str) -> Column:
    """True where ``vector`` is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def in_steps(vector: str, steps: int = 256) -> Column:
    """Each component as the whole number of steps below it."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(steps))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; an error if they may not fit a long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products of these vectors do not fit a long")
    return a @ b.T


def score_bounds(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of all vectors between ``lows`` and ``highs`` (a zone a row)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, lows) + products(down, highs), products(up, highs) + products(down, lows)


def _matrix(values: pa.ListScalar | pa.Array, dims: int) -> np.ndarray:
    flat = values.values if isinstance(values, pa.ListScalar) else values
    array = flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return array.reshape(-1, dims) if dims else array.reshape(0, 0)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their key on the curve, scaled to the least and greatest value of each dimension."""
    spread = rows.select("dims", F.posexplode("x")).groupBy("dims", "pos").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in spread.collect():  # a row a dimension
        low, high = edges.setdefault(r.dims, (np.zeros(r.dims), np.zeros(r.dims)))
        low[r.pos], high[r.pos] = r.a, r.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            keys: list[bytes] = [b""] * batch.num_rows
            for d in np.unique(dims):
                if d:
                    own = np.flatnonzero(dims == d)
                    x = _matrix(batch.column(4).take(pa.array(own)).flatten(), d).astype(np.float64)
                    low, high = edges[d]
                    cells = np.floor((x - low) / (high - low + 1) * (1 << BITS)).clip(0, (1 << BITS) - 1)
                    for i, key in zip(own, hilbert_keys(cells.astype(np.uint32), BITS)):
                        keys[i] = key.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("key", BinaryType())]))


def blocks_along_curve(rows: DataFrame) -> DataFrame:
    """Staged blocks of rows (vec_id, label, dims, picked, x) in the order of the curve.

    Keys that very many rows share are split by vec_id, so no range grows with a mass
    of equal vectors.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _keyed(rows).repartitionByRange(parts, "dims", "key", "vec_id").sortWithinPartitions("dims", "key", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number, held, dims = 0, [], None

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            ids, labels, picked, xs = ([x for part in column for x in part] for column in zip(*held))
            x = np.array(xs, np.int64).reshape(len(ids), dims)
            zone = [x.min(axis=0), x.max(axis=0)]
            values = [first + number, first + number // BLOCKS, dims, ids, labels, picked, x.ravel(), *zone]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 3]
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in _BLOCK.split(", ")])

        for whole in batches:
            at = 0
            sizes = whole.column(2).to_numpy()
            while at < whole.num_rows:
                have = sum(len(h[0]) for h in held)
                if held and (have == ROWS or sizes[at] != dims):
                    yield flush()
                    have = 0
                dims = int(sizes[at])
                end = at + int(np.argmax(np.append(sizes[at:], -1) != dims))
                part = whole.slice(at, min(end - at, ROWS - have))
                held.append([part.column(i).to_pylist() for i in (0, 1, 3)] + [part.column(4).flatten().to_numpy()])
                at += part.num_rows
        if held:
            yield flush()

    return staged(ranged.select("vec_id", "label", "dims", "picked", "x").mapInArrow(run, _BLOCK), "blocks")


def _anchors(blocks: DataFrame, k: int) -> DataFrame:
    """The picked rows, each with a window from the ``k``-th best score of its own label in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dims, ids, labels, picked, xs in zip(*(batch.column(c) for c in ("block", "dims", "ids", "labels", "picked", "xs"))):
                own = np.flatnonzero(picked.values.to_numpy(zero_copy_only=False))
                if not len(own):
                    continue
                x, label = _matrix(xs, dims.as_py()) if dims.as_py() else np.zeros((len(ids), 0), np.int64), labels.values.to_numpy()
                scores = products(x[own], x)
                lows = []
                for i, row in zip(own, scores):
                    same = label == label[i]
                    same[i] = False
                    best = np.sort(row[same])[::-1][:k]
                    lows.append(int(best[-1]) if len(best) == k else _LEAST)
                yield pa.RecordBatch.from_pylist(
                    [
                        {"uid": (block.as_py() << 10) + int(i), "anchor_id": ids[int(i)].as_py(), "dims": dims.as_py(), "label": int(label[i]), "x": x[i].tolist(), "windows": [{"low": low, "high": _MOST}]}
                        for i, low in zip(own, lows)
                    ],
                    _ARROW_ANCHOR,
                )

    return blocks.select("block", "dims", "ids", "labels", "picked", "xs").mapInArrow(run, _ANCHOR)


_LONGS = pa.list_(pa.int64())
_WINDOWS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
_ARROW_ANCHOR = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("dims", pa.int32()), ("label", pa.int64()), ("x", _LONGS), ("windows", _WINDOWS)])
_PACK_TYPES = [pa.int32(), _LONGS, _LONGS, _LONGS, _LONGS, _LONGS, pa.list_(pa.int32())]
_PACK_NAMES = [f.split()[0] for f in _PACKED.split(", ")]


def _packed(anchors: DataFrame) -> DataFrame:
    """Anchors in packs of neighbours: row numbers follow the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            windows = [w for a in held for w in a["windows"]]
            values = [
                held[0]["dims"], [a["uid"] for a in held], [a["label"] for a in held], [v for a in held for v in a["x"]],
                [w["low"] for w in windows], [w["high"] for w in windows], [len(a["windows"]) for a in held],
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PACK_TYPES)], names=_PACK_NAMES)

        for batch in batches:
            for anchor in batch.to_pylist():
                if held and (len(held) == PACK or anchor["dims"] != held[0]["dims"]):
                    yield flush()
                    held = []
                held.append(anchor)
        if held:
            yield flush()

    ordered = anchors.select("uid", "dims", "label", "x", "windows").repartitionByRange("uid").sortWithinPartitions("uid")
    return ordered.mapInArrow(run, _PACKED)


class _Pack:
    """Anchors with their windows, as arrays."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        self.dims = row["dims"].as_py()
        self.uids, self.wanted, self.lows, self.highs, self.widths = (
            row[c].values.to_numpy(zero_copy_only=False) for c in ("uids", "wanted", "window_lows", "window_highs", "widths")
        )
        self.x = _matrix(row["anchors"], self.dims) if self.dims else np.zeros((len(self.uids), 0), np.int64)
        ends = np.cumsum(self.widths)
        self.starts = ends - self.widths
        self.low = np.minimum.reduceat(self.lows, self.starts)
        self.high = np.maximum.reduceat(self.highs, self.starts)

    def part(self, rows: np.ndarray) -> list:
        of = np.concatenate([np.arange(s, s + w) for s, w in zip(self.starts[rows], self.widths[rows])])
        return [self.dims, self.uids[rows], self.wanted[rows], self.x[rows].ravel(), self.lows[of], self.highs[of], self.widths[rows]]


def _visits(packs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The anchors that each tray must be read for: (tray, pack)."""
    zones = blocks.select("tray", "dims", F.posexplode(F.arrays_zip("lows", "highs")))
    zones = zones.groupBy("tray", "dims", "pos").agg(F.min("col.lows").alias("low"), F.max("col.highs").alias("high"))
    dims = F.sort_array(F.collect_list(F.struct("pos", "low", "high")))  # a zone map, not rows
    zones = zones.groupBy("tray", "dims").agg(dims.alias("zone")).select("tray", "dims", "zone.low", "zone.high")
    empty = blocks.filter("dims = 0").select("tray", "dims", "lows", "highs").distinct().toDF("tray", "dims", "low", "high")
    zones = staged(zones.unionByName(empty), "zones")
    groups = -(-zones.count() // PACK)
    shelf = F.pmod(F.xxhash64("tray"), F.lit(max(1, groups))).cast("int")
    shelves = zones.groupBy(shelf.alias("shelf"), "dims").agg(F.collect_list(F.struct("tray", "low", "high")).alias("trays"))
    met = packs.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1)))).alias("shelf")).join(shelves, ["shelf", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                pack, trays = _Pack(row), row["trays"].values
                lows, highs = (_matrix(trays.field(c).flatten(), pack.dims) if pack.dims else np.zeros((len(trays), 0), np.int64) for c in ("low", "high"))
                least, most = score_bounds(pack.x, lows, highs)
                needed = (most >= pack.low[:, None]) & (least <= pack.high[:, None])
                for at in np.flatnonzero(needed.any(axis=0)):
                    values = [trays.field("tray")[int(at)].as_py(), *pack.part(np.flatnonzero(needed[:, at]))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), *_PACK_TYPES])], names=["tray", *_PACK_NAMES])

    return met.select(*_PACK_NAMES, "trays").mapInArrow(run, f"tray long, {_PACKED}")


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` entries of each owner: highest score, then smallest id."""
    order = np.lexsort((uid, ids, -score, owner))
    own = owner[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, int)
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[place < k]


def _searched(visits: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """For each anchor and window the first ``k`` rows of the same or of another label in it."""
    visits = staged(visits, "visits")
    read = blocks.join(visits.select("tray").distinct(), "tray", "left_semi")
    kind = F.lit(0).alias("kind")
    both = read.select("tray", kind, "block", "dims", "ids", "labels", "xs", "lows", "highs").unionByName(
        visits.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = both.repartition(parts, "tray").sortWithinPartitions("tray", "kind", "block")

    def search(pack: _Pack, held: list[tuple]) -> pa.RecordBatch:
        lows, owners = pack.lows.copy(), np.repeat(np.arange(len(pack.uids)), pack.widths)
        best = [np.empty(0, np.int64) for _ in range(4)]  # window, score, id, uid
        bounds = score_bounds(pack.x, np.stack([h[4] for h in held]), np.stack([h[5] for h in held]))
        for at in np.argsort(-bounds[1].max(axis=0), kind="stable"):
            block, ids, labels, x = held[at][:4]
            needed = (bounds[1][:, at] >= np.minimum.reduceat(lows, pack.starts)) & (bounds[0][:, at] <= pack.high)
            rows = np.flatnonzero(needed)
            if not len(rows):
                continue
            scores = products(pack.x[rows], x)
            uids = (block << 10) + np.arange(len(ids))
            alike = (pack.wanted[rows, None] == labels) == same
            alike &= pack.uids[rows, None] != uids
            place = np.full(len(pack.uids), -1)
            place[rows] = np.arange(len(rows))
            of = np.flatnonzero(needed[owners])  # windows of the needed anchors
            fresh = [best]
            for w in range(int(pack.widths.max())):  # the w-th window of all anchors at once
                nth = of[of - pack.starts[owners[of]] == w]
                mine = place[owners[nth]]
                inside = alike[mine] & (scores[mine] >= lows[nth, None]) & (scores[mine] <= pack.highs[nth, None])
                a, b = np.nonzero(inside)
                fresh.append([nth[a], scores[mine[a], b], ids[b], uids[b]])
            best = [np.concatenate(c) for c in zip(*fresh)]
            kept = _best(*best, k)
            best = [c[kept] for c in best]
            full = np.bincount(best[0], minlength=len(lows)) == k
            worst = np.full(len(lows), _MOST)
            np.minimum.at(worst, best[0], best[1])
            lows = np.where(full, np.maximum(lows, worst), lows)
        window, score, ids, uids = best
        values = [pack.uids[owners[window]], (window - pack.starts[owners[window]]).astype(np.int32), score, pa.array(ids, mask=ids == _MOST), uids]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=[f.split()[0] for f in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tray = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                if row["tray"].as_py() != tray:
                    held, tray = [], row["tray"].as_py()
                if row["kind"].as_py() == 0:
                    dims = row["dims"].as_py()
                    ids = row["ids"].values.fill_null(_MOST).to_numpy()  # a null id comes last
                    x = _matrix(row["xs"], dims) if dims else np.zeros((len(ids), 0), np.int64)
                    zone = [_matrix(row[c], dims)[0] if dims else np.zeros(0, np.int64) for c in ("lows", "highs")]
                    held.append((row["block"].as_py(), ids, row["labels"].values.to_numpy(), x, *zone, dims))
                else:
                    pack = _Pack(row)
                    own = [h for h in held if h[6] == pack.dims]
                    if own:
                        yield search(pack, own)

    found = sorted_.mapInArrow(run, _FOUND)
    first = Window.partitionBy("uid", "place").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_uid")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` holds vec_id, label and x, a vector of whole numbers; ``anchors`` says of
    a row whether it is an anchor.  A row's score is its inner product with the
    anchor; higher scores come first, ties by smaller vec_id.  For each anchor and each
    of its first ``positives`` rows of the same label: the first ``negatives`` rows of
    other labels that score from ``least`` to ``most`` per cent of the positive.

    Rows with a null label or x take no part, nor do vectors with null components.  A
    null vec_id is no anchor's and comes last among ties; repeated rows are rows of
    their own, also as partners of each other.  Vectors are compared with those of
    their length.  Positives of a negative score have no negatives.  No rows give no
    rows.  Vectors whose inner products may not fit a long are an error.
    """
    usable = F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull())
    rows = rows.filter(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.size("x").alias("dims"), F.coalesce(anchors, F.lit(False)).alias("picked"), F.col("x").cast("array<long>").alias("x"),
    )
    blocks = blocks_along_curve(rows)
    picked = staged(_anchors(blocks, positives), "anchors")
    best = _searched(_visits(_packed(picked), blocks), blocks, True, positives)
    best = staged(best.select("uid", "rank", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # no negative lies in the window of a positive below zero
    low = F.expr(f"positive_score * {least} DIV 100 + IF(positive_score * {least} % 100 > 0, 1, 0)")
    high = F.expr(f"positive_score * {most} DIV 100 - IF(positive_score * {most} % 100 < 0, 1, 0)")
    windows = best.filter(low <= high).groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("all")
    )  # as many as positives
    windows = windows.select("uid", F.expr("transform(all, w -> struct(w.low AS low, w.high AS high))").alias("windows"), F.col("all.rank").alias("ranks"))
    aimed = picked.drop("windows").join(windows, "uid")
    found = _searched(_visits(_packed(aimed), blocks), blocks, False, negatives)
    found = found.join(windows.select("uid", "ranks"), "uid").select(
        "uid", F.col("rank").alias("n"), "found_id", "score", F.element_at("ranks", F.col("place") + 1).alias("rank")
    )
    named = found.join(best, ["uid", "rank"]).join(picked.select("uid", "anchor_id"), "uid")
    return named.select(
        "anchor_id", "positive_id", F.col("n").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
