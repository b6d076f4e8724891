"""N-gram Jaccard join with adaptive multi-match prefixes: documents whose shingle sets overlap.

All sets are sorted by one order of shingles, rare ones first.  Two sets that share at
least ``a`` of their ``n`` and ``m`` shingles share at least ``l`` among the first
``n - a + l`` and ``m - a + l``, for every ``l`` up to ``a``.  A longer prefix meets
more lists, but asks for more matches, so each document takes the ``l`` whose lists
and verifications cost least by estimate.  Every pair that passes is verified on whole
sets, so the links are exact whatever the order and the levels are.

Equal sets are one set from the start.  A mass of near copies shares a few common
shingles: the members of such a list are first compared with its hub, the set with
the fewest rarer shingles before it.  Sets that links connect need no comparison with
each other, so only pairs of different classes are joined afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from pricing_engine.llm.common import connected, fresh_name, slices
from pricing_engine.session import staged

TABLED = 1 << 18  # most frequent shingles, whose counts order them; the others come first, by hash
LEVELS = 4  # matches that a pair may have to show
HOT = 16  # count from which a shingle's list is dealt out in parts and has a hub
_SLICE = 600_000  # shingles counted at a time
_BYTES = 2_000_000  # of texts taken up at a time
_BITS = 1 << 23  # of the table that tells which texts to read again
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_FACTORS = np.random.default_rng(11).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


class _WordHashes(dict):
    """Hashes of words, kept for words to come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 11)
        return value


def shingle_set(text: bytes | None, width: int, hashes: _WordHashes | None = None) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the runs of ``width`` words of a UTF-8 text, A-Z lowered.

    Words are runs without ASCII blanks.  Fewer words are one run; no words, none.
    """
    words = text.lower().split() if text else []  # of bytes: ASCII letters and blanks only
    if not words:
        return np.empty(0, np.uint64)
    known = _WordHashes() if hashes is None else hashes
    own = np.array([known[w] for w in words], np.uint64)
    runs, length = max(1, len(own) - width + 1), min(width, len(own))
    mixed = np.full(runs, np.uint64(length))
    for k in range(length):
        part = own[k : k + runs] * _FACTORS[k % 64]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1] + part
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[1]
    mixed = (mixed ^ (mixed >> np.uint64(27))) * _MIX[2]
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


_Make = Callable[[pa.RecordBatch, list[np.ndarray]], Iterator[pa.RecordBatch]]


def _over_sets(rows: DataFrame, width: int, schema: StructType | str, make: _Make) -> DataFrame:
    """``make`` applied to slices of ``rows`` with the sets of their first column, texts as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for whole in batches:
            for batch in slices(whole, whole.schema.names[0], _BYTES):
                yield from make(batch, [shingle_set(t, width, hashes) for t in batch.column(0).to_pylist()])

    return rows.mapInArrow(run, schema)


@dataclass
class Order:
    """Which shingles come last, and after which others: a table of bounded size."""

    bits: int  # of a shingle's hash that tell its bucket; the 32 below them tell it there
    ids: np.ndarray
    places: np.ndarray
    counts: np.ndarray
    others: float = 1.0  # mean count of the shingles that are not in the table

    def sorted(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles in the order, and how often each is counted, by the mean for those not in the table."""
        ids = shingles >> np.uint64(32 - self.bits)
        at = np.searchsorted(self.ids, ids)
        at[at == len(self.ids)] = 0
        tabled = self.ids[at] == ids if len(self.ids) else np.zeros(len(ids), bool)
        place = np.where(tabled, self.places[at], 0) if len(self.ids) else np.zeros(len(ids), np.int64)
        order = np.argsort(place, kind="stable")
        counts = np.where(tabled, self.counts[at], self.others) if len(self.ids) else np.full(len(ids), self.others)
        return shingles[order], counts[order]


def _bits(spark: SparkSession) -> int:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(20, max(8, math.ceil(math.log2(4 * parts))))


_PACK = "bucket int, ids binary, counts binary"


def _scanned(rows: DataFrame, width: int, key: str, size: str) -> DataFrame:
    """For each of ``rows`` (text as binary, then what to keep) what is kept, key and size of its set.

    Between them stand counts of shingles, by bucket, of slices of the texts.
    """
    bits, kept = _bits(rows.sparkSession), StructType([StructField(f.name, f.dataType) for f in rows.schema.fields[1:]])
    schema = StructType([*kept.fields]).add(key, "binary").add(size, "long")
    for field in StructType.fromDDL(_PACK).fields:
        name = field.name
        while name.lower() in {f.name.lower() for f in schema.fields}:
            name += "_"
        schema = schema.add(name, field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, count, seen = _WordHashes(), [], 0, set()
        empty = pa.RecordBatch.from_pylist([], to_arrow_schema(schema))

        def row(columns: list[pa.Array], first: int) -> pa.RecordBatch:
            n = len(columns[0])
            arrays = [pa.nulls(n, f.type) for f in empty.schema]
            arrays[first : first + len(columns)] = [c.cast(empty.schema[first + i].type) for i, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays(arrays, schema=empty.schema)

        def flush() -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(held), return_counts=True)
            buckets = shingles >> np.uint64(64 - bits)
            edges = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets))
            low = (shingles >> np.uint64(32 - bits)).astype("<u4")  # what is above 32 bits falls away
            number = np.minimum(counts, 65535).astype("<u2")
            values = [
                pa.array(buckets[edges[:-1]].astype(np.int32)),
                pa.array([low[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                pa.array([number[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
            ]
            return row(values, len(kept) + 2)

        for whole in batches:
            for batch in slices(whole, whole.schema.names[0], _BYTES):
                keys, sizes = [], []
                for text in batch.column(0).to_pylist():
                    shingles = shingle_set(text, width, hashes)
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                    sizes.append(len(shingles))
                    if len(shingles) and keys[-1] not in seen:  # copies count once in a slice
                        seen.add(keys[-1])
                        held.append(shingles)
                        count += len(shingles)
                    if count >= _SLICE:
                        yield flush()
                        held, count, seen = [], 0, set()
                yield row([*batch.columns[1:], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], 0)
        if held:
            yield flush()

    return staged(rows.mapInArrow(run, schema), "scanned")


def shingle_order(packs: DataFrame, tabled: int = TABLED) -> Order:
    """Counts of all shingles over all texts, of which the table keeps the most frequent.

    ``packs`` holds the counts of slices; buckets of hashes are counted in tasks, and
    each gives its share of the table.  A shingle is told by 32 bits and its bucket's:
    the order needs no more.
    """
    parts, bits = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")), _bits(packs.sparkSession)
    share = max(1, tabled >> bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, counts = None, [], []

        def most() -> Iterator[pa.RecordBatch]:
            known, at = np.unique(np.concatenate(ids), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            kept = np.flatnonzero(total > 1)
            kept = kept[np.lexsort((known[kept], -total[kept]))[:share]]
            rest = [len(known) - len(kept), int(total.sum() - total[kept].sum())]
            values = [bucket, known[kept].tobytes(), total[kept].tobytes(), *rest]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["bucket", "ids", "counts", "others", "counted"])

        for batch in batches:
            for b, i, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if b != bucket and ids:
                    yield from most()
                    ids, counts = [], []
                bucket = b
                ids.append(np.frombuffer(i, "<u4"))
                counts.append(np.frombuffer(c, "<u2"))
        if ids:
            yield from most()

    dealt = packs.repartition(parts, "bucket").sortWithinPartitions("bucket")
    rows = dealt.mapInArrow(count, f"{_PACK}, others long, counted long").collect()  # at most ``tabled`` shingles
    ids = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r.ids, "<u4").astype(np.uint64) | np.uint64(r.bucket << 32) for r in rows]])
    counts = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(r.counts, "<i8") for r in rows]])
    by_id = np.argsort(ids)
    ids, counts = ids[by_id], counts[by_id]
    places = np.empty(len(ids), np.int64)
    places[np.lexsort((ids, counts))] = np.arange(1, len(ids) + 1)
    others = sum(r.counted for r in rows) / max(1, sum(r.others for r in rows))
    return Order(bits, ids, places, counts, max(1.0, others))


@dataclass(frozen=True)
class Threshold:
    """Links are of ``whole`` times the intersection >= ``part`` times the union."""

    part: int
    whole: int

    def needed(self, n: int) -> int:
        """Least number of shingles that a set of ``n`` shares with any linked one."""
        return -(-self.part * n // self.whole)

    def needed_of_larger(self, n: int) -> int:
        """The same, with a linked one of ``n`` or more."""
        return -(-2 * self.part * n // (self.part + self.whole))

    def shared(self, a: str, b: str) -> Column:
        """Least number of shingles that linked sets of these sizes share."""
        both = self.part + self.whole
        return F.expr(f"({self.part} * ({a} + {b}) + {both - 1}) DIV {both}")

    def sizes_fit(self, a: str, b: str) -> Column:
        return F.least(a, b) * self.whole >= F.greatest(a, b) * self.part


def level_of(n: int, base: int, counts: np.ndarray, most: int) -> int:
    """The number of matches to ask for, by the cost of reading lists and of verifying.

    ``counts`` are the lengths of the lists in the order, as estimated; a candidate
    stands on as many of them as matches are asked for, and verifying one costs about
    an eighth of its shingles.
    """
    met = np.cumsum(counts - 1)
    ends = np.minimum(base + np.arange(1, most + 1), n) - 1
    costs = met[ends] * (1 + n / 8 / np.arange(1, most + 1))
    return int(np.argmin(costs)) + 1


POSTING = "token long, part int, parts int, key binary, n int, pos int, level int"


def postings(texts: DataFrame, width: int, order: Order, threshold: Threshold, levels: int = LEVELS) -> DataFrame:
    """A row for each shingle of a text's prefix, at its place in the order."""
    spark: SparkSession = texts.sparkSession
    held = spark.sparkContext.broadcast(order)  # bounded by the table

    def make(batch: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order, tokens, counts, sizes, chosen, keys = held.value, [], [], [], [], []
        for shingles in sets:
            n = len(shingles)
            if not n:
                continue
            own, seen = order.sorted(shingles)
            base = n - threshold.needed(n)
            level = level_of(n, base, seen, min(levels, threshold.needed(n)))
            depth = min(n, max(base + level, n - threshold.needed_of_larger(n) + levels))
            tokens.append(own[:depth])
            counts.append(seen[:depth])
            sizes.append((n, depth, level))
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
        if not tokens:
            return
        n, depth, level = np.array(sizes, np.int32).T
        of = np.repeat(np.arange(len(depth)), depth)
        place = np.arange(len(of)) - np.repeat(np.cumsum(depth) - depth, depth)
        counted = np.concatenate(counts)
        parts = np.where(counted >= HOT, np.ceil(counted / HOT), 1).astype(np.int32)
        mark = np.array([int.from_bytes(k[:4], "little") for k in keys], np.int64)
        columns = [
            pa.array(np.concatenate(tokens).view(np.int64)), pa.array((mark[of] % parts).astype(np.int32)), pa.array(parts),
            pa.array(keys, pa.binary()).take(pa.array(of)), pa.array(n[of]), pa.array(place.astype(np.int32)), pa.array(level[of]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in POSTING.split(", ")])

    return _over_sets(texts, width, POSTING, make)


def _lists(posted: DataFrame) -> DataFrame:
    """Postings of shingles that several sets have in their prefixes.

    The list of a frequent shingle is dealt out in parts; each other one lies whole in
    one place, so one exchange serves the search for repeated shingles and the lists.
    """
    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = posted.repartition(parts, "token", "part")
    mark = F.xxhash64(*posted.columns)
    several = dealt.groupBy("token", "part").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    rows = dealt.join(several, ["token", "part"]).filter("parts > 1 OR low <> high")
    return staged(rows.select("token", "part", "parts", "key", "n", "pos", "level").distinct(), "lists")


def _reach(n: str, own: str, other: str, threshold: Threshold, level: Column) -> Column:
    """Whether a place is in the prefix of a set of ``n`` for a pair of these sizes."""
    return F.col(own) < F.col(n) - threshold.shared(n, other) + level


def _hub_pairs(lists: DataFrame, threshold: Threshold) -> DataFrame:
    """(a, b): the sets of each frequent shingle's list with its hub."""
    hot = lists.filter("parts > 1")
    hubs = hot.groupBy("token").agg(F.min(F.struct("pos", "n", "key")).alias("hub"))
    met = hot.join(hubs.select("token", F.col("hub.n").alias("m"), F.col("hub.key").alias("b")), "token")
    close = _reach("n", "pos", "m", threshold, F.lit(LEVELS)) & threshold.sizes_fit("n", "m")
    return met.filter(close & (F.col("key") != F.col("b"))).select(F.col("key").alias("a"), "b").distinct()


def _open_pairs(lists: DataFrame, roots: DataFrame, threshold: Threshold) -> DataFrame:
    """(a, b): sets of different classes that share as many shingles of their prefixes as asked for.

    A pair comes up where the shortest prefixes for its sizes meet, and is held against
    the longer ones at once: both are read beside it, so no list is read for more
    matches.  The larger set of a pair (by size, then key) says how many.
    """
    shortest = F.expr(f"n - ({threshold.part} * n + {threshold.whole - 1}) DIV {threshold.whole}")
    rows = lists.filter(F.col("pos") <= shortest).join(roots, F.col("key") == F.col("node"), "left")
    rows = rows.select("token", "parts", "key", "n", "pos", "level", F.coalesce("root", "key").alias("root"))
    hot, mark = staged(rows.filter("parts > 1"), "hot"), F.xxhash64("root")
    unsettled = hot.groupBy("token").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high")
    rows = rows.filter("parts = 1").unionByName(hot.join(unsettled.select("token"), "token", "left_semi")).drop("parts")
    small = rows.toDF("token", "b", "m", "at", "own", "other")
    larger = F.struct("n", "key") > F.struct(F.col("m").alias("n"), F.col("b").alias("key"))
    meet = _reach("n", "pos", "m", threshold, F.lit(1)) & _reach("m", "at", "n", threshold, F.lit(1))
    pairs = rows.join(small, "token").filter(larger & (F.col("root") != F.col("other")) & threshold.sizes_fit("n", "m") & meet)
    pairs = staged(pairs.select(F.col("key").alias("a"), "b", "n", "m", "level").distinct(), "met")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    prefix = F.sort_array(F.collect_list(F.struct("pos", "token")))  # of a set's repeated shingles
    prefixes = staged(lists.join(ends, "key", "left_semi").groupBy("key").agg(prefix.alias("prefix")), "prefixes")
    for side in ("a", "b"):
        pairs = pairs.join(prefixes.select(F.col("key").alias(side), F.col("prefix").alias(f"prefix_{side}")), side)

    def head(side: str, n: str) -> Column:
        end = F.col(n) - threshold.shared("n", "m") + F.col("level")
        return F.transform(F.filter(f"prefix_{side}", lambda x: x["pos"] < end), lambda x: x["token"])

    return pairs.filter(F.size(F.array_intersect(head("a", "n"), head("b", "m"))) >= F.col("level")).select("a", "b")


def _marked(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """``texts`` (binary) whose hash may be a ``mark`` of ``needed``, by a table of bits of fixed size."""
    place = F.pmod("mark", F.lit(_BITS))
    bits = needed.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod(mark, {_BITS}) & 63))").alias("bit"))
    table = np.zeros(_BITS // 64, np.int64)
    for word, bit in bits.groupBy("word").agg(F.bit_or("bit")).toLocalIterator():
        table[word] = bit
    held = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy() % _BITS
            yield batch.select([0]).filter(pa.array(held.value[at >> 6] >> (at & 63) & 1 == 1))

    return texts.select("text", F.xxhash64("text").alias("mark")).mapInArrow(run, "text binary")


def _verified(pairs: DataFrame, marks: DataFrame, texts: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """The pairs that are linked; whole sets are made again for their texts only."""
    pairs = staged(pairs, "pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    needed = marks.join(keys, "key", "left_semi").groupBy("key").agg(F.min("mark").alias("mark")).select("mark")
    wanted = _marked(texts, needed)

    def make(batch: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "shingles"])

    found = _over_sets(wanted, width, "key binary, shingles array<long>", make)
    sets = found.dropDuplicates(["key"])
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    both = pairs.select("a", "b", F.size("set_a").alias("n"), F.size("set_b").alias("m"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return staged(both.filter(F.col("common") >= threshold.shared("n", "m")).select("a", "b"), "links")


def jaccard_classes(
    docs: DataFrame, width: int = 3, part: int = 90, whole: int = 100, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``keep`` columns, n_shingles and class_key of every row of ``docs``.

    Rows are linked if ``whole`` times the intersection of their sets of ``width``-word
    shingles is ``part`` times the union or more; rows have equal class_key if links
    connect them.  A text with fewer words is one shingle; null texts and those without
    words have no shingles and a null class_key, for they are linked with nothing.
    Equal sets are linked.  Repeated rows stay rows of their own.  No rows give no rows.
    """
    threshold = Threshold(part, whole)
    names = [fresh_name(docs.select(*keep), n) for n in ("n_shingles", "class_key")]
    mark, key = (fresh_name(docs.select(*keep), n) for n in ("mark", "key"))
    raw = F.col(text).cast("binary")
    texts = docs.select(raw.alias("text"))
    first = fresh_name(docs.select(*keep), "text_")
    scanned = _scanned(docs.select(raw.alias(first), *keep, F.xxhash64(raw).alias(mark)), width, key, names[0])
    bucket = scanned.columns[-3]
    sized = scanned.filter(F.col(bucket).isNull()).select(*scanned.columns[:-3])
    packs = scanned.filter(F.col(bucket).isNotNull()).select(*scanned.columns[-3:]).toDF("bucket", "ids", "counts")
    marks = sized.select(F.col(mark).alias("mark"), F.col(key).alias("key")).filter("key IS NOT NULL")
    lists = _lists(postings(texts, width, shingle_order(packs), threshold))
    links = _verified(_hub_pairs(lists, threshold), marks, texts, width, threshold)
    more = _verified(_open_pairs(lists, connected(links, "a", "b"), threshold), marks, texts, width, threshold)
    roots = staged(connected(links.unionByName(more), "a", "b"), "roots")
    node, root = (fresh_name(sized, n) for n in ("node", "root"))
    joined = sized.join(roots.toDF(node, root), F.col(key) == F.col(node), "left")
    return joined.select(*keep, names[0], F.coalesce(root, key).alias(names[1]))


def jaccard_components(docs: DataFrame, width: int = 3, part: int = 90, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach, of every row of ``docs``.

    See :func:`jaccard_classes`.  A component without any id has a null one; so has a
    row without shingles and id.
    """
    rows = staged(jaccard_classes(docs.select("doc_id", "text"), width, part, whole), "classes")
    least = rows.filter("class_key IS NOT NULL").groupBy("class_key").agg(F.min("doc_id").alias("component_id"))
    named = rows.join(least.withColumnRenamed("class_key", "own"), F.col("class_key") == F.col("own"), "left")
    component = F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"))
