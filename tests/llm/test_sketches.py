import hashlib

import numpy as np
import plain
import xxhash

from pricing_engine.llm import queries, sketches

SF_DIR = "/root/testdata/sf0.001"


def hashes(text):
    return sorted({xxhash.xxh64_intdigest(s.encode(), 42) for s in plain.shingles(text, 5)})


def kept(text):
    own = hashes(text)
    return [h for i, h in enumerate(own) if i < 32 or h < int((2**64 - 1) / 16)]


def digits(values):
    return "".join(f"{v:016x}" for v in values)


def compare(spark, rows, schema="doc_id long, text string", **options):
    found = sketches.compared_with_next(spark.createDataFrame(rows, schema), **options).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for row, after in zip(order, [*order[1:], *order[:1]]):
        text, other = row[1] or "", after[1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        want.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(kept(text)), digits(kept(edited))))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    return {r.doc_id: r for r in found}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in plain.read(spark, SF_DIR, "documents")]
    found = compare(spark, rows)
    assert {tuple(r) for r in queries.op9_sketches(spark, SF_DIR).collect()} == {tuple(r) for r in found.values()}
    assert all(0 <= v <= 1 for r in found.values() for v in (r.near_edited, r.near_next, r.kept_edited, r.kept_next))


def test_likeness_is_near_the_true_one():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50_000)]
    for size, part in ((40, 20), (300, 200), (20_000, 10_000), (20_000, 300), (20_000, 60)):
        a = list(rng.choice(words, size))
        b = a[:part] + list(rng.choice(words, 30))
        x, y = set(hashes(" ".join(a))), set(hashes(" ".join(b)))
        near, own, other = sketches.likeness(sketches.sketch(" ".join(a)), sketches.sketch(" ".join(b)))
        assert abs(near - len(x & y) / len(x | y)) < 0.1
        assert abs(other - len(x & y) / len(y)) < 0.35 and abs(own - len(x & y) / len(x)) < 0.1


def test_sketches_merge():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (20, 5000))
    assert np.array_equal(sketches.merged(sketches.reduced(a), sketches.reduced(b)), sketches.reduced(np.union1d(a, b)))
    assert np.array_equal(sketches.from_text(sketches.to_text(a)), a)


def test_edge_cases(spark):
    rows = [(3, None), (2, ""), (None, "é " * 9), (7, "a b c d e f"), (7, "a b c d e f"), (7, "a"), (9, "word " * 20_000), (1, "🙂x" * 10)]
    compare(spark, rows, ranges=3)
    compare(spark, [(1, "only one row here it is")])
    assert compare(spark, [(4, "same text of six words here"), (3, "same text of six words here")])[4].near_next == 1.0
    assert compare(spark, [(2, None), (1, "a")])[2].near_next == 0.0
    assert sketches.compared_with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sketches.fingerprints(spark.createDataFrame([(1, "a b", 3)], "doc_id int, text string, fingerprint int")).first().fingerprint == digits(kept("a b"))
