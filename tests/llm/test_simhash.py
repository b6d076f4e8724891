import numpy as np
import plain
import pytest

from pricing_engine.llm import queries, simhash

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark int, component_id string"


def groups(spark, rows, schema="doc_id long, text string"):
    return simhash.near_groups(spark.createDataFrame(rows, schema)).collect()


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in plain.read(spark, SF_DIR, "documents")}
    marks = {i: plain.simhash(t) for i, t in texts.items()}
    roots = plain.components(list(marks), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 4)
    found = queries.op5_simhash_groups(spark, SF_DIR).collect()
    assert len(found) == len(texts)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {
        (i, f"{m:016x}", roots[i]) for i, m in marks.items()
    }


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_links_connect_all_near_fingerprints(spark, radius):
    """Random fingerprints, a chain, and a dense mass of near copies; small shards force deep trees."""
    rng = np.random.default_rng(radius)
    points = rng.integers(0, 2**63, 300, dtype=np.uint64)
    mass = points[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, 3), dtype=np.uint64), axis=1)
    chain = np.bitwise_xor.accumulate(np.concatenate((points[1:2], np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))))
    marks = np.unique(np.concatenate((points, mass, chain))).view(np.int64).tolist()
    frame = spark.createDataFrame([(m,) for m in marks], "mark long")
    links = [tuple(r) for r in simhash.linked_fingerprints(frame, "mark", radius, sample=200, shard=20).collect()]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    both = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    assert plain.components(marks, lambda a, b: (a, b) in both) == plain.components(marks, near)


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (4, " \n\t"), (9, "one two"), (8, "One TWO"), (8, "One TWO"), (None, "one two"), (7, "x " * 30_000)]
    found = {(r.doc_id, r.mark, r.component_id) for r in groups(spark, rows)}
    empty = {r for r in found if r[1] == 0}
    assert empty == {(5, 0, 3), (3, 0, 3), (4, 0, 3)}
    assert {r[2] for r in found if r[0] in (9, 8, None)} == {8}
    assert len(groups(spark, rows)) == len(rows)
    assert groups(spark, []) == []
    extra = [(1, "a b c", "en", "s", 5, 3, "x"), (2, "a b c", None, None, None, None, None)]
    assert {r.component_id for r in groups(spark, extra, DOCS)} == {1}
    assert [r.component_id for r in groups(spark, [(None, "a")])] == [None]
