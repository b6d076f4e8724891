import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from pricing_engine.llm import negatives
from pricing_engine.llm.hilbert import hilbert_keys
from pricing_engine.llm.queries import op13_hard_negatives


def brute(rows, picked, k=5, n=5):
    """rows: (vec_id, label, x), nulls and all."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    order = lambda s, r: (-s, r[0] is None, r[0] or 0)
    out = []
    for i, (anchor, label, x) in enumerate(rows):
        if anchor is None or not picked(anchor):
            continue
        scored = [(sum(a * b for a, b in zip(x, r[2])), r) for j, r in enumerate(rows) if j != i and len(r[2]) == len(x)]
        scored.sort(key=lambda p: order(*p))
        for ps, p in [s for s in scored if s[1][1] == label][:k]:
            close = [s for s in scored if s[1][1] != label and 80 * ps <= 100 * s[0] <= 100 * ps]
            out += [(anchor, p[0], m + 1, r[0], ps, s) for m, (s, r) in enumerate(close[:n])]
    return sorted(out, key=str)


def mined(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, label int, x array<long>, uid int, tray string")
    return sorted((tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()), key=str)


@pytest.mark.parametrize("rows_a_block", [8, 1024])
def test_against_all_pairs(spark, monkeypatch, rows_a_block):
    """Clustered vectors with ties, repeated rows, a mass of one vector, nulls and other lengths."""
    monkeypatch.setattr(negatives, "ROWS", rows_a_block)
    monkeypatch.setattr(negatives, "BLOCKS", 2)
    monkeypatch.setattr(negatives, "PACK", 3)
    rng = np.random.default_rng(1)
    centres = rng.integers(-40, 40, (6, 5))
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 6] + rng.integers(-4, 5, 5)).tolist()) for i in range(150)]
    rows += [(200 + i, i % 3, [30, 0, 0, -30, 5]) for i in range(60)] + [rows[10], rows[10], rows[20]]
    rows += [(None, 1, centres[0].tolist()), (310, None, [1] * 5), (320, 1, None), (330, 1, [1, None, 1, 1, 1])]
    rows += [(340, 0, [2, 3]), (341, 0, [2, 2]), (342, 1, [1, 3]), (350, 0, []), (351, 0, []), (352, 1, [])]
    assert mined(spark, [(*r, 1, "t") for r in rows]) == brute(rows, lambda i: i % 10 == 0)


def test_nothing_or_nearly(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [1, 2], 0, "")]) == []
    assert mined(spark, [(10, 1, [1, 2], 0, ""), (11, 1, [-3, 0], 0, ""), (12, 2, [-1, 0], 0, "")]) == []


def test_products_that_do_not_fit():
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2**40]]), np.array([[2**40]]))
    a = np.array([[2**29, 1]])
    assert negatives.products(a, a).tolist() == [[2**58 + 1]]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, anchors = rng.integers(-90, 90, (40, 7)), rng.integers(-90, 90, (9, 7))
    low, high = negatives.score_bounds(anchors, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = anchors @ x.T
    assert (scores >= low).all() and (scores <= high).all()


@pytest.mark.parametrize("dims, bits", [(1, 3), (2, 3), (3, 2), (5, 2)])
def test_curve_steps_to_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in hilbert_keys(grid, bits)]
    assert len(set(keys)) == len(grid)
    path = grid[np.argsort(np.array(keys, object), kind="stable")]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = []
    for r in plain.read(spark, sf_dir, "embeddings"):
        x = None if r.embedding is None else [None if v is None or not np.isfinite(v) else int(np.floor(256 * float(v))) for v in r.embedding]
        rows.append((r.vec_id, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10, x))
    found = sorted((tuple(r) for r in op13_hard_negatives(spark, sf_dir).collect()), key=str)
    assert found == brute(rows, lambda i: i % 100 == 0) and len(found) > 20
