import numpy as np
import plain
import pytest

from pricing_engine.llm.queries import op12_whitening
from pricing_engine.llm.whitening import whitened


def checked(found, rows, k=4):
    """Compare with the eigenvectors of the plain covariance, a component's sign apart."""
    rows = [(i, x) for i, x in rows if x is not None and None not in x and x]
    for dims in {len(x) for _, x in rows}:
        own = [(i, x) for i, x in rows if len(x) == dims]
        fit = np.array(sorted({tuple(x) for _, x in own}), np.int64)
        n, sums = len(fit), fit.sum(axis=0)
        centred = fit - sums / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        by = {}
        for r in found:
            by.setdefault((r.vec_id, r.component), []).append(r)
        for c in range(min(k, dims)):
            live = values[c] > 1e-9 * max(values[0], 1e-300) and n > 1
            signs = set()
            for i, x in own:
                for r in by[i, c + 1]:
                    if r.n != n or r.deviation != sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)):
                        continue  # another length
                    want = (np.array(x) - sums / n) @ vectors[:, c] / np.sqrt(values[c]) if live else 0.0
                    assert abs(abs(r.whitened) - abs(want)) < 1e-6
                    if abs(want) > 1e-3:
                        signs.add(np.sign(r.whitened) == np.sign(want))
                    assert r.explained == pytest.approx(values[c] / values.sum() if live else 0.0, rel=1e-6, abs=1e-12)
                    assert r.identity_error < 1e-8
                    break
                else:
                    raise AssertionError((i, c))
            assert len(signs) <= 1
    assert len(found) == sum(min(k, len(x)) for _, x in rows)


def frame(spark, rows):
    return whitened(spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, x array<long>, n int, explained double")).collect()


def test_against_eigenvectors(spark):
    """Very unequal variances, repeated and null rows, a null id and other lengths."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 7)) * [1000, 300, 100, 40, 10, 5, 2] @ np.linalg.qr(rng.normal(size=(7, 7)))[0] + 500
    rows = [(i, np.floor(v).astype(int).tolist()) for i, v in enumerate(base)]
    rows += [rows[3]] * 200 + [(400, None), (401, [1, None, 3, 4, 5, 6, 7]), (None, rows[5][1]), (402, [])]
    rows += [(500 + i, [int(v) for v in rng.integers(-9, 9, 2)]) for i in range(30)]
    checked(frame(spark, rows), rows)


def test_dependent_dimensions(spark):
    rng = np.random.default_rng(2)
    two = rng.integers(-200, 200, (100, 2))
    rows = [(i, [int(a), int(b), int(a + b), 7, int(3 * a)]) for i, (a, b) in enumerate(two)]
    checked(frame(spark, rows), rows)


@pytest.mark.parametrize("rows", [[], [(1, [3, 4])], [(1, [3, 4]), (2, [3, 4])], [(1, [5])] * 3, [(1, [0, 2]), (2, [0, 4])]])
def test_few_rows(spark, rows):
    checked(frame(spark, rows), rows)


def test_sums_beyond_a_long(spark):
    rows = [(i, [i * 2**40, -i]) for i in range(20)]
    total = sum(range(20)) * 2**40
    found = {r.vec_id: int(r.deviation) for r in frame(spark, rows) if r.component == 1}
    assert found == {i: (20 * i * 2**40 - total) ** 2 + (20 * -i + 190) ** 2 for i in range(20)}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = []
    for r in plain.read(spark, sf_dir, "embeddings"):
        whole = r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)
        rows.append((r.vec_id, [int(np.floor(256 * float(v))) for v in r.embedding] if whole else None))
    checked(op12_whitening(spark, sf_dir).collect(), rows)
