import numpy as np
import plain
import pytest

from pricing_engine.llm import jaccard
from pricing_engine.llm.queries import op11_jaccard_join

SCHEMA = "doc_id long, text string, n_shingles string, token int, class_key int"


def linked(a, b, part, whole):
    return bool(a and b) and whole * len(a & b) >= part * len(a | b)


def expected(texts, width=3, part=90, whole=100):
    """(size, class) of each place in ``texts``."""
    sets = [set(plain.shingles(t, width, lower=True)) for t in texts]
    roots = plain.components(list(range(len(sets))), lambda a, b: linked(sets[a], sets[b], part, whole))
    return [(len(s), roots[i]) for i, s in enumerate(sets)]


def found(spark, rows, *args):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return jaccard.jaccard_components(frame, *args).collect()


def edited(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"e{rng.integers(40)}" if rng.random() < 0.5 else f"u{rng.integers(10**9)}"
    return out


def masses(rng, sizes, copies):
    """Originals, or not even those, with copies that have from no to many words replaced."""
    texts = []
    for k, n in enumerate(sizes):
        first = [f"w{rng.integers(3000)}" for _ in range(n)]
        texts += [first] * (k % 2) + [edited(rng, first, int(e)) for e in rng.integers(0, max(2, n // 15), copies)]
    texts += [texts[0], [w.upper() for w in texts[0]]]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("width, part, whole", [(3, 90, 100), (5, 8, 10), (2, 1, 2), (3, 1, 1)])
def test_against_all_pairs(spark, width, part, whole):
    rng = np.random.default_rng(width)
    texts = masses(rng, [4, 9, 30, 60, 61, 120, 240], 25)
    common = " ".join(f"c{i}" for i in range(60))  # a passage that unlike texts share
    texts += [f"{common} {' '.join(f'x{rng.integers(10**6)}' for _ in range(int(n)))}" for n in rng.integers(0, 40, 60)]
    texts += ["one", "one", "one two", "One  two\t", "one two three", "", "one two three four"]
    rows = found(spark, list(enumerate(texts)), width, part, whole)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(expected(texts, width, part, whole)))
    assert len(rows) == len(texts)


@pytest.mark.parametrize("tabled", [256, 1 << 19])
def test_mass_without_original(spark, monkeypatch, tabled):
    """Many copies of a text that is not there, about the threshold, with a small table and the usual one."""
    monkeypatch.setattr(jaccard.shingle_order, "__defaults__", (tabled,))
    rng = np.random.default_rng(5)
    first = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rng, first, int(e))) for e in rng.integers(1, 6, 220)]
    rows = found(spark, list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(expected(texts)))


def test_odd_rows(spark):
    """Nulls, no words, repeated rows and ids, a very long text, other blanks, no rows."""
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d"), (5, "A B  C D"), (5, "A B  C D"), (None, None), (6, long), (7, long + " end"), (8, "a b É"), (9, "a b É"), (10, "a b é"), (None, "q r")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found(spark, rows)), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None), (6, 39998, 6), (7, 39999, 6), (8, 1, 8), (9, 1, 8), (10, 1, 10), (None, 1, None)]
    assert got == sorted(want, key=str)
    assert found(spark, []) == [] and len(found(spark, [(1, None)])) == 1


def test_levels_and_prefixes():
    """Sets that share enough share as many shingles as asked for in their prefixes, in any order."""
    threshold, rng = jaccard.Threshold(90, 100), np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = set(rng.choice(200, n, replace=False).tolist())
        b = set(list(a)[: n - int(rng.integers(0, 1 + n // 12))]) | set(rng.choice(range(200, 400), int(rng.integers(0, 1 + n // 12))).tolist())
        if not linked(a, b, 90, 100):
            continue
        small, large = sorted((a, b), key=len)
        rank = rng.permutation(400)
        for level in range(1, 1 + min(jaccard.LEVELS, threshold.needed(len(large)))):
            head = lambda s, k: set(sorted(s, key=lambda x: rank[x])[:k])
            one = head(large, len(large) - threshold.needed(len(large)) + level)
            other = head(small, len(small) - threshold.needed_of_larger(len(small)) + level)
            assert len(one & other) >= level


def test_costly_lists_ask_for_more():
    counts = np.ones(100, np.int64)
    assert jaccard.level_of(100, 10, counts, 4) == 1
    counts[5] = 1000
    assert jaccard.level_of(100, 10, counts, 4) == 4
    counts[11] = 10**6
    assert jaccard.level_of(100, 10, counts, 4) == 1


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = sorted(plain.read(spark, sf_dir, "documents"), key=lambda r: r.doc_id)
    want = expected([r.text for r in docs])
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in op11_jaccard_join(spark, sf_dir).collect()}
    assert rows == {r.doc_id: (n, docs[root].doc_id) for r, (n, root) in zip(docs, want)}
