from collections import defaultdict

import plain
import pytest

from pricing_engine.llm import mixing, queries

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string"


def targets(sizes):
    """Targets by the rule: shares by weight, capped at twice the size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / (sum(weight[s] for s in rest) or 1)
        above = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= above


def check(spark, rows, slack=0.02):
    frame = spark.createDataFrame(rows, DOCS)
    found = mixing.mixed(frame).collect()
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixed(frame.repartition(3)).collect()))
    assert len(found) == len(rows)
    size, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        size[source] += len(plain.WORD.findall(text or ""))
    want = targets(size)
    for r in found:
        taken[r.source] += r.taken
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    for source, words in taken.items():
        assert abs(words - want[source]) <= max(1, slack * want[source])


def test_query_meets_the_targets(spark):
    rows = [(r.doc_id, r.text, r.source) for r in plain.read(spark, SF_DIR, "documents")]
    check(spark, rows, 0.005)


def test_edge_cases(spark):
    rows = [(i, "w " * (i % 7 + 1), s) for i in range(60) for s in ("a", "b", None, "é", "B")]
    rows += [(1000, None, "a"), (1001, "", "void"), (1002, " ", None), (None, "x y", "a"), (7, "w", "a"), (7, "w", "a")]
    rows += [(2000 + i, "same size " * 5, "hot") for i in range(400)]
    check(spark, rows)


def test_empty_and_wordless(spark):
    assert mixing.mixed(spark.createDataFrame([], DOCS)).collect() == []
    row = mixing.mixed(spark.createDataFrame([(1, None, None, 4, 5)], DOCS + ", size int, copies int")).first()
    assert (row["size"], row.taken, row.target) == (0, 0, 0.0)


def test_rates_are_tilted_by_size(spark):
    rows = [(i, "w " * (i + 1), "s") for i in range(200)] + [(1000 + i, "w " * (i + 1), "t") for i in range(200)]
    found = mixing.mixed(spark.createDataFrame(rows, DOCS), weights=(9, 1), share=1.0).collect()
    by_source = {s: sorted((r["size"], r.rate) for r in found if r.source == s) for s in "st"}
    for points in by_source.values():
        rates = [p[1] for p in points]
        assert rates == sorted(rates) or rates == sorted(rates, reverse=True)


def test_query_runs_without_python(spark):
    plan = queries.op8_mix_sources(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_words_missing_are_settled_to_the_last(spark):
    """One document of each size: many passes are needed, and no size that still fits is left."""
    rows = [(i, "w " * n, "s") for i, n in enumerate([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096])]
    for share in (0.3, 0.7, 1.1, 1.9):
        found = mixing.mixed(spark.createDataFrame(rows, DOCS), weights=(1,), share=share).collect()
        assert sum(r.taken for r in found) == round(found[0].target)
