import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricing_engine.llm import common, quality, queries

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = queries.op1_quality(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert found.count() == docs.count()
    rows = found.join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (common.crc_fold(r.doc_id, 4) == 2) for r in rows)


def test_held_out_labels_are_not_learned(spark, tmp_path):
    """Turning the held-out labels around changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    turned = F.when(common.fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality"))
    labels.withColumn("quality", turned).write.parquet(f"{tmp_path}/labels.parquet")
    a = {r.doc_id: r.score for r in queries.op1_quality(spark, "/root/testdata/sf0.001").collect()}
    b = {r.doc_id: r.score for r in queries.op1_quality(spark, str(tmp_path)).collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_summed_equations_equal_a_plain_fit(spark):
    rng = np.random.default_rng(3)
    stats = rng.normal(size=(400, len(quality.STATISTICS)))
    label = (stats[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    rows = [(s.tolist(), int(y), i % 4) for i, (s, y) in enumerate(zip(stats, label))]
    model = quality.fit(spark.createDataFrame(rows, "stats array<double>, label int, fold int").repartition(5), features=32)
    x = quality.fourier(stats, model.mean, model.scale, model.directions, model.phases)
    plain = np.linalg.solve(x.T @ x + quality.RIDGE * 400 * np.eye(33), x.T @ label)
    assert np.allclose(plain, model.weights)
    assert np.all(np.diff(model.levels) >= 0)


def test_isotonic_is_the_nearest_rising_sequence():
    assert quality.isotonic(np.array([1.0, 3.0, 2.0, 2.0, 5.0]), np.array([1.0, 1.0, 1.0, 2.0, 1.0])) == pytest.approx([1, 2.25, 2.25, 2.25, 5])


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 0.5), (2, "", 0.5), (3, "word " * 50_000, 0.5), (3, "word " * 50_000, 0.5), (None, "a", 0.5), (4, "|||", 0.5)],
        "doc_id long, text string, stats double",
    )
    stats = quality.with_statistics(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 1)], "doc_id long, quality int")
    for labels, bounds in ((none, (0.5, 0.5)), (one, (0.0, 1.0))):
        model = quality.learned(stats, labels, F.lit(True))
        scores = [r.score for r in quality.scored(stats, model).collect()]
        assert len(scores) == 6 and all(bounds[0] <= s <= bounds[1] for s in scores)
    assert quality.scored(stats.limit(0), model).collect() == []
    kept = quality.accepted(docs, one, F.lit(True), threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 6


def test_stage_keeps_good_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.reject_low_quality(spark, docs, SF_DIR).collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    assert np.mean([(r.doc_id in kept) == bool(r.quality) for r in labels]) > 0.97


def test_junk_counts_wherever_it_stands():
    """The worst piece is found at the end of a text as at its start."""
    clean, junk = "plain words of a quiet report " * 20, "BUY @#$ NOW!!! ### WIN " * 3
    worst = slice(quality.STATISTICS.index("worst_upper"), quality.STATISTICS.index("worst_shouts") + 1)
    first, last = (np.array(quality.statistics(t)[worst]) for t in (junk + clean, clean + junk))
    assert np.all(first > 0) and last == pytest.approx(first)
