import numpy as np
import plain
from pyspark.sql import functions as F

from pricing_engine.llm import common, language, queries

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in plain.read(spark, SF_DIR, "documents")}
    found = queries.op6_language(spark, SF_DIR).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (common.crc_fold(r.doc_id, 5) == 0) for r in found)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language.fit(docs)
    longest = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    a, b = sorted(longest)[:2]
    found, share, _ = language.mixture(model, longest[a][:3000] + " " + longest[b][:1000])
    assert [model.languages[i] for i in found] == [a, b] and abs(share[0] - 0.75) < 0.1
    found, _, _ = language.mixture(model, longest[a])
    assert [model.languages[i] for i in found] == [a]


def test_expectation_maximisation_raises_the_likelihood():
    rng = np.random.default_rng(0)
    chances, counts = rng.dirichlet(np.ones(50), 3).T, rng.integers(1, 9, 50).astype(float)
    likelihoods = [language.proportions(chances, counts, steps)[1] for steps in range(1, 20)]
    assert np.all(np.diff(likelihoods) > -1e-9)


def test_counts_equal_plain_ones():
    text = "Été, ÉTÉ  x"
    buckets, counts = language.trigrams(text)
    grams = [" été été x "[i : i + 3] for i in range(len(" été été x ") - 2)]
    assert counts.sum() == len(grams) and sorted(counts) == sorted(np.unique(grams, return_counts=True)[1])
    long, short = language.trigrams(text * 2000), language.trigrams(text)
    assert set(short[0]) <= set(long[0])


def test_edge_cases(spark):
    rows = [(1, "the the", "en", 1.0), (2, None, "en", 1.0), (3, "12 !!", "de", 1.0), (4, "", None, 1.0), (5, "das das", "de", 1.0), (None, "das " * 50_000, None, 1.0), (5, "das das", "de", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    found = language.identified(docs, language.fit(docs)).collect()
    assert [(r.doc_id, r.lang_pred) for r in found] == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (None, "de"), (5, "de")]
    unknown = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identified(docs, unknown).collect()} == {"und"}
    assert language.identified(docs.limit(0), unknown).collect() == []
