import numpy as np
import plain

import corpus_pipeline as pipeline
from pricing_engine.llm.jaccard import jaccard_classes

SF_DIR = "/root/testdata/sf0.001"


def alike(a, b):
    return a == b if not a or not b else len(a & b) / len(a | b) >= 0.8


def roots_of(texts):
    sets = {i: set(plain.shingles(t, 5, lower=True)) for i, t in texts.items()}
    return plain.components(list(sets), lambda a, b: alike(sets[a], sets[b]))


def edited(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"e{rng.integers(10**9)}"
    return out


def test_stage_keeps_one_of_each_group_of_overlap(spark):
    """Copies with some words replaced: alike by 0.8 or not, to the first or only to each other."""
    rng = np.random.default_rng(7)
    texts = []
    for n in (60, 150, 400):
        for _ in range(25):
            first = [f"w{rng.integers(10**6)}" for _ in range(n)]
            texts += [first, *(edited(rng, first, int(k)) for k in rng.integers(1, max(2, n // 30), 4))]
    texts = dict(enumerate(" ".join(t) for t in texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.one_of_each_group(spark, docs, SF_DIR).collect()}
    assert kept == set(roots_of(texts).values())


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in pipeline.one_of_each_group(spark, docs, SF_DIR).collect()}
    assert kept == set(roots_of({r.doc_id: r.text for r in docs.collect()}).values())


def test_texts_alike_only_through_others(spark):
    """Copies of a missing original, each with a word of its own replaced, and a mass of unlike ones."""
    rng = np.random.default_rng(3)
    first = [f"w{i}" for i in range(120)]
    texts = [edited(rng, first, 2) for _ in range(40)] + [edited(rng, first, 8) for _ in range(40)]
    texts = dict(enumerate(" ".join(t) for t in texts))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    least = {}
    rows = jaccard_classes(frame, 5, 8, 10).collect()
    for r in rows:
        least[r.class_key] = min(r.doc_id, least.get(r.class_key, r.doc_id))
    assert {r.doc_id: least[r.class_key] for r in rows} == roots_of(texts)
