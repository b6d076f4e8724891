import math
from collections import Counter

import numpy as np
import plain
import pytest

import corpus_pipeline
from pricing_engine.llm import decontamination as d
from pricing_engine.llm import queries

SF_DIR = "/root/testdata/sf0.01"


def scores(items, words):
    """BM25 of every item for a passage's distinct words, divided by its score for itself."""
    own = [d.terms(t) for t in items]
    mean = sum(map(len, own)) / len(own)
    out = []
    for item in own:
        weight = {}
        for t, n in Counter(item).items():
            df = sum(t in x for x in own)
            weight[t] = math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(item) / mean))
        out.append(sum(w for t, w in weight.items() if t in words) / sum(weight.values()) if weight else 0.0)
    return out


def test_query_finds_exactly_the_leaks(spark):
    items = plain.read(spark, SF_DIR, "benchmark")
    docs = plain.read(spark, SF_DIR, "documents")
    want = {(r.doc_id, i.item_id) for r in docs for i in items if i.text in r.text}
    found = queries.op10_decontamination(spark, SF_DIR).collect()
    assert len(want) > 20 and {(r.doc_id, r.item_id) for r in found} == want
    docs_frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs_frame, SF_DIR).collect()}
    assert kept == {r.doc_id for r in docs} - {x for x, _ in want}


@pytest.mark.parametrize("least", [0.2, 0.5])
def test_retrieval_equals_scoring_all(spark, least):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(80)]
    items = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(70)] + ["", "?"]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    index = next(d.indexes(frame))
    place = {index.items[k][0]: k for k in range(len(items))}
    passages = [rng.choice(words, rng.integers(5, 60)) for _ in range(40)]
    pairs = np.unique(np.concatenate([j * 1000 + index.rank[[index.vocabulary[w] for w in p if w in index.vocabulary]] for j, p in enumerate(passages)]))
    found = d.retrieve(index, pairs // 1000, index.by_rank[pairs % 1000], least)
    want = {}
    for j, p in enumerate(passages):
        for k, s in enumerate(scores(items, set(p))):
            if s >= least - 1e-12:
                want[j, place[k]] = s
    assert {(j, k): s for j, k, s in found} == pytest.approx(want)


def test_question_and_answer_must_both_be_there():
    item = "who painted the old harbour at dawn? it was a fisherman named orlo brandt from kesh"
    index = d.build([(1, item), (2, "some other words entirely different here")], 2, 12.0, Counter(set(d.terms(item)) | set(d.terms("some other words entirely different here"))), 64)
    found = lambda text: [x[0] for x in d.hits(index, text, 0.5, 0.8)]
    noise = " ".join(f"n{i}" for i in range(500))
    assert found(f"{noise} {item} {noise}") == [1]
    assert found(f"{noise} {item.upper().replace(' ', '  ')}!! {noise}") == [1]
    assert found(f"{noise} {item.split('?')[0]}? {noise}") == []
    assert found(f"{noise} {item.split('?')[1]} {noise}") == []
    assert found(" ".join(reversed(item.split()))) == []


def test_edge_cases(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, text, 7), (3, text, 7), (None, "x " * 50_000 + text, 7)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0), (4, "...", 0)], "item_id long, text string, score int")
    found = d.contaminated(docs, items)
    assert Counter((r.doc_id, r.item_id) for r in found.collect()) == {(3, 1): 4, (None, 1): 2}
    assert d.clean(docs, items).count() == 2
    assert d.contaminated(docs, items.limit(0)).collect() == [] and d.clean(docs, items.limit(0)).count() == 5
    assert d.contaminated(docs.limit(0), items).collect() == []
    # several indexes give the same leaks
    parts = list(d.indexes(items, most=2))
    assert len(parts) > 1 and sum(len(p.items) for p in parts) == 5


def test_a_long_item_does_not_widen_the_others(spark):
    """Question and answer of a short item far apart are no leak, whatever other items there are."""
    short = "who painted the old harbour at dawn? it was a fisherman named orlo brandt from kesh"
    long = "what is in the long report? " + " ".join(f"report{i}" for i in range(900))
    items = spark.createDataFrame([(1, short), (2, long), (3, None)], "item_id long, text string")
    question, answer = short.split("?")
    filler = " ".join(f"n{i}" for i in range(300))
    rows = [(1, f"{question}? {filler} {answer}"), (2, f"{filler} {short} {filler}"), (3, f"{filler} {long} {filler}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()} == {(2, 1), (3, 2)}
    assert [p.passage for p in d.indexes(items)] == [64, 1024]
