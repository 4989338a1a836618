"""Operator 13 against plain code and on held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_samples import DOCS, SMALL, documents, odd  # noqa: F401
from pyspark.sql import functions as F
from shelfscope.llm import queries, tfidf_votes
from shelfscope.llm.tfidf_votes import Index

LABELS = "doc_id long, quality int, toxic int, text string, score double, vote string"
LARGER = "/root/testdata/sf0.01"


def words_of(text):
    return Counter(re.findall(r"[^\W_]+", (text or "").lower()))


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, tfidf_votes.fit(docs, labels)


def test_neighbours_are_the_nearest_of_all_examples():
    rng = np.random.default_rng(7)
    idf = rng.random(60) + 0.1
    words = [f"w{i}" for i in range(60)]
    examples = []
    for e in range(700):
        held = sorted(rng.choice(60, rng.integers(1, 9), replace=False).tolist())
        examples.append((e // 2 if e < 20 else e, int(rng.random() < 0.3), held, rng.integers(1, 4, len(held)).tolist()))
    examples += [(1000 + e, 1, [3, 5], [1, 2]) for e in range(100)]  # ties
    index = Index.build(words, idf, examples)
    vectors = np.zeros((len(examples), 60))
    for row, (_, _, held, tf) in zip(vectors, examples):
        row[held] = (1 + np.log(tf)) * idf[held]
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    for text in ("w1 w2 w2 w3", "w3 w5 w5", "W7", "w0 " * 9 + "w59 w8 w9 w10 w11", "none of these", ""):
        found, cosines = index.nearest(*index.vector(text), 15)
        counts = words_of(text)
        q = np.array([(1 + math.log(counts[w])) * x if counts[w] else 0.0 for w, x in zip(words, idf)])
        all_cosines = vectors @ q / (np.sqrt((q**2).sum()) or 1.0)
        want = sorted(((-round(x, 9), examples[e][0]) for e, x in enumerate(all_cosines) if x > 0))[:15]
        assert [(-round(x, 9), index.ids[e]) for e, x in zip(found.tolist(), cosines.tolist())] == want


def test_isotonic_rises_and_keeps_the_counts():
    votes, shares = tfidf_votes.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 0, 1]), 0.5)
    assert votes.tolist() == pytest.approx([0.1, 0.7 / 3, 0.9]) and shares.tolist() == pytest.approx([0.25, 0.375, 0.75])
    assert len(tfidf_votes.isotonic(np.zeros(0), np.zeros(0), 0.5)[0]) == 0


def test_words_and_frequencies_match_plain_counts(spark, fitted):
    docs, labels, model = fitted
    texts = {r.doc_id: words_of(r.text) for r in docs.collect()}
    held = Counter(w for x in texts.values() for w in x)
    index = model.index
    assert {"idiot", "moron"} <= set(index.words)
    for w, i in index.words.items():
        assert index.idf[i] == pytest.approx(math.log((len(texts) + 1) / (held[w] + 0.5)))
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert all(known[d] == y for d, y in zip(index.ids, index.labels))
    assert all(index.words.keys() & texts[d].keys() for d in index.ids)


def test_scores_on_held_out_rows(spark, fitted):
    docs, labels, model = fitted
    rows = {r.doc_id: r for r in queries.op13_tfidf_votes(spark, LARGER).collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.join(docs.where("lang = 'en'"), "doc_id").collect()}
    tested = [r for r in rows.values() if r.held_out and r.doc_id in truth]
    assert len(tested) > 40
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)
    caught = [r.predicted for r in tested if truth[r.doc_id]]
    assert sum(caught) >= 0.9 * len(caught) > 3
    for r in rows.values():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert not r.held_out or r.doc_id not in {x.doc_id for x in r.nearest}
        assert [x.cosine for x in r.nearest] == sorted((x.cosine for x in r.nearest), reverse=True)


def test_score_depends_on_the_text_alone(spark, fitted):
    docs, _, model = fitted
    some = docs.limit(200)
    other = some.withColumn("doc_id", -F.col("doc_id")).withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None))
    a = {r.doc_id: r.score for r in tfidf_votes.scored(some, model).collect()}
    assert a == {-r.doc_id: r.score for r in tfidf_votes.scored(other.repartition(7), model).collect()}


def test_toxicity_odd_rows(spark, fitted, odd):  # noqa: F811
    model = fitted[2]
    rows = tfidf_votes.scored(odd, model).collect()
    assert len(rows) == odd.count()
    lonely = {round(r.score, 12) for r in rows if not r.nearest}
    assert len(lonely) == 1 and all(not r.nearest for r in rows if r.doc_id in (0, 1, 2))
    told = tfidf_votes.scored(documents(spark, ["What an IDIOT, moron_idiot scum!", "fine " * 50_000]), model).collect()
    assert [r.predicted for r in sorted(told, key=lambda r: str(r.doc_id))] == [1, 0, 0, 0]


def test_toxicity_of_odd_labels_and_empty_tables(spark):
    texts = [f"you idiot number {i}" for i in range(30)] + [f"you friend number {i}" for i in range(60)]
    docs = documents(spark, texts)
    labels = [(i, None, int(i < 30), "x", 0.5, "y") for i in range(90)]
    odd_labels = [*labels, labels[0], (5, 1, 0, "x", 0.5, "y"), (None, 1, 1, "x", 0.5, "y"), (7, 1, None, "x", 0.5, "y"), (999, 1, 1, "x", 0.5, "y")]
    model = tfidf_votes.fit(docs, spark.createDataFrame(odd_labels, LABELS))
    assert 5 not in model.index.ids
    rows = {r.doc_id: r for r in tfidf_votes.scored(docs, model).collect() if r.doc_id is not None}
    assert sum(r.predicted == int(i < 30) for i, r in rows.items()) == 90
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert tfidf_votes.scored(empty, tfidf_votes.fit(empty, none)).count() == 0
    assert {r.score for r in tfidf_votes.scored(docs, tfidf_votes.fit(docs, none)).collect()} == {0.0}
    all_toxic = spark.createDataFrame([(i, 1, 1, "x", 0.5, "y") for i in range(90)], LABELS)
    assert all(r.score > 0.5 and not r.nearest for r in tfidf_votes.scored(docs, tfidf_votes.fit(docs, all_toxic)).collect())
