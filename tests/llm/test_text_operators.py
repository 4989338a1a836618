"""Operators 1, 6 and 8, and the pipeline, against plain code."""

import random
import re

import corpus_pipeline
from llm_samples import DOCS, SMALL, documents, odd  # noqa: F401
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import ngram_jaccard, quality_llr, queries, template_decontam


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_measures_and_verdict(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = queries.op1_quality_llr(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if len(docs[r.doc_id].text) < 6000:
            assert tuple(r[m] for m in quality_llr.MEASURES) == measured(docs[r.doc_id].text)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    decided = [(labels[r.doc_id].quality, r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert all(kept for quality, kept in decided if quality) and not any(kept for quality, kept in decided if not quality)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_llr.judged(odd, quality_llr.fit(odd, labels), carry=tuple(odd.columns)).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows if not r.text)
    empty = spark.createDataFrame([], DOCS)
    assert quality_llr.judged(empty, quality_llr.fit(empty, labels)).count() == 0


def test_quality_trusts_all_trusted_documents(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality_llr.trusted_ids(labels).count() == 30_000
    scores = spark.range(5_000).selectExpr("CAST((id * 7919) % 5000 AS double) AS score")
    assert [quality_llr._ranked(scores, k) for k in (0, 5, 4_999)] == [0.0, 5.0, 4_999.0]


def jaccard(texts):
    def grams(text):
        words = text.lower().split()
        n = min(5, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()

    sets = [grams(t) for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_links_and_groups_are_those_of_all_pairs(spark):
    """A crowd of near copies, beyond one block, smaller groups, copies, and texts with a passage in common."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(220)]
    texts = [changed(rng, base, rng.randrange(1, 8)) for _ in range(300)]
    for _ in range(12):
        own = [f"v{rng.randrange(3000)}" for _ in range(80)]
        texts += [changed(rng, own, rng.randrange(3)) for _ in range(4)]
    texts += [" ".join(base[:60] + [f"u{rng.randrange(10**6)}" for _ in range(90)]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in ngram_jaccard.joined(docs).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    distinct = sorted(first.values())
    pairs = {(distinct[i], distinct[j]) for i, j in jaccard([texts[k] for k in distinct])}
    assert len(pairs) > 5_000
    degree, parent = dict.fromkeys(distinct, 0), {i: i for i in distinct}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        degree[i] += 1
        degree[j] += 1
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    for i, t in enumerate(texts):
        assert (rows[i].copy_id, rows[i].n_links, rows[i].class_id) == (first[t], degree[first[t]], root(first[t])), i
    kept = {r.doc_id for r in ngram_jaccard.deduplicated(docs).collect()}
    assert kept == {root(first[t]) for t in texts}


def test_pruning_steps_follow_the_binomial_tail():
    steps = ngram_jaccard.least_matches()
    assert [n for n, _ in steps][:2] == [16, 32] and all(a[1] <= b[1] for a, b in zip(steps, steps[1:]))
    assert steps[-1][1] < 0.8 * ngram_jaccard.HASHES


def test_jaccard_odd_rows(spark, odd):
    rows = ngram_jaccard.joined(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].class_id == 5 and by_id[6].n_copies == 2 and by_id[0].class_id == 0 and by_id[1].n_copies == 1
    kept = ngram_jaccard.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "0", "1", "2", "3", "4", "5", "7", "8"])
    empty = spark.createDataFrame([], DOCS)
    assert ngram_jaccard.joined(empty).count() == 0 and ngram_jaccard.deduplicated(empty).count() == 0


ITEM = "If Anna buys 12 kg of apples for 30 dollars and Anna sells 5 kg at once, how much money does Bert get from Anna after 12 days?"
ASKED = "blah blah more prose here. If Maria buys 40 miles of apples for 77 euros and Maria sells 9 miles at once, how much money does Otto get from Maria after 40 hours? And so on."


def test_decontamination_sees_templates_and_slots(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (1, ITEM)], "item_id long, text string")
    texts = [
        f"some words before {ITEM} and after",
        ITEM.upper().lower().replace(" ", "\n"),
        ASKED,
        ASKED.replace("Maria sells", "Paula sells").replace("from Maria", "from Klaus"),
        "quite another text that only talks about apples and money and other things for many words in a row",
        None,
        "",
    ]
    rows = {r.doc_id: r for r in template_decontam.judged(documents(spark, texts), items).collect()}
    assert [rows[i].contaminated for i in range(7)] == [True, True, True, False, False, False, False]
    assert rows[0].item_ids == [1] and rows[0].coverage == 1.0
    clean = template_decontam.cleaned(documents(spark, texts), items)
    assert "hash" in clean.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["3", "4", "5", "6", "6", "None"]
    empty = spark.createDataFrame([], DOCS)
    assert template_decontam.judged(empty, items).count() == 0
    assert template_decontam.judged(documents(spark, texts), items.limit(0)).where("contaminated").count() == 0


def test_decontamination_sees_copies_in_another_case_and_with_a_changed_slot(spark):
    long = "The first lamp stands near an old wall and gives light to 12 people. What if The second lamp falls over and 12 people have to leave the room at once?"
    items = spark.createDataFrame([(1, ITEM), (2, long)], "item_id long, text string")
    texts = [ITEM.lower(), ITEM.upper(), long.replace("The second", "This second"), long.replace("12 people have", "13 people have"), ASKED.lower(), long[: len(long) // 3]]
    rows = {r.doc_id: r.item_ids for r in template_decontam.judged(documents(spark, texts), items).collect()}
    assert [rows[i] for i in range(6)] == [[1], [1], [2], [2], [1], []]


def test_decontamination_finds_short_unnamed_and_long_items(spark):
    rng = random.Random(5)
    book = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + k % 26)}" for k in range(500)]
    quoted = "a stranger asked the same question to a man on the street one morning"
    items = [(1, "What is the capital of France?"), (2, "1 2 3 4 5 6 7 8 9 Rome Paris"), (None, quoted), (3, " ".join(book)), (4, "one text of the item that nobody has quoted at all"), (4, "another text for item 4 with 12 green apples in a box for Maria")]
    texts = [
        "so: what is the capital of france, then?", "numbers 1 2 3 4 5 6 7 8 9 rome paris end", f"they say {quoted} .", " ".join(book[100:300]),
        "and Another text for item 4 with 12 green apples in a box for Maria .", "what is the capital of", " ".join(book[100:140]),
    ]
    docs, table = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in template_decontam.judged(docs, table).collect()}
    assert [rows[i] for i in range(7)] == [(True, 1, [1]), (True, 1, [2]), (True, 1, []), (True, 1, [3]), (True, 1, [4]), (False, 0, []), (False, 0, [])]
    clean = template_decontam.cleaned(docs, table)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["5", "6", "6", "None"]
    assert template_decontam.judged(docs.limit(0), table).count() == 0 and template_decontam.judged(docs, table.limit(0)).where("contaminated").count() == 0


def test_decontamination_leaves_out_items_that_say_nothing(spark):
    items = spark.createDataFrame([(1, "the"), (2, "Yes, no."), (3, "a bc def ghi jk l"), (4, "what is 3 plus 4")], "item_id long, text string")
    texts = ["the answer is yes no", "A bc; def ghi jk l", "so what is 3 plus 4", "what is 3 plus", None]
    rows = {r.doc_id: r.item_ids for r in template_decontam.judged(documents(spark, texts), items).collect()}
    assert [rows[i] for i in range(5)] == [[], [3], [4], [], []]


@pytest.mark.parametrize("width", [1, 3, 7, 8])
def test_window_hashes_tell_windows_apart(spark, width):
    rng = random.Random(width)
    rows = [(k, [rng.choice("ab") for _ in range(n)]) for k, n in enumerate([0, 1, 7, 8, 9, 40, 300])]
    hashed = spark.createDataFrame(rows, "k int, words array<string>").select("words", template_decontam._hashed(F.col("words")).alias("h"))
    seen = {}
    for words, found in hashed.select("words", template_decontam._windows("h", width)).collect():
        assert [x is None for x in found] == [i + width > len(words) for i in range(len(words))]
        for i, x in enumerate(found[: max(0, len(words) - width + 1)]):
            assert seen.setdefault(tuple(words[i : i + width]), x) == x
    assert len(set(seen.values())) == len(seen) > 1


def test_decontamination_query_finds_every_planted_item(spark):
    docs = {r.doc_id: " ".join(re.findall(r"[^\W_]+", r.text)).lower() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: " ".join(re.findall(r"[^\W_]+", r.text)).lower() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    planted = {d: sorted(i for i, x in items.items() if x in t) for d, t in docs.items()}
    found = {r.doc_id: r.item_ids for r in queries.op6_decontaminate(spark, SMALL).collect()}
    assert any(planted.values()) and found == planted


def test_pipeline_keeps_whole_documents_and_takes_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
        counts.append(now.count())
        if name != "packing":
            assert now.columns == docs.columns and now.exceptAll(docs).count() == 0
    assert docs.count() > counts[0] > counts[1] > counts[2] and corpus_pipeline.run(spark, SMALL).count() == counts[3]


def test_quality_keeps_all_when_no_trusted_document_is_long_enough(spark):
    texts = [f"short trusted text {i}" for i in range(5)] + [f"a sound document {i} of more than twenty words that nobody has labelled and which "
             f"goes on about one thing and another for a while {i}" for i in range(40)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    rows = quality_llr.judged(docs, quality_llr.fit(docs, labels)).collect()
    assert all(r.kept == (not r.base_failed) for r in rows) and sum(r.kept for r in rows) >= 40
