"""Operator 12 against plain code and the libraries on whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from llm_samples import DOCS, ODD_TEXTS, SMALL, documents
from shelfscope.llm import lockstep_alignment, queries
from shelfscope.llm.lockstep_alignment import Tokenizers
from tokenizers import Tokenizer

A, B = (public_tokenizers.path(n) for n in (queries.BYTE_VOCABULARY, queries.PIECE_VOCABULARY))
HARD = [t or "" for t in ODD_TEXTS] + [
    "a  b   c    d \n e\n  f\t\tg   h i  ",
    " leading and trailing ",
    "  \n \n x \r\n  y",
    "<s> </s> <unk> <|endoftext|> it's WE'LL 's",
    "你好 世界 123½ 😀😀 a​b é e ́x ﬁ ①",
    "\x00a \x1cb\x1d c\x85 d  e᠎ f　  g",
    "under▁score has no tokens",
    "word " * 3000,
    "x" * 5000 + " " * 300 + "=" * 400,
    " ",
    "  ",
    "\n",
]


def plain(texts):
    """Whole texts through the libraries, sets of byte ranges, counts over all of them."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    both = Tokenizers(A, B)
    made = []
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spelt = [b"".join(table[i] for i in ids) for table, ids in ((both.a_bytes, ids_a), (both.b_bytes, ids_b))]
        if not text or spelt != [(" " + text).encode()] * 2:
            ids_a = ids_b = []
        ranges = []
        for table, ids in ((both.a_bytes, ids_a), (both.b_bytes, ids_b)):
            ends = np.cumsum([len(table[i]) for i in ids]).tolist()
            ranges.append(list(zip([0, *ends], ends)))
        links, first = [], 0
        for i, (p, q) in zip(ids_a, ranges[0]):
            while ranges[1][first][1] <= p:
                first += 1
            for j in range(first, len(ids_b)):
                if ranges[1][j][0] >= q:
                    break
                links.append((i, ids_b[j]))
        cuts = sorted({q for _, q in ranges[0]} & {q for _, q in ranges[1]})
        groups = [
            [[i for i, (p, q) in zip(ids, r) if low <= p and q <= high] for ids, r in zip((ids_a, ids_b), ranges)]
            for low, high in zip([0, *cuts], cuts)
        ] if len(ids_a) < 4000 else None
        made.append((ids_a, ids_b, len(cuts), links, groups))
    count = Counter(x for m in made for x in m[3])
    highest = {}
    for (_, j), n in count.items():
        highest[j] = max(n, highest.get(j, 0))
    rows = []
    for ids_a, ids_b, n, links, groups in made:
        text = groups and ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = None if groups is None else hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best = sum(count[x] == highest[x[1]] for x in links)
        rows.append((len(ids_a), len(ids_b), n, len(links), best, sum(count[x] for x in links), digest))
    return rows, made


def as_row(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_alignment_matches_plain_code_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want, _ = plain([d.text for d in docs])
    got = {r.doc_id: as_row(r) for r in queries.op12_lockstep_alignment(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, want):
        assert got[d.doc_id][: 6 if w[6] is None else 7] == w[: 6 if w[6] is None else 7]


def test_alignment_odd_rows(spark):
    want, made = plain([*HARD, HARD[-1], "text of nobody"])
    docs = documents(spark, HARD)
    rows = lockstep_alignment.linked(docs, A, B).collect()
    ids = [*range(len(HARD)), len(HARD) - 1, None]
    assert sorted(((str(r.doc_id), as_row(r)) for r in rows), key=str) == sorted(zip(map(str, ids), want), key=str)
    assert [w[0] for w in want[:2]] == [0, 0] and want[14][:6] == (0,) * 6
    whole = {r.doc_id: r for r in lockstep_alignment.aligned(docs, A, B).collect()}
    for i, (ids_a, ids_b, n, _, groups) in enumerate(made[: len(HARD)]):
        r = whole[i]
        assert (r.a_ids, r.b_ids, len(r.a_group_ends), len(r.b_group_ends)) == (ids_a, ids_b, n, n)
        for ends, ids, side in ((r.a_group_ends, ids_a, 0), (r.b_group_ends, ids_b, 1)):
            assert groups is None or [ids[p:q] for p, q in zip([0, *ends], ends)] == [g[side] for g in groups]
    empty = spark.createDataFrame([], DOCS)
    assert lockstep_alignment.linked(empty, A, B).count() == 0 and lockstep_alignment.aligned(empty, A, B).count() == 0


def test_walks_of_any_length_find_the_same(spark):
    rng = np.random.default_rng(5)
    bounds_a, ends_a, ends_b, at = [0], [], [], 0
    for n in (1, 40, 0, 700, 3):
        for ends, size in ((ends_a, n), (ends_b, 2 * n // 3)):
            inner = rng.choice(np.arange(1, 3 * n), size, replace=False) if n else []
            ends += sorted({at + int(x) for x in [*inner, 3 * n] if n})
        bounds_a.append(len(ends_a))
        at += 3 * n
    found = [lockstep_alignment.lockstep(np.array(ends_a), np.array(ends_b), np.array(bounds_a), lane) for lane in (1, 7, 256, 10**6)]
    for x in found:
        assert sorted(zip(x.link_a.tolist(), x.link_b.tolist())) == sorted(zip(found[0].link_a.tolist(), found[0].link_b.tolist()))
        assert np.array(ends_a)[x.cut_a].tolist() == np.array(ends_b)[x.cut_b].tolist() == sorted(set(ends_a) & set(ends_b))


def test_proof_for_chunks_holds_and_whole_texts_give_the_same():
    both, whole = Tokenizers(A, B), Tokenizers(A, B)
    assert both.in_chunks
    whole.in_chunks = False
    x, y = both.encode(HARD), whole.encode(HARD)
    assert all((getattr(x, n) == getattr(y, n)).all() for n in ("a", "b", "a_bounds", "b_bounds"))


def test_counts_go_back_one_slice_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lockstep_alignment, "SLICE", 60)
    docs = documents(spark, HARD)
    rows = lockstep_alignment.linked(docs, A, B, carry=("doc_id", "at", "run"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan
    want, _ = plain([*HARD, HARD[-1], "text of nobody"])
    ids = [*range(len(HARD)), len(HARD) - 1, None]
    got = rows.collect()
    assert sorted(((str(r.doc_id), as_row(r)) for r in got), key=str) == sorted(zip(map(str, ids), want), key=str)
    assert {(r.at, r.run) for r in got} == {(5, 1)}
