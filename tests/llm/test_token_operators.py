"""Operators 4, 9 and 10 against the library itself."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm_samples import DOCS, ODD_TEXTS, SMALL, odd  # noqa: F401
from shelfscope.llm import dac_codes, pow2_packing, queries, token_counts, tokens
from shelfscope.llm.tokens import ChunkEncoder, tokenizer

WORD, BYTE = (public_tokenizers.path(n) for n in (queries.WORD_VOCABULARY, queries.BYTE_VOCABULARY))
HARD = [t or "" for t in ODD_TEXTS] + [
    "x.'s a',b c.d,'t (a) 3.5kg, don't. DON'T I'LL",
    "É×Ÿ ÿ ß, İx ŒUVRE, naïve… “q”‘x’ x’s",
    "a\x0bb\x0cc\x1cd\x85e\xa0f  g   h \n\n i\r\n",
    "x<|endoftext|>y <|startoftext|>",
    "你好 世界 123½ 😀 a​b é",
    "' s 's  're",
]


def ids_of(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def small_texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_chunks_give_the_librarys_ids():
    ids, bounds = ChunkEncoder(WORD).encode(pa.array(HARD))
    for i, text in enumerate(HARD):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*ids_of(WORD, text), 2], text


def test_plain_words_go_to_the_model_and_give_the_librarys_ids():
    letters = [chr(i) for i in range(256) if chr(i).isalpha()]
    words = [*letters, *(f"x{c}Yb" for c in letters), "ÀÉÎ", "straßeº", "OThe", "thatableble" * 40]
    encoder = ChunkEncoder(WORD)
    found = encoder._of_words(words)
    assert encoder._words is not None and tokens.word_tokenizer(tokenizer(BYTE)) is None
    assert [np.frombuffer(found[w], "<u4").tolist() for w in words] == [ids_of(WORD, w) for w in words]
    encoder._words = None
    assert encoder._of_words(words) == found


def test_words_met_again_are_kept_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    encoder, asked, of_words = ChunkEncoder(WORD), [], ChunkEncoder._of_words
    monkeypatch.setattr(ChunkEncoder, "_of_words", lambda self, words: asked.extend(words) or of_words(self, words))
    for i in range(20):
        text = f"often again {chr(97 + i)}x{chr(98 + i)} {chr(97 + i)}y{chr(98 + i)}"
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == [*ids_of(WORD, text), 2]
    assert asked.count("often") == asked.count("again") == 1 and len(asked) == 42
    assert len(encoder._known) + len(encoder._older) <= 16


def test_batches_are_encoded_together_and_handed_on_by_slices(monkeypatch):
    texts = [None, "", *HARD, *(f"again word{chr(97 + i)}x " * 30_000 for i in range(4)), "again"]
    calls, encode = [], ChunkEncoder.encode
    monkeypatch.setattr(ChunkEncoder, "encode", lambda self, texts: calls.append(len(texts)) or encode(self, texts))
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i, i]), "text": pa.array([t, t], pa.string())}) for i, t in enumerate(texts)]
    found = list(tokens.encoded(iter(batches), WORD))
    assert calls == [2 * len(texts)] and len(found) > 2
    assert [i for part, _, _ in found for i in part.column("doc_id").to_pylist()] == [i // 2 for i in range(2 * len(texts))]
    expected = {t: [*ids_of(WORD, t), 2] for t in texts}
    for part, ids, bounds in found:
        assert bounds[0] == 0 and bounds[-1] == len(ids)
        for text, begin, end in zip(part.column("text").to_pylist(), bounds[:-1], bounds[1:], strict=True):
            assert ids[begin:end].tolist() == expected[text]
    monkeypatch.setattr(tokens, "RUN_BYTES", 500_000)
    calls.clear()
    cut = list(tokens.encoded(iter(batches), WORD))
    assert len(calls) == 8 and np.concatenate([i for _, i, _ in cut]).tolist() == np.concatenate([i for _, i, _ in found]).tolist()


def test_long_chunks_are_not_remembered():
    encoder, lines = ChunkEncoder(WORD), ["ab" * 200, "你好" * 100, "short", "你好"]
    for _ in range(2):
        ids, bounds = encoder.encode(pa.array(lines))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*ids_of(WORD, t), 2] for t in lines]
        assert sorted(encoder._known.to_pylist()) == ["short", "你好"]


def test_counts_are_the_librarys():
    proved = token_counts.whole_tokens(BYTE)
    assert len(proved) > 40_000
    counter = token_counts.TokenCounter(BYTE, proved)
    for text in HARD:
        assert counter.count(text) == len(ids_of(BYTE, text)), text


def test_count_query(spark):
    rows = queries.op10_token_counts(spark, SMALL).collect()
    texts = small_texts(spark)
    assert len(rows) == len(texts)
    for r in rows:
        n = len(ids_of(BYTE, texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 512)


@pytest.mark.parametrize("widths", [(8, 8, 16), (16, 16), (8, 8, 8, 8)])
def test_codes_round_trip_and_random_access(widths):
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        codes = dac_codes.Codes(dac_codes.encode(ids, widths))
        assert codes.all().tolist() == ids.tolist()
        assert [codes[i] for i in range(0, n, 7)] == ids[::7].tolist()
    with pytest.raises(IndexError):
        codes[n]


def test_token_files_query(spark):
    rows = sorted(queries.op4_token_files(spark, SMALL).collect(), key=lambda r: r.doc_id)
    at, texts = 0, small_texts(spark)
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*ids_of(WORD, texts[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_packing_query(spark):
    rows = queries.op9_pow2_packing(spark, SMALL).collect()
    texts, pieces = small_texts(spark), {}
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    for r in rows:
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for doc_id, own in pieces.items():
        ids = [*ids_of(WORD, texts[doc_id]), 2]
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        assert sum(r.length for r in own) == len(ids)


def test_odd_rows_and_empty_tables(spark, odd):
    n = odd.count()
    assert token_counts.token_counts(odd, BYTE).count() == n
    assert dac_codes.read_back(dac_codes.written(odd, WORD)).count() == n
    packed = pow2_packing.packed(odd, WORD).collect()
    assert sum(r.start == 0 for r in packed) == n
    empty = spark.createDataFrame([], DOCS)
    assert token_counts.token_counts(empty, BYTE).count() == 0
    assert dac_codes.read_back(dac_codes.written(empty, WORD)).count() == 0
    assert pow2_packing.packed(empty, WORD).count() == 0


def test_pieces_share_the_memory_of_the_ids():
    sizes = [1, 13, 8, 3 * 8 + 5]
    ids, bounds = np.arange(sum(sizes), dtype="<u4"), np.cumsum([0, *sizes])
    seen = np.zeros(4, dtype=np.int64)
    found = pow2_packing.cut_up(7, seen, pa.array([5, None, 5, 6]), ids, bounds, 8)
    assert found.column("ids").buffers()[2].address == ids.ctypes.data
    expected, count = [], [0] * 4
    for doc_id, begin, n in zip([5, None, 5, 6], bounds.tolist(), sizes):
        start = 0
        for length in pow2_packing.powers(n, 8):
            bucket = length.bit_length() - 1
            raw = ids[begin + start : begin + start + length].tobytes()
            expected.append((7, bucket, count[bucket], doc_id, start, length, n, raw))
            count[bucket] += 1
            start += length
    assert [tuple(r.values()) for r in found.to_pylist()] == expected and seen.tolist() == count
