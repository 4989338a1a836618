"""Token ids of whole texts: each distinct blank-separated chunk is encoded once by the library.

For the word-level vocabulary used here (lower case, white space dropped) a
blank never lies inside a token, so that the ids of a text are those of its
chunks, in order. Texts of plain Latin letters, digits and marks are lower-cased
and their runs of marks set apart first, which changes no id and leaves far
fewer distinct chunks; all others go to the library as they are. Plain words,
most of the distinct chunks, need none of its rules but lower case and byte
letters, and go straight to its model.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfscope.llm.words import gathered, slices, split, texts_of

END_ID = 2
#: Chunks that a worker remembers; those not met for a while are forgotten beyond, which changes the speed alone.
REMEMBERED = 200_000
#: Bytes of a remembered chunk at most; longer ones, as lines without blanks, are encoded whenever met.
LONGEST = 100
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Bytes of texts, with their row's other columns, that are encoded together: what is remembered is laid out once for them.
RUN_BYTES = 6_000_000
#: Characters on which the vocabulary's rules are plain; a special token needs "<|".
PLAIN = f"^[\t\n\r\x20-\x7e{LETTER}×÷¡-©«-±´¶-¸»¿‐-‧€]*$"
#: A run of marks after a letter or digit. One that begins with an apostrophe may be a contraction.
MARKS = rf"([{LETTER}0-9])([^\s{LETTER}0-9'][^\s{LETTER}0-9]*)"


#: Rules under which a word of plain letters is lower-cased and spelt in byte letters, and nothing else, before the model.
WORD_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    found = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in plain]
    return found | {chr(256 + i): b for i, b in enumerate(rest)}


def word_tokenizer(library):
    """The library's model behind a cut at blanks, for words in byte letters; None unless its rules and added tokens allow that.

    Its words differ, so the model remembers none itself.
    """
    from tokenizers import Tokenizer, models
    from tokenizers.pre_tokenizers import WhitespaceSplit

    rules, added = json.loads(library.to_str()), library.get_added_tokens_decoder().values()
    if any(rules[name] != rule for name, rule in WORD_RULES.items()) or not all(re.search(r"[^\w\s]", t.content) for t in added):
        return None
    model = {name: rule for name, rule in rules["model"].items() if rule is not None}
    if model.pop("type") != "BPE":
        return None
    merges = [tuple(m) for m in model.pop("merges")]
    made = Tokenizer(models.BPE(merges=merges, cache_capacity=0, **model))
    made.pre_tokenizer = WhitespaceSplit()
    return made


def _loosened(texts: pa.Array) -> pa.Array:
    plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, "<|")))
    eased = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=MARKS, replacement=r"\1 \2 ")
    return pc.if_else(plain, eased, texts)


def _runs(chunks: pa.Array, n: int = 2000) -> Iterator[pa.Array]:
    """What is encoded at a time: the library's results take far more room than the ids."""
    return (chunks.slice(i, n) for i in range(0, len(chunks), n))


class ChunkEncoder:
    """Encodes texts to ids, with an end id after each."""

    def __init__(self, path: str, end_id: int = END_ID):
        self._tokenizer = tokenizer(path)
        self._end = np.array([end_id], dtype="<u4").tobytes()
        self._words = word_tokenizer(self._tokenizer)
        self._letters = {b: letter for letter, b in byte_alphabet().items() if b != ord(" ")}
        self._known = pa.array([], pa.large_string())
        self._known_ids = pa.array([], pa.large_binary())
        #: For each known chunk, how many runs of texts ago it was last met.
        self._older = np.zeros(0, dtype=np.int64)
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct chunks, encoded by the library."""
        chunks = distinct.to_numpy(zero_copy_only=False).tolist()
        words = [c for c in chunks if c.isalpha() and (c.isascii() or max(c) <= "ÿ")]
        known = self._of_words(words) if words else {}
        rest = [c for c in chunks if c not in known]
        found = self._tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        known.update((c, np.array(e.ids, dtype="<u4").tobytes()) for c, e in zip(rest, found, strict=True))
        return pa.array([known[c] for c in chunks], pa.large_binary())

    def _looked_up(self, values: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Each value's place among the ids of distinct chunks, and these ids: the remembered ones, then those met first here."""
        both = pa.concat_arrays([self._known, values.cast(pa.large_string())]).dictionary_encode()
        codes, distinct = np.asarray(both.indices)[len(self._known) :], both.dictionary
        new = distinct.slice(len(self._known))
        ids = pa.concat_arrays([self._known_ids, *(self._ids(some) for some in _runs(new))])
        older = np.append(self._older + 1, np.zeros(len(new), dtype=np.int64))
        older[codes] = 0
        self._remember(distinct, ids, older)
        return codes, ids

    def _remember(self, chunks: pa.Array, ids: pa.Array, older: np.ndarray) -> None:
        """Keep all for the next texts or, if these are too many, half as many as allowed: those met last."""
        keep = np.flatnonzero(np.asarray(pc.binary_length(chunks)) <= LONGEST)
        if len(keep) > REMEMBERED:
            half = REMEMBERED // 2
            keep = np.sort(keep[np.argpartition(older[keep], half)[:half]])
        if len(keep) < len(chunks):
            chunks, ids, older = chunks.take(pa.array(keep)), ids.take(pa.array(keep)), older[keep]
        self._known, self._known_ids, self._older = chunks, ids, older

    def _of_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of plain words, encoded as one text and cut where a token ends a word; nothing if that doesn't come out."""
        text, library = " ".join(words), self._tokenizer
        if self._words:
            text, library = text.lower().encode().decode("latin-1").translate(self._letters), self._words
        (found,) = library.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        ends = np.flatnonzero(self._ends_word[ids]) + 1
        if len(ends) != len(words):
            return {}
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return {w: raw[a:b] for w, a, b in zip(words, cuts, cuts[1:])}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin and end."""
        values, bounds = split(_loosened(texts), blanks="\n")
        codes, known = self._looked_up(values)
        del values
        pool = pa.concat_arrays([known, pa.array([self._end], pa.large_binary())])
        laid = pool.take(pa.array(np.insert(codes, bounds[1:], len(pool) - 1)))
        _, offsets, data = laid.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64, count=len(laid) + 1) // 4
        ids = np.frombuffer(data, dtype="<u4", count=ends[-1]) if ends[-1] else np.zeros(0, "<u4")
        pa.default_memory_pool().release_unused()
        return ids, ends[bounds + np.arange(len(bounds))]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int = END_ID) -> ChunkEncoder:
    """The worker's own encoder, kept from task to task."""
    return ChunkEncoder(path, end_id)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about a slice's bytes of ``text``, all their ids, and where each text's begin and end."""
    for run in gathered(batches, "text", RUN_BYTES):
        ids, bounds = encoder(path, end_id).encode(texts_of(run, "text"))
        at = 0
        for part in slices(run, "text"):
            own = bounds[at : at + part.num_rows + 1]
            yield part, ids[own[0] : own[-1]], own - own[0]
            at += part.num_rows
