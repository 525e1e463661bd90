"""Encoding whole texts with a tokenizer file, a batch of Arrow rows at a time.

A text is split at ASCII white space in Arrow; each distinct chunk of a slice is
encoded once by the tokenizers library and the ids are gathered in numpy.  This
equals encoding the whole text for tokenizers that never look across white
space, whose pre-tokeniser drops it, cuts between a letter and a full stop or
comma, and which lower-case their input, as word_bpe_49k does: NORMALIZER,
PRE_TOKENIZER and WORD_END are what is looked for in the file, and any other
tokenizer encodes whole texts.  Chunks whose normal form is letters alone are
encoded many in one string: their last id, and no other, is one of a token that
ends a word.  Chunks that hold an added token's string (`<|endoftext|>`) go to
the library as they are, which gives that token's id as it does in a whole text.
tests/llm/test_tokens.py compares all this with the library.  Null texts count
as empty.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20  # text encoded at once; one longer text is a slice of its own
JOINED = 4000  # words of one string
AT_ONCE = 100_000  # characters given to the library at once: what it returns takes many times their size
WORD_END = "</w>"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {
        "type": "Split",
        "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def gather(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[begins[0]:begins[0] + lengths[0]], then the next range, and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64  # half the memory
    at = np.repeat((begins - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return pool[at]


def splits_words(spec: dict) -> bool:
    """Whether a tokenizer file is of the form that chunks may be encoded apart in."""
    normal, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    as_known = normal.get("normalizers") == NORMALIZER and pre.get("pretokenizers") == PRE_TOKENIZER
    return plain and as_known and model.get("type") == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout")


def _is_word(stem: str) -> bool:
    """Whether the tokenizer's normal form of this is letters alone: `İ` becomes a letter and a mark."""
    return stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha()


class ChunkEncoder:
    """White-space-free chunks to ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.in_chunks = splits_words(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.added = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the chunks end to end, and how many each has."""
        coded, sizes = [np.zeros(0, np.uint32)], []
        ends = np.cumsum([len(c) for c in chunks]) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(chunks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for e in self.tokenizer.encode_batch_fast(chunks[a:b], add_special_tokens=False):
                coded.append(np.array(e.ids, dtype=np.uint32))
                sizes.append(len(coded[-1]))
        return np.concatenate(coded), np.array(sizes, dtype=np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for chunks of letters alone; None if one is more than a word to the tokenizer."""
        joined = [" ".join(words[a : a + JOINED]) for a in range(0, len(words), JOINED)]
        ids, _ = self._each(joined)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return None
        return ids, np.diff(ends, prepend=0)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        low = pc.ascii_lower(chunks)
        stem = pc.utf8_rtrim(low, characters=".,")
        tail = pc.subtract(pc.binary_length(low), pc.binary_length(stem)).to_numpy()
        letters = pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False) & (tail <= 1)
        odd = np.flatnonzero(letters & ~pc.string_is_ascii(stem).to_numpy(zero_copy_only=False))
        letters[odd] = [_is_word(x) for x in stem.take(pa.array(odd)).to_pylist()]
        if self.added:  # such a string is met before anything is lower-cased
            low = pc.if_else(pc.match_substring_regex(chunks, self.added), chunks, low)
        words = stem.filter(pa.array(letters)).dictionary_encode()
        as_words = self._words(words.dictionary.to_pylist())
        if as_words is None:
            return self._each(chunks.to_pylist())
        others = low.filter(pa.array(~letters)).dictionary_encode()
        parts = [as_words, self._each(others.dictionary.to_pylist()), self._each([".", ","])]
        pool, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        begins = np.cumsum(lengths) - lengths
        n_words, n_others = len(words.dictionary), len(others.dictionary)
        # two entries for each chunk: its word or itself, and its full stop or comma if any
        entry = np.full((len(chunks), 2), -1, dtype=np.int64)
        entry[letters, 0] = words.indices.to_numpy()
        entry[~letters, 0] = n_words + others.indices.to_numpy()
        closed = letters & (tail == 1)
        stop = pc.ends_with(low, ".").to_numpy(zero_copy_only=False)
        entry[closed, 1] = n_words + n_others + np.where(stop[closed], 0, 1)
        sizes = np.where(entry >= 0, lengths[entry], 0)
        return gather(pool, begins[entry].ravel(), sizes.ravel()), sizes.sum(axis=1)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each closed by end_id, and where each text begins."""
        if not self.in_chunks:
            ids, each = self._each(texts.fill_null("").to_pylist())
            return self._closed(ids, np.cumsum(each), end_id)
        parts = pc.ascii_split_whitespace(texts.fill_null(""))
        words = parts.flatten().dictionary_encode()
        pool, lengths = self._distinct(words.dictionary)
        which = words.indices.to_numpy()
        of_text = np.asarray(parts.offsets)[1:] - parts.offsets[0].as_py()
        del parts, words  # the text once more
        each = lengths[which]
        ids = gather(pool, (np.cumsum(lengths) - lengths)[which], each)
        return self._closed(ids, np.concatenate([[0], np.cumsum(each)])[of_text], end_id)

    @staticmethod
    def _closed(ids: np.ndarray, closes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.insert(ids, closes, np.uint32(end_id)) if len(closes) else ids
        starts = np.concatenate([[0], closes + np.arange(1, len(closes) + 1)]).astype(np.int64)
        return ids, starts


@lru_cache(maxsize=4)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One for each worker process and file."""
    return ChunkEncoder(path)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about `limit` bytes of text, or of one row."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    group = (np.cumsum(sizes) // limit).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
