"""Sets of hashed word shingles, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+`, and each text's first word."""
    words = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = words.flatten().dictionary_encode()
    own = [xxhash.xxh3_64_intdigest(w) if w else 0 for w in flat.dictionary.to_pylist()]
    hashes = np.array(own, dtype=np.uint64)[flat.indices.to_numpy()] if own else np.zeros(0, np.uint64)
    starts = np.asarray(words.offsets) - words.offsets[0].as_py()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    return hashes[real], np.concatenate([[0], np.cumsum(real)])[starts]


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of all its words if they are fewer than n."""
    words, starts = word_hashes(texts)
    rolled = np.zeros(len(words), dtype=np.uint64)
    for i in range(n):
        rolled[: len(words) - i] = rolled[: len(words) - i] * _A + words[i:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _A + w
            out.append(mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
