"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of ASCII letters and digits and of non-ASCII bytes, after lower-casing.
All texts of a block are hashed together with array operations: a running sum of
bytes times powers of an odd number gives the polynomial hash of every word, and
neighbouring words' hashes are combined into the shingle's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once (a longer text is hashed alone).
BLOCK_BYTES = 250_000

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Block:
    """Texts ``first`` to ``first + texts`` of an array.

    Words of text i are ``word_at[i]:word_at[i + 1]`` of ``words`` (hashes), and its
    shingles ``at[i]:at[i + 1]`` of ``hashes``. A text of fewer words than a shingle
    has is one shingle; a text without words has none.
    """

    first: int
    texts: int
    words: np.ndarray
    word_at: np.ndarray
    hashes: np.ndarray
    at: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers[0], _powers[1]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts ``offsets`` cuts ``data`` into, and where each text's words begin."""
    is_word = WORD_BYTE[data]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = is_word[inner]
    ends[inner - 1] = is_word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start])
    return hashes, np.searchsorted(start, offsets)


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring words."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = out * _STEP + words[j : len(words) - k + 1 + j]
    return mix(out)


def blocks(texts: pa.Array, k: int) -> Iterator[Block]:
    """The texts of an Arrow array (null counts as empty), a block at a time."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
        last = min(last, len(texts))
        lo, hi = offsets[first], offsets[last]
        words, word_at = _word_hashes(data[lo:hi], offsets[first : last + 1] - lo)
        yield _block(first, words, word_at, k)
        first = last


def _block(first: int, words: np.ndarray, word_at: np.ndarray, k: int) -> Block:
    counts = np.diff(word_at)
    runs = combine(words, k)
    whole = np.repeat(word_at[1:], counts)  # where the text of each word ends
    inside = (whole - np.arange(len(words)) >= k)[: len(runs)]
    short = np.flatnonzero((counts > 0) & (counts < k))
    sizes = np.where(counts >= k, counts - k + 1, counts > 0)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    if len(short):
        hashes = np.zeros(at[-1], np.uint64)
        of_long = np.ones(len(hashes), bool)
        of_long[at[short]] = False
        hashes[of_long] = runs[inside]
        for i in short:
            hashes[at[i]] = combine(words[word_at[i] : word_at[i + 1]], counts[i])[0] ^ np.uint64(counts[i])
    else:
        hashes = runs[inside]
    return Block(first, len(counts), words, word_at, hashes, at)
