"""Word shingles of whole texts as sorted arrays of 64-bit hashes, in numpy.

Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return; A-Z is lower-cased. A text with fewer words than the shingle
length is one shingle, a text without words has none. Different shingles share a hash
with probability 2**-64; that is the only way a count can be off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
BLOCK_BYTES = 1 << 19

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_FACTORS = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = _powers[name] = np.cumprod(full)
    return have[:n]


def word_hashes(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the joined texts, and the first word's number per text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts_of_texts), np.int64)
    solid = ~_BLANK[data]
    cut = np.zeros(n + 1, bool)  # a text begins here, or the data ends
    cut[np.minimum(starts_of_texts, n)] = True
    cut[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    begin = np.nonzero(solid & (~before | cut[:n]))[0]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.nonzero(solid & (~after | cut[1:]))[0] + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=sums[1:])
    down = _power("down", pow(_BASE, -1, 1 << 64), n)
    words = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return words, np.searchsorted(begin, starts_of_texts)


def shingle_sets(texts: pa.Array, k: int = WORDS, unique: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order; null texts have none."""
    for lo, hi, data, offsets in blocks(texts):
        words, first = word_hashes(data, offsets[:-1])
        bounds = np.append(first, len(words))
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        joined = np.zeros(len(words), np.uint64)
        for j in range(k):
            joined += padded[j : j + len(words)] * _FACTORS[j]
        joined = mix(joined)
        for i in range(hi - lo):
            a, b = bounds[i], bounds[i + 1]
            if b == a:
                yield np.zeros(0, np.uint64)
            elif b - a < k:
                yield mix((words[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                own = joined[a : b - k + 1]
                yield np.unique(own) if unique else own


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of some megabytes: row numbers, joined bytes, start of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, where, content = texts.buffers()
    ends = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    joined = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + BLOCK_BYTES, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, joined[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
