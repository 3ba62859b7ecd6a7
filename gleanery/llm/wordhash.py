"""Vectorised 64-bit hashes of words and shingles straight from Arrow's UTF-8 buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These bytes never occur
inside a multi-byte UTF-8 sequence, so working on bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, SLICE_BYTES), base, dtype=np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def forget_powers() -> None:
    """Drop what ``powers`` keeps; it has 8 bytes for each byte of the longest text met."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [first, last) whose texts have about ``most`` bytes, with their bytes and offsets.

    A longer text makes a slice of its own; texts are never cut. Nulls have no bytes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it lies in."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, with A-Z lower-cased."""
    starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[LOWER[data]] * powers(BASE, len(data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64)
    return mix(h), rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, ordered by row and hash.

    A row with fewer than ``width`` words but at least one has its whole word sequence as its
    only shingle; a row without words has none.
    """
    words, rows = word_hashes(data, offsets)
    if not len(words):
        return words, rows
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    firsts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = mix(h * U(BASE) + words[k : k + n])
        whole = rows[:n] == rows[width - 1 :] if n else np.zeros(0, bool)
        h, owner = h[whole], rows[:n][whole]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            s = counts[short].astype(np.uint64)
            for k in range(width - 1):
                has = counts[short] > k
                s[has] = mix(s[has] * U(BASE) + words[firsts[short[has]] + k])
            h, owner = np.concatenate([h, s]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]
