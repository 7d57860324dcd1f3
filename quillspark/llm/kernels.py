"""numpy kernels over Arrow string columns: words, word hashes and shingle sets without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, hashed to 64 bits by a polynomial over random byte values.
Hashing goes piece by piece, so the scratch memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)) | U64(1)


IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
IS_LETTER = np.zeros(256, dtype=bool)  # letters, and all bytes of characters beyond ASCII
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
IS_ALNUM = IS_LETTER.copy()
IS_ALNUM[48:58] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = randoms(11, 256)[LOWER]
_powers = np.ones(1, dtype=U64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            step = np.full(max(n, 256), 0x9E3779B97F4A7C15 | 1, dtype=U64)
            step[0] = 1
            _powers = np.cumprod(step, dtype=U64)
    return _powers


def segments(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most ``most`` bytes, or of one longer row, of strings or bytes. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1)
        last = min(last, len(column))
        yield row, data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row]
        row = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each row and of the end) for the rows that ``offsets`` cut."""
    hashes, starts_at, at = [], [], 0
    is_start = np.zeros(len(data) + 1, dtype=bool)
    is_start[offsets] = True
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and in_word[data[end]]:
            gap = np.flatnonzero(~in_word[data[end : end + PIECE]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + PIECE)
        piece = data[at:end]
        word = in_word[piece]
        joined = np.zeros(len(piece) + 1, dtype=bool)  # at i: the bytes before and at i belong to one word
        np.logical_and(word[1:], word[:-1], out=joined[1:-1])
        joined[:-1] &= ~is_start[at:end]
        starts = np.flatnonzero(word & ~joined[:-1])
        if len(starts):
            length = np.flatnonzero(word & ~joined[1:]) + 1 - starts
            first = np.cumsum(length) - length
            flat = piece[word]
            place = np.arange(len(flat), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
            value = BYTE_VALUE[flat] * _power(int(length.max()) + 1)[place]
            hashes.append(mix(np.add.reduceat(value, first) + length.astype(U64)))
            starts_at.append(starts + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64)
    starts = np.concatenate(starts_at) if starts_at else np.zeros(0, dtype=np.int64)
    return h, np.searchsorted(starts, offsets)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words, also of runs that cross rows; empty if there are fewer words."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    total = np.zeros(len(h) - n + 1, dtype=U64)
    for i, factor in enumerate(randoms(77, n)):
        total += h[i : len(h) - n + 1 + i] * factor
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``n``-word shingles; of fewer words, of the whole sequence."""
    h, bounds = word_hashes(data, offsets)
    all_runs, factors = windows(h, n), randoms(77, n)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            s = np.sort(all_runs[a : b - n + 1])
            new = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]
        elif b > a:
            yield mix((h[a:b] * factors[: b - a]).sum(dtype=U64, keepdims=True) + U64(int(b - a)))
        else:
            yield np.zeros(0, dtype=U64)
