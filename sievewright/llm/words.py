"""Words and word shingles of Arrow string columns as numpy arrays.

A batch is handled in slices of whole texts of about a megabyte, so a task's memory does not grow with its partition.
Hashes depend on the bytes of a word alone: every task on every machine gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, PIECE_BYTES = 1 << 20, 1 << 17
BITS = 44  # of a shingle's identity; the other 20 hold the text's place in its slice
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xC2B2AE3D27D4EB4F

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
_alnum = np.zeros(256, bool)
_alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PUNCTUATED = ~_alnum
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * PIECE_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in the bytes); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def split(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word; a word is a longest run of bytes outside ``gaps`` within one text."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    gap = gaps[data]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins = np.empty(len(data), bool)
    begins[0], begins[1:] = True, gap[:-1]
    begins[heads] = True
    ends = np.empty(len(data), bool)
    ends[-1], ends[:-1] = True, gap[1:]
    ends[heads[heads > 0] - 1] = True
    start = np.flatnonzero(begins & ~gap)
    return start, np.flatnonzero(ends & ~gap) + 1, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, ASCII letters folded to lower case.

    The value does not depend on the word's place, so pieces of whole words are hashed one after another and the tables
    of powers stay as small as a piece (or the longest word).
    """
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + PIECE_BYTES, "right")))
        piece = data[start[first] : end[last - 1]]
        up, down = _power_tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((LOWER[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        begin = start[first:last] - start[first]
        out[first:last] = mix((total[end[first:last] - start[first]] - total[begin]) * down[begin])
        first = last
    return out


def shingles(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each run of ``size`` words; a shorter text has one run of all its words."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    factor = np.cumprod(np.full(size, _STEP, np.uint64), dtype=np.uint64)
    at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.append(at, len(words)))
    full = len(words) - size + 1
    if full > 0:
        value = np.zeros(full, np.uint64)
        for j in range(size):
            value += words[j : j + full] * factor[j]
        first = np.flatnonzero(text[:full] == text[size - 1 :])
        value = value[first]
    else:
        value, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero(count < size)
    if len(few):
        place = np.arange(len(words)) - np.repeat(at, count)
        part = words * factor[np.minimum(place, size - 1)]
        value = np.concatenate([value, np.add.reduceat(part, at)[few] + np.uint64(size)])
        first = np.concatenate([first, at[few]])
        order = np.argsort(first, kind="stable")
        value, first = value[order], first[order]
    return mix(value), text[first], first


def counted(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's shingles sorted: identity (44 bits), text, and how often it came before in the text."""
    both = np.sort((text.astype(np.uint64) << np.uint64(BITS)) | (value >> np.uint64(64 - BITS)))
    new = np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.zeros(0, bool)
    runs = np.flatnonzero(new)
    before = np.arange(len(both)) - np.repeat(runs, np.diff(np.append(runs, len(both))))
    return both & np.uint64((1 << BITS) - 1), (both >> np.uint64(BITS)).astype(np.int64), before
