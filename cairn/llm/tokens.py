"""Words of many texts at once, as numpy arrays over an Arrow batch's own bytes.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. A word stands for a 64-bit hash: every eight
bytes of it are mixed with their place, the sum is mixed with the length, and no loop runs over words. Of n different words
about n * n / 2^65 pairs share a hash by chance, which is one pair among six billion words; no pattern of letters does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on together; a longer single text makes a larger piece, which takes about ten times its bytes.
PIECE = 2 << 20
#: The last 1 to 8 bytes of a word, by their number.
_ENDS = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], _U)
_STEP = _U(0x9FB21C651E98DF25)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA3B195354A39B70D)
    return h ^ (h >> _U(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about PIECE bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of words before it (one more entry than rows)."""
    n = len(data)
    solid = SOLID[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
        before[at[:-1][at[:-1] < n]] = False
        after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and for each row the number of words before it."""
    starts, ends, rows = word_spans(data, at)
    n, sizes = len(data), ends - starts
    low = np.zeros(n + 8, np.uint8)
    np.take(LOWER, data, out=low[:n])
    eight = np.ndarray(n + 1, "<u8", low, strides=(1,))
    h = mix((eight[starts] & _ENDS[np.minimum(sizes, 8)]) + _STEP)
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8
        first = np.cumsum(more) - more
        k = np.arange(more.sum()) - np.repeat(first, more) + 1
        left = np.minimum(np.repeat(sizes[long], more) - 8 * k, 8)
        parts = mix((eight[np.repeat(starts[long], more) + 8 * k] & _ENDS[left]) + _STEP * (k + 1).astype(_U))
        h[long] += np.add.reduceat(parts, first)
    return mix(h + sizes.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), rows
