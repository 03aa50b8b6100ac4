"""Words of many UTF-8 texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB_BYTES = 4_000_000
_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: everything but ASCII white space; and ASCII letters and digits with all non-ASCII.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of whole texts of about ``limit`` bytes (one longer text is a run of its own).

    Gives first row, end row, bytes, and offsets of the texts in these bytes. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each text (with the total at the end)."""
    inside = kinds[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[1:], before[0] = inside[:-1], False
        after[:-1], after[-1] = inside[1:], False
        before[offsets[:-1][offsets[:-1] < len(inside)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    letters = LOWER[data[kinds[data]]]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    return mix(np.add.reduceat(BYTE_CODE[letters] * powers[place], first))


def sequence_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words of one array of word hashes."""
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += words[i : i + n] * np.uint64(2 * i + 3) ^ (words[i : i + n] >> np.uint64(17 + i))
    return mix(out * BASE)
