"""Words and rolling hashes of UTF-8 texts, vectorised over Arrow string buffers.

Words are the runs matched by ``[^\\x20\\x09-\\x0D]+``. All functions work on one flat byte array that
holds several texts one after another and on the offsets at which they begin, so that a task handles
some megabytes of documents at a time in a fixed amount of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time. Temporaries take about 40 times as much.
CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of values[starts[i]:ends[i]] for every i, from one running sum of powers."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _pow(base, n), out=sums[1:])
    inverse = _pow(pow(base, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and the number of words before each text (len(offsets) counts).

    offsets has the first byte of every text and, last, the end.
    """
    inside = ~_SEPARATOR[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    before[offsets[offsets < len(data)]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = False, inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    table = (_LOWER if lower else _AS_IS).astype(np.uint64) + np.uint64(1)
    return span_hashes(table[data], starts, ends)


def window_starts(firsts: np.ndarray, width: int, n: int) -> np.ndarray:
    """The words, of n, at which a run of ``width`` words of one text begins."""
    ok = np.ones(max(0, n - width + 1), bool)
    for b in firsts[1:-1]:  # a run that begins in the last width - 1 words of a text would cross its end
        ok[max(0, b - width + 1) : b] = False
    return np.flatnonzero(ok)


def window_hashes(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of one text, and the word at which each begins."""
    at = window_starts(firsts, width, len(hashes))
    if not len(at):
        return np.empty(0, np.uint64), at
    return span_hashes(hashes, at, at + width, 0xD6E8FEB86659FD93), at


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for pieces of a string column; null counts as empty.

    A piece has at most ``most`` bytes, or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
