"""Words of whole Arrow text columns as numpy arrays, and 64-bit hashes of them.

Bytes of UTF-8 text are compared with byte tables; no character outside ASCII is a separator, so
no word is ever cut inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes hashed at once: the work arrays stay in the processor's cache

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes.translate table: A-Z lower-cased, ASCII that is neither letter nor digit made a space.
PLAIN_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(max(n, BLOCK + 1), base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK, cut between rows or, within a long row, at white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + BLOCK, end)
        if to < end:
            row_end = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if row_end > at:
                to = row_end
            else:
                width = BLOCK
                row_stop = int(offsets[np.searchsorted(offsets, at, "right")])
                while True:
                    space = np.flatnonzero(SPACE[data[max(at + 1, to - 65536) : to]])
                    if len(space):
                        to = max(at + 1, to - 65536) + int(space[-1])
                        break
                    if to >= row_stop:
                        to = row_stop
                        break
                    width *= 2
                    to = min(at + width, row_stop)
        yield at, to
        at = to


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that are not ASCII white space), the row of each word,
    and the place of each row's first word (one entry more than rows)."""
    data, offsets = text_bytes(column)
    hashes, starts = [], []
    for lo, hi in _blocks(data, offsets):
        part = data[lo:hi]
        inside = ~SPACE[part]
        first = np.zeros(hi - lo + 1, bool)
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")]
        first[inner - lo] = True
        first[0] = first[-1] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | first[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        power, inverse = _power_tables(hi - lo + 1)
        value = _BYTE_VALUE[LOWER[part] if lower else part] * power[: hi - lo]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * inverse[s]))
        starts.append(s + lo)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    bounds = np.searchsorted(at, offsets)
    return words, row, bounds


def shingle(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; with fewer words, of the whole sequence; else none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix(h * _U(0xD6E8FEB86659FD93) + words[k : k + n])
    return h
