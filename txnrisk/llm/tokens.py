"""Words of Arrow text columns as 64-bit hashes, by numpy over whole blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; arrays take about 40 times as much.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    code = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    powers = []
    for b in (_BASE, inverse):
        x = np.full(BLOCK + 1, b, np.uint64)
        x[0] = 1
        powers.append(np.multiply.accumulate(x))
    return code, powers[0], powers[1]


_cache: list = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column, and its offsets; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off.astype(np.int64)


def row_blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def _piece(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one piece; blanks (<= 32) and
    the starts of ``rows`` separate."""
    if not _cache:
        _cache.extend(_tables())
    code, up, down = _cache
    word = buf > 32
    goes_on = np.append(False, word[:-1] & word[1:])  # whether the byte before is of the same word
    goes_on[rows[rows < len(buf)]] = False
    starts, ends = np.flatnonzero(word & ~goes_on), np.flatnonzero(word & ~np.append(goes_on[1:], False)) + 1
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(code[buf] * up[:len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def words(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words of ``buf``, whose rows start at
    ``rows``.  A long buffer (one row, see ``row_blocks``) is cut at blanks; a
    single word over ``BLOCK`` bytes counts as several."""
    if len(buf) <= BLOCK:
        return _piece(buf, rows) if len(buf) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    out, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + BLOCK)
        if end < len(buf):
            blank = np.flatnonzero(buf[at:end] <= 32)
            end = at + int(blank[-1]) + 1 if len(blank) else end
        h, s, e = _piece(buf[at:end], rows[:0])
        out.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` entries."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[j:len(h) - k + 1 + j]
    return mix(out)


def in_sorted(x: np.ndarray, known: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Where ``x`` is in the sorted ``known``; the bitmap of low bits (see
    ``low_bits``) answers for nearly all."""
    maybe = np.flatnonzero(bitmap[(x & np.uint64(len(bitmap) - 1)).astype(np.int64)])
    at = np.searchsorted(known, x[maybe])
    at[at == len(known)] = 0
    return maybe[known[at] == x[maybe]] if len(known) else maybe[:0]


def low_bits(known: np.ndarray, bits: int = 22) -> np.ndarray:
    out = np.zeros(1 << bits, bool)
    out[(known & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return out
