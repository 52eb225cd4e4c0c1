"""Texts as byte arrays: words and their hashes for a whole Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes hashed at once; longer texts are cut at white space and joined again.
PIECE = 1 << 20

#: Fixed odd multipliers of the polynomials.
BASE, MIX1, MIX2 = _U(0x9E3779B97F4A7C15), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random 64-bit value for each byte.
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its offsets (one more than rows); null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(column: pa.Array, limit: int = 4 * PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    data, off = column_bytes(column)
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * MIX1
    h ^= h >> _U(33)
    h = h * MIX2
    return h ^ (h >> _U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        if size <= PIECE * 2:
            _powers.clear()
        inverse = _U(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > PIECE * 2:
            return made
        _powers[size] = made
    return _powers[size]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of ``data``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACES[data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        lo, hi = starts[a], ends[b - 1]
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUE[data[lo:hi]] * up[:hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        hashes[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return starts, ends, hashes


def rolling(hashes: np.ndarray, size: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rabin-Karp polynomial of every ``size`` consecutive word hashes (modulo 2**64)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= base
        out += hashes[k:k + n]
    return out


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text's word hashes; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    k = min(size, len(hashes))
    return np.unique(mix(rolling(hashes, k) + _U(k)))
