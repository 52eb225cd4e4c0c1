"""Counting quotient filters that lose nothing: compact sorted counters of packed n-grams.

A key is several numbers of ``bits`` bits each, packed side by side in 64-bit
limbs.  An invertible permutation spreads it evenly over its width; then the
top bits of the first limb are the shard, the next ones the quotient, and all
other bits the remainder, which is stored whole: so keys can be read back and
never collide.  A filter is sorted by (quotient, remainder).  Its quotients are
written in unary (a zero for each slot, a one for each entry in it, about three
bits an entry), its remainders in whole bytes, its counters as a bit that tells
whether there is more than one, a byte for those, and counts of 255 and more
apart.  Sorted filters of one shard merge by their keys.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tessera.llm.textarrays import MIX1, MIX2, mix

_U = np.uint64
_HEADER = struct.Struct("<QQHBB")
_MASK64 = (1 << 64) - 1


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1 if bits < 64 else _MASK64)


def _inverse(odd: np.uint64, bits: int = 64) -> np.uint64:
    return _U(pow(int(odd), -1, 1 << bits))


def _salt(odd: np.uint64, i: int) -> np.uint64:
    return _U(int(odd) * 2 * i & _MASK64)


def _unmix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _inverse(MIX2)
    h ^= h >> _U(33)
    h = h * _inverse(MIX1)
    return h ^ (h >> _U(33))


def pack(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Limbs (the lowest first) of keys whose numbers are in ``columns``."""
    limbs = [np.zeros(len(columns[0]), _U) for _ in range(-(-bits * len(columns) // 64))]
    for c in columns:
        for i in range(len(limbs) - 1, 0, -1):
            limbs[i] = (limbs[i] << _U(bits)) | (limbs[i - 1] >> _U(64 - bits))
        limbs[0] = (limbs[0] << _U(bits)) | c.astype(_U)
    return limbs


def unpack(limbs: list[np.ndarray], bits: int, n: int) -> list[np.ndarray]:
    limbs, columns = list(limbs), []
    for _ in range(n):
        columns.append((limbs[0] & _mask(bits)).astype(np.int64))
        for i in range(len(limbs)):
            above = limbs[i + 1] << _U(64 - bits) if i + 1 < len(limbs) else _U(0)
            limbs[i] = (limbs[i] >> _U(bits)) | above
    return columns[::-1]


def _rest_bits(width: int) -> list[int]:
    """Bits of the limbs after the first."""
    return [min(64, width - 64 * i) for i in range(1, -(-width // 64))]


def permute(limbs: list[np.ndarray], width: int) -> list[np.ndarray]:
    """A bijection of ``width``-bit keys that spreads them evenly over the first limb."""
    first, rest = limbs[0], limbs[1:]
    if not rest:
        shift, mask = _U(width // 2 + 1), _mask(width)
        first = first ^ (first >> shift)
        first = (first * MIX1) & mask
        first ^= first >> shift
        first = (first * MIX2) & mask
        return [first ^ (first >> shift)] if width > 1 else [first]
    for i, x in enumerate(rest, 1):
        first = first ^ mix(x + _salt(MIX1, i))
    first = mix(first)
    return [first] + [x ^ (mix(first + _salt(MIX2, i)) & _mask(b)) for i, (x, b) in enumerate(zip(rest, _rest_bits(width), strict=True), 1)]


def restore(limbs: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The inverse of ``permute``."""
    first, rest = limbs[0], limbs[1:]
    if not rest:
        shift, mask = _U(width // 2 + 1), _mask(width)
        if width == 1:
            return [first]
        first = first ^ (first >> shift)
        first = (first * _inverse(MIX2, width)) & mask
        first ^= first >> shift
        first = (first * _inverse(MIX1, width)) & mask
        return [first ^ (first >> shift)]
    rest = [x ^ (mix(first + _salt(MIX2, i)) & _mask(b)) for i, (x, b) in enumerate(zip(rest, _rest_bits(width), strict=True), 1)]
    first = _unmix(first)
    for i, x in enumerate(rest, 1):
        first = first ^ mix(x + _salt(MIX1, i))
    return [first, *rest]


def distinct(limbs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys in order, and for each key given its place among them."""
    order = np.lexsort(tuple(reversed(limbs))) if len(limbs) > 1 else np.argsort(limbs[0], kind="stable")
    ordered = [x[order] for x in limbs]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ordered])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return [x[new] for x in ordered], place


def shard_of(first: np.ndarray, width: int, shard_bits: int) -> np.ndarray:
    w = min(width, 64)
    return (first >> _U(w - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(first), np.int64)


@dataclass
class QuotientFilter:
    """Sorted distinct permuted keys of one shard, with their counts."""

    width: int
    shard_bits: int
    shard: int
    limbs: list[np.ndarray]
    counts: np.ndarray

    def to_bytes(self) -> bytes:
        n, own = len(self.counts), min(self.width, 64) - self.shard_bits
        q = min(own, n.bit_length())
        low = self.limbs[0] & _mask(own)
        left = own - q
        quotient = (low >> _U(left)).astype(np.int64) if left < 64 else np.zeros(n, np.int64)
        slots = np.zeros(n + (1 << q), np.uint8)
        slots[quotient + np.arange(n)] = 1
        parts = [_HEADER.pack(n, self.shard, self.width, self.shard_bits, q), np.packbits(slots).tobytes()]
        for x, bits in zip([low & _mask(left), *self.limbs[1:]], [left, *_rest_bits(self.width)], strict=True):
            parts.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :-(-bits // 8)]).tobytes())
        more = self.counts > 1
        parts.append(np.packbits(more).tobytes())
        parts.append(np.minimum(self.counts[more], 255).astype(np.uint8).tobytes())
        parts.append(self.counts[self.counts >= 255].astype("<i8").tobytes())
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        n, shard, width, shard_bits, q = _HEADER.unpack_from(data)
        own, at = min(width, 64) - shard_bits, _HEADER.size
        slots = n + (1 << q)
        size = -(-slots // 8)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=slots))
        at += size
        columns = []
        for bits in [own - q, *_rest_bits(width)]:
            size = -(-bits // 8)
            x = np.zeros((n, 8), np.uint8)
            x[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
            columns.append(x.view("<u8").reshape(n).astype(_U))
            at += n * size
        quotient = (ones - np.arange(n)).astype(_U)
        if own - q < 64:
            columns[0] |= quotient << _U(own - q)
        if shard_bits:
            columns[0] |= _U(shard) << _U(own) if own < 64 else _U(0)
        more = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)
        at += -(-n // 8)
        counts = np.ones(n, np.int64)
        counts[more] = np.frombuffer(data, np.uint8, int(more.sum()), at)
        counts[counts == 255] = np.frombuffer(data, "<i8", int((counts == 255).sum()), at + int(more.sum()))
        return cls(width, shard_bits, shard, columns, counts)

    @staticmethod
    def merge(filters: list[QuotientFilter]) -> tuple[QuotientFilter, np.ndarray]:
        """One filter with summed counts, and for each entry of the inputs, in turn, its place in it."""
        head = filters[0]
        limbs, place = distinct([np.concatenate([f.limbs[i] for f in filters]) for i in range(len(head.limbs))])
        every = np.concatenate([f.counts for f in filters])
        counts = np.zeros(len(limbs[0]), np.int64)
        np.add.at(counts, place, every)
        return QuotientFilter(head.width, head.shard_bits, head.shard, limbs, counts), place

    def where(self, keep: np.ndarray) -> QuotientFilter:
        return QuotientFilter(self.width, self.shard_bits, self.shard, [x[keep] for x in self.limbs], self.counts[keep])
