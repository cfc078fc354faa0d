"""Vectorised text primitives shared by the operators that run on Arrow batches.

A batch of texts is one byte buffer and document offsets; words, rolling hashes and window minima are numpy passes
over that buffer, so the cost is a few nanoseconds a byte and nothing loops over words in Python. Buffers are cut at
document borders into chunks of about ``CHUNK`` bytes, which bounds the memory however large the Arrow batch is.

Hashes are two polynomials modulo the prime 2**31 - 1, each at a base of its own, joined and mixed: 62 bits. Two different strings
of n values collide with a chance near 2**-62, and whatever their structure not above (n / 2**31)**2 over the choice of bases.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 19
_PRIME = np.uint64(2**31 - 1)
#: Bases of bytes within words, and of any other sequence.
_IN_WORDS, _ANY = (1_270_406_117, 1_839_501_773), (1_581_277_801, 1_144_938_649)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII white space, code points 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, int(_PRIME))) % _PRIME
        have += more
    return out


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime, at least n of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK + 4096)
        _powers[base] = have = (_table(base, n), _table(pow(base, -1, int(_PRIME)), n))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hash of any slice [start, end) of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, bases: tuple[int, int] = _ANY):
        self.bases, self.sums = bases, []
        for base, lane in zip(bases, (values & _PRIME, values >> np.uint64(33)), strict=True):
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(lane * _pow(base, len(sums))[0][: len(values)] % _PRIME, out=sums[1:])  # below 2**31 each: no overflow
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((s[end] - s[start]) % _PRIME * _pow(base, len(s))[1][start] % _PRIME for base, s in zip(self.bases, self.sums, strict=True))
        with np.errstate(over="ignore"):
            return mix((a << np.uint64(31) | b) + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all slices of k values, in order."""
        n = len(self.sums[0]) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        a, b = ((s[k:] - s[:-k]) % _PRIME * _pow(base, len(s))[1][:n] % _PRIME for base, s in zip(self.bases, self.sums, strict=True))
        return mix(a << np.uint64(31) | b)


_ODD = 0xD1342543DE82EF95
_odd_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def quick_grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all slices of k values, modulo 2**64: a third of the work, but strings made for it collide. For choices in which a collision does no harm."""
    n = len(values) + 1
    if n <= k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(_odd_powers[0]) < n:
            for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
                p = np.full(max(n, CHUNK + 4096), base, np.uint64)
                p[0] = 1
                _odd_powers[i] = np.multiply.accumulate(p, out=p)
        sums = np.zeros(n, np.uint64)
        np.cumsum(values * _odd_powers[0][: n - 1], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * _odd_powers[1][: n - k])


class Chunk(NamedTuple):
    """Whole documents: rows [row, row + n) of their batch, their bytes and offsets into them."""

    row: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a string or binary column (null: empty) at document borders."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return
    _, offsets, values = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    off = np.frombuffer(offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield Chunk(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


class Words(NamedTuple):
    """Words of a chunk: byte bounds and, in ``first``, the index of each document's first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(c: Chunk) -> Words:
    """Maximal runs of bytes that are no ASCII white space; a document's border ends a word."""
    n = len(c.data)
    inside = ~_SPACE[c.data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = c.off[(c.off > 0) & (c.off < n)]
    begin[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(start, end, np.searchsorted(start, c.off))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    return Rolling(_TABLE[data], _IN_WORDS).of(w.start, w.end)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    if len(h) < width:
        return h[:0]
    m, have = h, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all slices [start, start + length), one after another."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    live = lengths > 0
    s, n = starts[live].astype(np.int64), lengths[live].astype(np.int64)
    if not len(s):
        return np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of n cells that lie in any [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of true cells."""
    d = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, sorted."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]
