"""Vectorised text primitives that run inside Arrow batches: words, rolling hashes, sliding minima.

Words are maximal runs of bytes other than space and 0x09-0x0D. UTF-8 never uses those bytes inside a
longer character, so byte words equal code-point words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEED = np.random.default_rng(20240229)
BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_CODE_2 = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_2 = U(0xD6E8FEB86659FD93)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each row (one more than rows). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 19):
    """Ranges of rows of about so many bytes together; a longer row is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INV: dict[int, np.uint64] = {}


def inverse(base: np.uint64) -> np.uint64:
    if int(base) not in _INV:
        _INV[int(base)] = U(pow(int(base), -1, 1 << 64))
    return _INV[int(base)]


class SpanHash:
    """Hashes of any span of a byte or code array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, codes: np.ndarray, base: np.uint64 = BASE):
        n = len(codes)
        self.back = powers(inverse(base), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(base, n)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, codes=BYTE_CODE) -> np.ndarray:
    return SpanHash(codes[raw]).of(start, end)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive codes: by doubling, so that it takes log2(n) passes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, size = h, 1
    while size * 2 <= n:
        out = _join(out[:-size], out[size:])
        size *= 2
    if size < n:
        out = _join(out[: len(out) - (n - size)], out[n - size :])
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * BASE
    x += b
    x ^= x >> U(29)
    x *= _M1
    x ^= x >> U(32)
    return x


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    if len(h) < n:
        return np.zeros(0, h.dtype)
    size = 1
    while size * 2 <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return h if size == n else np.minimum(h[: len(h) - (n - size)], h[n - size :])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of true flags."""
    d = np.diff(np.concatenate(([0], flags.view(np.int8) if flags.dtype == bool else flags, [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the n positions that lie in any of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0
