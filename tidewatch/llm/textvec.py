"""Vectorised word, shingle and n-gram hashes straight from an Arrow string column's buffers.

No Python object is made per word. A word's hash is polynomial over its bytes: prefix sums of
``T[byte] * P**position`` (mod 2**64) give any span's hash as ``(C[end] - C[start]) * P**-start``,
then a finaliser mixes the bits. Equal byte strings have equal hashes wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | U(1)

#: Words are runs of bytes outside this set.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Tokens are runs of ASCII letters, digits and non-ASCII bytes.
NOT_TOKEN = np.ones(256, bool)
NOT_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * MIX1
    x ^= x >> U(27)
    x *= MIX2
    x ^= x >> U(31)
    return x


def slices(texts: pa.Array, most_bytes: int = 1 << 20):
    """``(first row, bytes, offsets)`` of runs of rows with about ``most_bytes`` bytes (one row at
    least); null counts as empty."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64, n + 1 + arr.offset)[arr.offset:]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offs, offs[row] + most_bytes, "right")) - 1))
        yield row, data[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


@dataclass
class Words:
    """Words of a run of rows in reading order."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    rows: int
    sums: np.ndarray
    inverse: np.ndarray

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``longest`` bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        return mix((self.sums[end] - self.sums[self.start]) * self.inverse[self.start])


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = SPACES) -> Words:
    n = len(data)
    inside = ~gaps[data]
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offs[(offs > 0) & (offs < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offs, start, "right") - 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_P, n), dtype=np.uint64, out=sums[1:])
    return Words(start, end, row, len(offs) - 1, sums, powers(_P_INV, n + 1))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of every run of ``size`` words; a row with fewer words has one, of them all."""
    h, n = w.hashes(), len(w.row)
    acc, full = h * _STEP[0], np.ones(n, bool)
    for k in range(1, size):
        # no row is that long if there are no more than k words, but its hash must not depend on that
        m = max(0, n - k)
        same = np.zeros(n, bool)
        same[:m] = w.row[k:] == w.row[:m]
        part = np.zeros(n, np.uint64)
        part[:m] = h[k:] * _STEP[k]
        acc = acc + np.where(same, part, U(k))
        full &= same
    lead = np.ones(n, bool)
    lead[1:] = w.row[1:] != w.row[:-1]
    keep = full | lead
    return w.row[keep], mix(acc[keep])
