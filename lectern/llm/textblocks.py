"""Vectorised views of text columns for Arrow-batch operators.

A *block* is a run of whole rows of one Arrow string column, seen as one uint8
array plus row boundaries.  Blocks are cut by bytes, so the numpy temporaries of
a caller stay proportional to ``max_bytes`` (or to one document, if it is
longer); no text is ever shortened.  Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, and never cross a row boundary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words (the split-mix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_BYTE_CODE = seeds(256, 0x5EED)


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


@dataclass
class Block:
    """Rows ``lo`` to ``hi`` of a batch: bytes, and where each row starts and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    valid: np.ndarray

    def row_text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array | pa.ChunkedArray, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column in row order; null rows count as empty and are marked in ``valid``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        base = offsets[lo]
        yield Block(lo, hi, raw[base : offsets[hi]], offsets[lo:hi] - base, offsets[lo + 1 : hi + 1] - base, valid[lo:hi])
        lo = hi


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words of each row) of all words of a block, in order."""
    d = block.data
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block.starts), np.int64)
    inside = ~IS_SPACE[d]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = block.starts[(block.starts > 0) & (block.starts < len(d))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, block.ends) - np.searchsorted(s, block.starts)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by prefix sums of a polynomial; equal bytes hash alike anywhere."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power_table(_BASE, len(data)), out=prefix[1:])
    h = (prefix[e] - prefix[s]) * _power_table(_BASE_INV, len(data) + 1)[s]
    return mix64(h ^ (e - s).astype(np.uint64) * _MIX1)


def windows(hashes: np.ndarray, counts: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and their number by row; a row of fewer words gives one window of all, if ``short``."""
    n = len(hashes)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    per_row = np.maximum(counts - k + 1, 0)
    at = np.repeat(first, per_row) + (np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row))
    coeff = seeds(k, 0xC0EF) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out += hashes[at + j] * coeff[j]
    out = mix64(out)
    if short:
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            extra = np.array([mix64((hashes[first[r] : first[r] + counts[r]] * coeff[: counts[r]]).sum(keepdims=True) ^ np.uint64(counts[r]))[0] for r in few], np.uint64)
            where = np.cumsum(per_row)[few]
            out = np.insert(out, where, extra)
            per_row = per_row.copy()
            per_row[few] = 1
    assert n >= 0
    return out, per_row
