"""Vectorised work on the UTF-8 bytes of an Arrow text column: words, word hashes, per-document slices.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are 64 bits of a random polynomial over the
A-Z lower-cased bytes; equal words give equal hashes, and different words collide with probability below 2^-50.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time (a longer text is handled alone): bounds a task's memory, never cuts a text.
SLICE_BYTES = 500_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd and 5 modulo 8: full multiplicative order modulo 2^64
if _BASE % 8 != 5:
    _BASE = (_BASE & ~7) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    t = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    t[65:91] = t[97:123]
    return t


BYTE_VALUES = _byte_values()
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Local(dict):
    """A cache that stays in its process: pickling sends it empty."""

    def __reduce__(self):
        return _Local, ()


_POWERS = _Local()


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1), base, dtype=np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= 2 * SLICE_BYTES:  # a very long text's powers are not kept
            _POWERS[base] = have
    return have


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges [i, j) of whole texts with at most ``limit`` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that do not cross a text's bounds."""
    n = len(member)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = member[:-1], member[1:]
    starts = np.flatnonzero(member & (~before | cut[:-1]))
    ends = np.flatnonzero(member & (~after | cut[1:])) + 1
    return starts, ends


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hash of every byte span, in a few passes over the buffer."""
    n = len(buf)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[buf] * _powers(_BASE, n)[:n], out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, n + 1)[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes in order, bounds): text i has hashes[bounds[i]:bounds[i + 1]]. Offsets start at 0."""
    starts, ends = runs(~IS_SPACE[buf], offsets)
    return span_hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def sequence_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[k:k + n])
    return out


def ragged(flat: np.ndarray, offsets, kind=None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, dtype=np.int32)), pa.array(flat, type=kind))
