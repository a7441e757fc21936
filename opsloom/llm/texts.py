"""Whole texts as byte arrays: slices of Arrow columns, words, word hashes and shingles, all vectorised.

UTF-8 lets both word rules of the operators be told from bytes alone: every byte of a character outside
ASCII is 0x80 or more.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BLOCK = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_TWO64 = 1 << 64


def byte_table(members: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members.encode("latin-1"))] = True
    return table


SPACE = byte_table(" \t\n\v\f\r")
#: Words of the "runs without white space" rule.
SPACED = ~SPACE
#: Words of the "letters and digits" rule, for text whose A-Z are lower-cased.
ALNUM = byte_table("0123456789abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) with about `limit` bytes each; a longer text comes alone. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    offsets, raw = _buffers(column)
    if column.null_count and (np.diff(offsets)[~column.is_valid().to_numpy(zero_copy_only=False)] > 0).any():
        # Bytes behind a null are not text.
        offsets, raw = _buffers(pc.fill_null(column.cast(pa.large_binary()), b""))
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _buffers(column: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    """Offsets and bytes of a text or binary array as they lie in memory, without a copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    every = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return every[column.offset : column.offset + len(column) + 1].astype(np.int64), column.buffers()[2]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true, cut at the bounds of the texts."""
    n = len(inside)
    begin, stop = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        cut = bounds[(bounds > 0) & (bounds < n)]
        begin[cut] |= inside[cut]
        stop[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """64-bit hashes of byte runs from one running polynomial sum; the powers are kept for a block."""

    def __init__(self) -> None:
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
        self._powers(_BLOCK)

    def _powers(self, n: int) -> None:
        self.up = np.full(n + 1, _MULT, np.uint64)
        self.down = np.full(n + 1, pow(_MULT, -1, _TWO64), np.uint64)
        self.up[0] = self.down[0] = 1
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Runs must be in order and must not overlap."""
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
            a, b = starts[at:to] - base, ends[at:to] - base
            if b[-1] > len(self.up) - 1:
                self._powers(int(b[-1]))
            total = np.zeros(int(b[-1]) + 1, np.uint64)
            np.cumsum(self.byte[data[base : base + b[-1]]] * self.up[: b[-1]], out=total[1:])
            out[at:to] = (total[b] - total[a]) * self.down[a] + (b - a).astype(np.uint64)
            at = to
        return mix(out)


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text (and past the last) the number of its first word."""
    starts, ends = runs(table[data], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


_SHINGLE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def window_hashes(words_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` words, whatever text its words are in."""
    m = len(words_hash) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(size):
        total += words_hash[k : k + m] * _SHINGLE[k]
    return mix(total)


def sequence_hash(words_hash: np.ndarray) -> int:
    """Hash of a whole sequence of words, told apart from windows by its length."""
    n = len(words_hash)
    if n == 0:
        return 0
    steps = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_PLACE)) | np.uint64(1)
    return int(mix(np.array([(words_hash * steps).sum(dtype=np.uint64) + np.uint64(n)]))[0])


def shingle_sets(words_hash: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingles; a text of fewer words, but not none, has its whole sequence as one."""
    every = window_hashes(words_hash, size)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield np.array([sequence_hash(words_hash[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit digests of sets (0 for an empty one): for 10^9 distinct sets, 0.03 chance collisions are expected."""
    lengths = np.array([len(x) for x in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        flat = mix(np.concatenate(sets))
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full] = mix(np.add.reduceat(flat, starts) + lengths[full].astype(np.uint64))
    return out


def range_keys(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of ranges of values, in their order; ranges are in order and do not overlap."""
    length = end - begin
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    odd = mix(np.arange(1, (int(length.max()) if len(length) else 0) + 1, dtype=np.uint64) * np.uint64(_PLACE)) | np.uint64(1)
    total = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(values[np.repeat(begin, length) + place] * odd[place], out=total[1:])
    edges = np.concatenate([[0], np.cumsum(length)])
    return mix(total[edges[1:]] - total[edges[:-1]] + length.astype(np.uint64))


_PLACE = 0xE7037ED1A0B428DB


def share(context, value):
    """Broadcast an object by its plain fields, which any worker can read."""
    return context.broadcast(dict(vars(value)))


def shared(kind: type, fields) -> object:
    """The object of a broadcast of `share`, on a worker."""
    value = object.__new__(kind)
    value.__dict__.update(fields.value)
    return value


def kept_in_worker(name: str, make):
    """A value that later tasks of the same Python worker find again."""
    place = sys.modules.setdefault("_opsloom_kept", types.ModuleType("_opsloom_kept")).__dict__
    if name not in place:
        place[name] = make()
    return place[name]
