"""Words and shingles of Arrow string columns as numpy arrays.

A column's UTF-8 bytes are read in place: word edges come from a byte table,
a word's 64-bit hash from one running sum over all bytes of the batch.  No
Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(0x51F7)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_LENGTH = _RNG.integers(0, 2**64, 64, dtype=U64)
_P = 0x9E3779B97F4A7C13  # 3 modulo 8: the powers of a base like this repeat late
_Q = U64(0xC2B2AE3D27D4EB4B)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# bytes that belong to a word, after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
NONSPACE = np.ones(256, bool)
NONSPACE[9:14] = NONSPACE[32] = False


@lru_cache(maxsize=1)
def _short() -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << 19)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        p = np.full(n, _P, U64)
        q = np.full(n, pow(_P, -1, 2**64), U64)
        p[0] = q[0] = 1
        return np.cumprod(p, dtype=U64), np.cumprod(q, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, or more; kept for texts up to a length only."""
    return _short() if n <= 1 << 19 else _powers(int(n))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
        h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
        return h ^ (h >> U64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows; a null row has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())  # bytes, whatever they are
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def strings(column: pa.Array) -> list[str | None]:
    """The column's texts; bytes that are no UTF-8 become the replacement character."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `limit` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of a batch of texts: start, end (bytes), first (a text's first word; one more at the end)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.buf, self.offsets = buf, offsets
        member = inside[buf]
        begins = np.zeros(len(buf) + 1, bool)
        begins[offsets] = True
        start, end = member.copy(), member.copy()
        start[1:] &= ~member[:-1] | begins[1:-1]
        end[:-1] &= ~member[1:] | begins[1:-1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            p, q = powers(len(self.buf) + 1)
            run = np.zeros(len(self.buf) + 1, U64)
            np.cumsum(_BYTE[self.buf] * p[: len(self.buf)], out=run[1:])
            return mix((run[self.end] - run[self.start]) * q[self.start] + (self.end - self.start).astype(U64))

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def combine(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, wherever the runs start; one per start with all words."""
    with np.errstate(over="ignore"):
        n = max(0, len(h) - size + 1)
        out = np.full(n, _LENGTH[size % 64], U64)
        for j in range(size):
            out = out * _Q + h[j : j + n]
        return mix(out)


def shingles(words: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's runs of `size` words; of a text with fewer, the whole sequence."""
    doc = words.document()
    runs = combine(h, size)
    inside = doc[size - 1 :] == doc[: len(runs)] if len(runs) else np.zeros(0, bool)
    value, owner = [runs[inside]], [doc[: len(runs)][inside]]
    for c in range(1, size):
        short = np.flatnonzero(words.count == c)
        if len(short):
            with np.errstate(over="ignore"):
                out = np.full(len(short), _LENGTH[c], U64)
                for j in range(c):
                    out = out * _Q + h[words.first[short] + j]
            value.append(mix(out))
            owner.append(short)
    return np.concatenate(value), np.concatenate(owner)


def distinct_sets(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values, ascending, one owner after the other, with n + 1 offsets."""
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    edge = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.searchsorted(owner[keep], np.arange(n + 1))


class Lookup:
    """A map from distinct 64-bit keys to positions, probed with whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys if len(keys) else np.zeros(1, U64)
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.at = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]
            lost = self.at[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U64(0xD6E8FEB86659FD93)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys among those given at first, or -1."""
        slot = self._slot(keys)
        out = self.at[slot]
        rest = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            at = self.at[slot]
            out[rest] = at
            more = (at >= 0) & (self.keys[at] != keys[rest])
            rest, slot = rest[more], slot[more]
        return out


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of the next."""
    count = np.asarray(count, np.int64)
    total = int(count.sum())
    return np.arange(total) + np.repeat(np.asarray(first, np.int64) - (np.cumsum(count) - count), count)
