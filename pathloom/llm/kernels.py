"""Vectorised text kernels over Arrow string columns.

The operators hash words, lines and windows of whole texts.  Doing that byte by byte in
Python is slow, so the kernels work on the column's UTF-8 buffer with numpy: boundaries
come from a byte table, and the 64-bit hash of every word is a difference of prefix sums.
Blocks of about half a megabyte bound the memory, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1
BLOCK = 1 << 19
#: Bytes of text that one step of an operator holds at a time.
CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of `[^\x20\x09-\x0D]+` words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words, of lower-cased bytes.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = True
NOT_ALNUM[0x3A:0x61] = True
NOT_ALNUM[0x7B:0x80] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True


class Words(NamedTuple):
    """Words of several texts: byte spans, hashes, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", INVERSE)):
                table = np.full(n, base, dtype=np.uint64)
                table[0] = 1
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that looks random; each seed gives another one."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((seed * 0xD1342543DE82EF95 + BASE) & MASK)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls count as empty."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return bytes_, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs of other bytes; a run never crosses two texts."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = ~separators[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    edge[cuts] = True
    starts = np.flatnonzero(inside & edge[:-1])
    last = np.ones(len(data), dtype=bool)
    last[:-1] = ~inside[1:]
    last[cuts - 1] = True
    return starts, np.flatnonzero(inside & last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the bytes stand."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
            up, down = _power_tables(int(ends[j - 1] - at) + 1)
            piece = data[at : ends[j - 1]]
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
    return mix(out)


def scan(column: pa.Array, separators: np.ndarray, lower: bool = True) -> Words:
    """Words of every text of a column."""
    data, offsets = string_buffer(column)
    if lower:
        data = LOWER[data]
    starts, ends = spans(data, offsets, separators)
    return Words(data, starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, offsets))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words, and its first word; runs stay inside a text."""
    count = len(words.hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    lengths = np.diff(words.first)
    left = np.repeat(words.first[1:], lengths) - np.arange(len(words.hashes))
    at = np.flatnonzero(left >= n)
    h = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * np.uint64(BASE) + words.hashes[at + k]
    return mix(h, n), at


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CHUNK_BYTES of text; a longer text stands alone."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = string_buffer(column)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the words' values for each text."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[first[1:]] - sums[first[:-1]]


def sequence_hash(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a list of hashes that depends on their order."""
    with np.errstate(over="ignore"):
        total = (mix(hashes, 3) * np.arange(1, 2 * len(hashes), 2, dtype=np.uint64)).sum() + np.uint64(len(hashes))
        return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def class_counts(data: np.ndarray, offsets: np.ndarray, members: bytes | np.ndarray) -> np.ndarray:
    """How many bytes of a class each text has."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8) if isinstance(members, bytes) else members] = True
    sums = np.concatenate(([0], np.cumsum(table[data])))
    return sums[offsets[1:]] - sums[offsets[:-1]]
