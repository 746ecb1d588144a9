"""Byte tries of terms in preorder, for counting terms by source and merging the counts.

A trie is held as its leaves in byte order.  Each leaf has the number of bytes that it shares
with the leaf before it, which is the depth at which its edge leaves their common path, and the bytes from there on, the
edge's label; so a path is stored once however many leaves go through it, and reading on is
a preorder walk.  A leaf counts the documents of its term, and its occurrences by source.
Tries over the same sources of a partition merge leaf by leaf, and any range of leaves is a trie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Trie(NamedTuple):
    """terms: sorted, distinct; docs: documents of each; leaf, source, count: one row for each term and source that has it."""

    terms: pa.Array
    docs: np.ndarray
    leaf: np.ndarray
    source: np.ndarray
    count: np.ndarray

    def range(self, low: int, high: int) -> Trie:
        a, b = np.searchsorted(self.leaf, [low, high])
        return Trie(self.terms.slice(low, high - low), self.docs[low:high], self.leaf[a:b] - low, self.source[a:b], self.count[a:b])

    def cut(self, at: list[bytes]) -> list[int]:
        """For each of these sorted terms, how many leaves come before it."""
        return np.searchsorted(np.array(self.terms.to_pylist(), dtype=object), np.array(at, dtype=object)).tolist() if at else []

    def at_least(self, docs: int) -> Trie:
        """The leaves with so many documents."""
        keep = self.docs >= docs
        held = keep[self.leaf]
        return Trie(self.terms.filter(pa.array(keep)), self.docs[keep], (np.cumsum(keep) - 1)[self.leaf[held]], self.source[held], self.count[held])


def from_counts(terms: pa.Array, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> Trie:
    """A trie of distinct terms (binary) in any order; ``leaf`` names a term by its place."""
    order = pc.sort_indices(terms).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    rows = np.lexsort((source, place[leaf]))
    return Trie(terms.take(pa.array(order)), docs[order], place[leaf][rows], source[rows], count[rows])


def merge(tries: Iterable[Trie]) -> Trie:
    """One trie whose leaves hold the sums."""
    tries = list(tries)
    if len(tries) == 1:
        return tries[0]
    coded = pa.chunked_array([t.terms for t in tries], pa.binary()).combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    code, n = coded.indices.to_numpy(), len(coded.dictionary)
    starts = np.concatenate(([0], np.cumsum([len(t.terms) for t in tries])))
    docs = np.zeros(n, dtype=np.int64)
    np.add.at(docs, code, np.concatenate([t.docs for t in tries]))
    leaf = code[np.concatenate([t.leaf + s for t, s in zip(tries, starts, strict=False)])].astype(np.int64)
    source = np.concatenate([t.source for t in tries]).astype(np.int64)
    width = int(source.max(initial=0)) + 1
    keys, where = np.unique(leaf * width + source, return_inverse=True)
    count = np.zeros(len(keys), dtype=np.int64)
    np.add.at(count, where, np.concatenate([t.count for t in tries]))
    return from_counts(coded.dictionary, docs, keys // width, keys % width, count)


def _buffers(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array."""
    if not len(terms):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = terms.buffers()
    offsets = np.frombuffer(offsets, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def _select(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of these spans, one after the other."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def binary(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of these spans."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_select(data, starts, lengths).tobytes())])


def shared_bytes(terms: pa.Array) -> np.ndarray:
    """How many bytes each term has in common with the one before it."""
    data, offsets = _buffers(terms)
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), dtype=np.int64)
    most = np.minimum(lengths[1:], lengths[:-1])
    alive, depth = np.flatnonzero(most > 0), 0
    while len(alive):
        same = data[offsets[alive] + depth] == data[offsets[alive + 1] + depth]
        alive, depth = alive[same], depth + 1
        out[alive + 1] = depth
        alive = alive[most[alive] > depth]
    return out


def dump(trie: Trie) -> dict[str, bytes]:
    """The preorder walk as bytes: depths of the branches, labels' lengths and labels, and the counters."""
    data, offsets = _buffers(trie.terms)
    shared = shared_bytes(trie.terms)
    rest = np.diff(offsets) - shared
    sizes = np.bincount(trie.leaf, minlength=len(trie.terms)) if len(trie.terms) else np.zeros(0, np.int64)
    parts = {"shared": shared, "rest": rest, "docs": trie.docs, "sizes": sizes, "source": trie.source, "count": trie.count}
    return {"labels": _select(data, offsets[:-1] + shared, rest).tobytes()} | {k: _narrow(v) for k, v in parts.items()}


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _widen(held: bytes) -> np.ndarray:
    return np.frombuffer(held, f"u{held[0]}", offset=1).astype(np.int64)


def load(row: dict[str, bytes]) -> Trie:
    """The trie of ``dump``: a term is a prefix of the one before it and its own label."""
    shared, rest, sizes = (_widen(row[k]) for k in ("shared", "rest", "sizes"))
    labels, at, last, terms = row["labels"], 0, b"", []
    for s, r in zip(shared.tolist(), rest.tolist(), strict=True):
        last = last[:s] + labels[at : at + r]
        at += r
        terms.append(last)
    return Trie(pa.array(terms, pa.binary()), _widen(row["docs"]), np.repeat(np.arange(len(sizes)), sizes), _widen(row["source"]), _widen(row["count"]))


def walk(trie: Trie, leaves: int) -> Iterator[Trie]:
    """The trie in ranges of so many leaves, in byte order."""
    for at in range(0, len(trie.terms), leaves):
        yield trie.range(at, min(len(trie.terms), at + leaves))
