"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of letters and digits.  Each benchmark item
yields its windows of ``n`` consecutive words, or one window of all its words if it has
fewer.  The window hashes are broadcast; every window of every document is probed against
them, each hit is verified word by word, and the words inside verified windows are the
hits.

The broadcast has a bound: items are cut on the executors into overlapping parts of at most
``PART_WORDS`` words, so that no window is lost, and the parts go into blocks of about
``block_bytes`` of their words (at most one part more).  A window takes 20 bytes beside its words: its sorted hash, its item, its place and
the place of its word.  One block is the usual case, and one scan of the documents answers
it.  Of more blocks, one at a time is held by the driver and broadcast; each scan writes what it found
for the texts that it hit, and these few rows meet the documents at the end.

Defined results: null and wordless texts have no words and no hits; a null item text, or an
item without an id, is ignored; repeated items count once for an id; repeated documents are
answered one by one; an empty benchmark hits nothing; columns of the inputs other than the
named ones are carried (``carry``) or ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import kernels as K
from pathloom.plans.staging import stage

#: Bytes of normalised benchmark words in one broadcast, and words of one part of an item.
BLOCK_BYTES = 8 << 20
PART_WORDS = 20_000
FOUND = "hit array<array<int>>, items array<string>"


class Grams:
    """Windows of some parts of items, by length: sorted hashes, and where each one's words stand."""

    def __init__(self, parts: list[tuple[str, bytes]], n: int) -> None:
        self.items = sorted({item for item, _ in parts})
        number = {item: k for k, item in enumerate(self.items)}
        column = pa.array([words.decode() for _, words in parts], pa.string())
        words = K.scan(column, K.NOT_ALNUM)
        self.data = words.data.tobytes()
        self.starts, self.ends = words.starts.astype(np.int32), words.ends.astype(np.int32)
        counts = np.diff(words.first)
        owner = np.repeat(np.array([number[item] for item, _ in parts], dtype=np.int32), counts)
        size = np.repeat(np.minimum(counts, n), counts)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(size).tolist():
            hashes, at = K.windows(words, length)
            own = size[at] == length
            order = np.argsort(hashes[own], kind="stable")
            at = at[own][order]
            self.by_length[length] = (hashes[own][order], at.astype(np.int32), owner[at])

    def verified(self, words: K.Words) -> Iterator[tuple[int, int, list[str]]]:
        """Every occurrence: first word, length and items."""
        for length, (keys, at, owner) in self.by_length.items():
            hashes, first = K.windows(words, length)
            if not len(hashes):
                continue
            low = np.searchsorted(keys, hashes)
            for k in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == hashes):
                i, place = int(first[k]), int(low[k])
                own = [words.word(j) for j in range(i, i + length)]
                found = set()
                while place < len(keys) and keys[place] == hashes[k]:
                    if self._words(int(at[place]), length) == own:
                        found.add(int(owner[place]))
                    place += 1
                if found:
                    yield i, length, [self.items[f] for f in found]

    def _words(self, at: int, length: int) -> list[bytes]:
        return [self.data[self.starts[j] : self.ends[j]] for j in range(at, at + length)]


def _parts(benchmark: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """item and words: the normalised words of each item, a long item in parts that overlap by n - 1 words."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).dropna()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch, "text"):
                words = K.scan(piece.column(1), K.NOT_ALNUM)
                items, made = [], []
                for item, a, b in zip(piece.column(0).to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    for i in range(a, max(a + 1, b - n + 1) if b > a else a, PART_WORDS):
                        items.append(item)
                        made.append(b" ".join([words.word(k) for k in range(i, min(b, i + PART_WORDS + n - 1))]))
                yield pa.record_batch([pa.array(items, pa.string()), pa.array(made, pa.binary())], ["item", "words"])

    return rows.mapInArrow(cut, "item string, words binary").distinct()


def _blocks(parts: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The parts in blocks of about ``block_bytes``; only one block is held at a time."""
    total = parts.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first().n
    block, size = [], 0
    for row in parts.repartition(1 + total // block_bytes).toLocalIterator():
        if size >= block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, bytes(row.words)))
        size += len(row.words)
    yield block


def _scanned(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: tuple[str, ...],
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The carried columns as c0, c1, ... and text, n_words, hit and items of each document."""
    context = docs.sparkSession.sparkContext
    given = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("text"))
    parts = stage(_parts(benchmark, item_id, item_text, n), "benchmark")
    blocks = _blocks(parts, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        grams = context.broadcast(Grams(first, n))
        return given.mapInArrow(_marker(grams), T.StructType([*given.schema, *_schema(f"n_words long, {FOUND}")]))
    # Of several blocks, each scan keeps the texts that it hits; what is found depends on the text alone.
    key = [F.xxhash64("text").alias("t1"), F.xxhash64(F.reverse("text")).alias("t2")]
    keyed = given.select(*key, "text")
    found: DataFrame | None = None
    for block in chain((first, second), blocks):
        grams = context.broadcast(Grams(block, n))
        hits = keyed.mapInArrow(_marker(grams), T.StructType([*keyed.schema, *_schema(f"n_words long, {FOUND}")]))
        hits = stage(hits.where(F.size("items") > 0).select("t1", "t2", "hit", "items").dropDuplicates(["t1", "t2"]), "hits")
        grams.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("t1", "t2").agg(
        F.flatten(F.collect_list("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("names")
    )
    met = given.select("*", *key).join(found, ["t1", "t2"], "left").drop("t1", "t2")
    return met.mapInArrow(_joined, T.StructType([*given.schema, *_schema(f"n_words long, {FOUND}")]))


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def contamination(docs: DataFrame, benchmark: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``carry`` columns, n_words, hit (array of [first word, end word]) and items of each document."""
    out = _scanned(docs, benchmark, carry, **options)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_words", "hit", "items")


def _with_found(piece: pa.RecordBatch, words: K.Words, hit: list[list[list[int]]], items: list[list[str]], given: int) -> pa.RecordBatch:
    """The first ``given`` columns, n_words, hit and items."""
    more = [
        pa.array(np.diff(words.first), pa.int64()),
        pa.array([_merged(x) for x in hit], pa.list_(pa.list_(pa.int32()))),
        pa.array(items, pa.list_(pa.string())),
    ]
    return pa.record_batch([*piece.columns[:given], *more], [*piece.schema.names[:given], "n_words", "hit", "items"])


def _marker(grams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch, "text"):
                words = K.scan(piece.column(piece.schema.get_field_index("text")), K.NOT_ALNUM)
                hit: list[list[list[int]]] = [[] for _ in range(piece.num_rows)]
                items: list[set[str]] = [set() for _ in hit]
                for i, length, names in grams.value.verified(words):
                    doc = int(np.searchsorted(words.first, i, side="right")) - 1
                    at = i - int(words.first[doc])
                    hit[doc].append([at, at + length])
                    items[doc].update(names)
                yield _with_found(piece, words, hit, [sorted(x) for x in items], piece.num_columns)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last columns are the hits and names found by all blocks, or null."""
    for batch in batches:
        for piece in K.slices(batch, "text"):
            words = K.scan(piece.column(piece.schema.get_field_index("text")), K.NOT_ALNUM)
            hit, items = ([x or [] for x in piece.column(k).to_pylist()] for k in (-2, -1))
            yield _with_found(piece, words, hit, items, piece.num_columns - 2)


def _merged(found: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def n_hit() -> F.Column:
    """Words inside the merged spans of ``hit``."""
    return F.aggregate("hit", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])


def _restored(found: DataFrame, columns: list[str], rest: tuple[str, ...], text: str) -> DataFrame:
    return found.select(*[F.col("text" if c == text else f"c{rest.index(c)}").alias(c) for c in columns])


def without_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents without a hit, all their columns kept."""
    rest = tuple(c for c in docs.columns if c != text)
    found = _scanned(docs, benchmark, rest, text=text, **options).where(F.size("items") == 0)
    return _restored(found, docs.columns, rest, text)


def without_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """All documents, with the hit words cut out of their texts; other texts stay as they are."""
    rest = tuple(c for c in docs.columns if c != text)
    found = _scanned(docs, benchmark, rest, text=text, **options)

    @F.pandas_udf(T.StringType())
    def cut(texts, hits):
        return texts.combine(hits, lambda t, h: t if t is None or not len(h) else _cut(t, h))

    return _restored(found.withColumn("text", cut(F.col("text"), F.col("hit"))), docs.columns, rest, text)


def _cut(text: str, hit) -> str:
    words = K.scan(pa.array([text], pa.string()), K.NOT_ALNUM)
    raw, out, at = text.encode(), [], 0
    for first, end in hit:
        out.append(raw[at : int(words.starts[first])])
        at = int(words.ends[end - 1])
    return b"".join([*out, raw[at:]]).decode()
