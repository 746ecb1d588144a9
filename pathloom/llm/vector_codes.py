"""Vector code compression: product codes trained by filtering Lloyd rounds.

A vector becomes whole numbers and is cut into equal parts; each part position has a
codebook, and a vector's code names the nearest entry of each.  Every block of rows holds one
kd-tree for each part position, whose nodes keep their bounding box, sum and number of points.
A Lloyd round sends the codebooks down the trees: an entry leaves a node when another one is
nearer to every point of the node's box (or as near, and first), and a node with a single
entry left is assigned as a whole, from its cached sum.  Points are looked at only in
leaves that keep several entries.

The trees are built once and written to the shared folder; a round reads them, adds up sums
and counts of each entry on the executors, and brings one total for each number of the
codebooks to the driver.  All arithmetic is of whole numbers: in doubles and longs where the table's
largest component proves them exact, else in Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from pathloom.plans.staging import discard, stage

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096.0
#: Points in a leaf at least (where a block has them), and numbers in a block of vectors at most.
LEAF = 16
BLOCK = 1 << 18
LONGEST = (1 << 63) - 1


class Tree(NamedTuple):
    """Points in tree order and, level by level, the nodes' boxes and sums; ``order``: the points' rows in the block."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def depth_of(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin; a node's halves begin where its children do."""
    return (np.arange((1 << level) + 1) * n) >> level


def whole(values: np.ndarray, wide: bool) -> np.ndarray:
    """Whole numbers that stand in doubles, as the kind that sums are exact in."""
    return np.array([int(v) for v in values.ravel()], dtype=object).reshape(values.shape) if wide else values.astype(np.int64)


def _sums(points: np.ndarray, wide: bool) -> np.ndarray:
    n = len(points)
    run = np.concatenate([np.zeros((1, points.shape[1]), dtype=object if wide else np.int64), np.cumsum(whole(points, wide), axis=0)])
    return np.concatenate([run[b[1:]] - run[b[:-1]] for b in (bounds(n, level) for level in range(depth_of(n) + 1))])


def build(points: np.ndarray, wide: bool = False) -> Tree:
    """A balanced tree, halved along each node's widest side."""
    n, last = len(points), depth_of(len(points))
    order, low, high = np.arange(n), [], []
    for level in range(last + 1):
        b = bounds(n, level)
        held = points[order]
        low.append(np.minimum.reduceat(held, b[:-1], axis=0))
        high.append(np.maximum.reduceat(held, b[:-1], axis=0))
        if level < last:
            node = np.repeat(np.arange(len(b) - 1), np.diff(b))
            widest = np.argmax(high[-1] - low[-1], axis=1)
            order = order[np.lexsort((held[np.arange(n), widest[node]], node))]
    return Tree(points[order], order, np.concatenate(low), np.concatenate(high), _sums(points[order], wide))


def _distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    gaps = points[:, None, :] - book[None, :, :]
    return (gaps * gaps).sum(axis=2)


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point in tree order (the first of equals), and each entry's sum and number of points.

    book: (entries, numbers), doubles or, like the tree's points, Python integers.
    """
    n, m = len(tree.points), len(book)
    entry = np.zeros(n, dtype=np.int64)
    sums = np.zeros((m, book.shape[1]), dtype=tree.sums.dtype)
    counts = np.zeros(m, dtype=np.int64)
    squares, numbers = (book * book).sum(axis=1), np.arange(m)
    at, left = np.zeros(1, dtype=np.int64), np.ones((1, m), dtype=bool)
    for level in range(depth_of(n) + 1):
        b, first = bounds(n, level), (1 << level) - 1
        low, high = tree.low[first + at], tree.high[first + at]
        middle = np.where(left, _distances(low + high, 2 * book), np.inf)
        best = np.argmin(middle, axis=1)
        away = book[None, :, :] - book[best][:, None, :]
        # How much nearer than the best an entry comes at the corner of the box that lies farthest towards it.
        reach = np.maximum(away * low[:, None, :], away * high[:, None, :]).sum(axis=2)
        least = squares[None, :] - squares[best][:, None] - 2 * reach
        left &= ((least < 0) | ((least == 0) & (numbers[None, :] < best[:, None]))).astype(bool) | (numbers[None, :] == best[:, None])
        alone = left.sum(axis=1) == 1
        for node, e in zip(at[alone], best[alone], strict=True):
            entry[b[node] : b[node + 1]] = e
        np.add.at(sums, best[alone], tree.sums[first + at[alone]])
        np.add.at(counts, best[alone], b[at[alone] + 1] - b[at[alone]])
        at, left = at[~alone], left[~alone]
        if not len(at):
            return entry, sums, counts
        if level < depth_of(n):
            at = np.repeat(2 * at, 2) + np.tile([0, 1], len(at))
            left = np.repeat(left, 2, axis=0)
    sizes = b[at + 1] - b[at]
    rows = np.repeat(b[at] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    near = np.where(np.repeat(left, sizes, axis=0), _distances(tree.points[rows], book), np.inf)
    entry[rows] = np.argmin(near, axis=1)
    np.add.at(sums, entry[rows], whole(tree.points[rows], tree.sums.dtype == object))
    np.add.at(counts, entry[rows], 1)
    return entry, sums, counts


class Shape(NamedTuple):
    """Parts of a vector, numbers in a part, and whether sums need Python's integers."""

    parts: int
    width: int
    wide: bool


def _matrix(column: pa.Array, shape: Shape) -> np.ndarray:
    """Whole components, one row for each vector; short vectors end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lengths), shape.parts * shape.width))
    ends = np.cumsum(lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(ends - lengths, lengths)] = values
    return out


def _bytes(arrays: list[np.ndarray], kind: type) -> pa.Array:
    return pa.array([[a.astype(kind).tobytes() for a in arrays]], pa.list_(pa.binary()))


def _blocks(schema: pa.Schema, shape: Shape, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) in blocks with their trees."""
    kind = np.float64 if shape.wide else np.int32
    step = max(1, BLOCK // (shape.parts * shape.width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            numbers = _matrix(piece.column(2), shape)
            trees = [build(numbers[:, p * shape.width : (p + 1) * shape.width], shape.wide) for p in range(shape.parts)]
            listed = [pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(c)) for c in (0, 1)]
            columns = [
                *listed,
                pa.array([piece.num_rows], pa.int32()),
                _bytes([t.points for t in trees], kind),
                _bytes([t.order for t in trees], np.int32),
                _bytes([np.stack([t.low, t.high]) for t in trees], kind),
                _bytes([] if shape.wide else [t.sums for t in trees], np.int64),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _trees(row: dict, shape: Shape, kind: type) -> Iterator[Tree]:
    """The trees of a block, one for each part."""
    for p in range(shape.parts):
        numbers = lambda name: whole(np.frombuffer(row[name][p], kind), True) if shape.wide else np.frombuffer(row[name][p], kind).astype(np.float64)  # noqa: B023, E731
        points = numbers("points").reshape(row["n"], shape.width)
        low, high = numbers("boxes").reshape(2, -1, shape.width)
        sums = _sums(points, True) if shape.wide else np.frombuffer(row["sums"][p], np.int64).reshape(-1, shape.width)
        order = np.frombuffer(row["order"][p], np.int32) if "order" in row else np.zeros(0, np.int32)
        yield Tree(points, order, low, high, sums)


def _limbs(value: int, wide: bool) -> Iterator[int]:
    """A whole number in base 2**32, the last digit with the sign; the number itself where longs hold all sums."""
    while wide and not -(1 << 31) <= value < 1 << 31:
        yield value & 0xFFFFFFFF
        value >>= 32
    yield value


def _totals(books: list[np.ndarray], shape: Shape, kind: type, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and counts of each entry over a partition: part, entry, position (-1 for the count), digit, value."""
    sums = counts = None
    for batch in batches:
        for row in batch.to_pylist():
            found = [assign(t, z)[1:] for t, z in zip(_trees(row, shape, kind), books, strict=True)]
            if sums is None:
                sums, counts = [s for s, _ in found], [c for _, c in found]
            else:
                sums, counts = [a + s for a, (s, _) in zip(sums, found, strict=True)], [a + c for a, (_, c) in zip(counts, found, strict=True)]
    if sums is None:
        return
    rows = [
        (p, e, i, digit, value)
        for p in range(shape.parts)
        for e in np.flatnonzero(counts[p]).tolist()
        for i, total in enumerate([int(counts[p][e]), *map(int, sums[p][e])], -1)
        for digit, value in enumerate(_limbs(total, shape.wide))
    ]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["part", "entry", "at", "digit", "value"])


def _codes(books: list[np.ndarray], shape: Shape, kind: type, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            block = batch.slice(k, 1)
            row = block.select(["n", "points", "order", "boxes", "sums"]).to_pylist()[0]
            codes = np.zeros((row["n"], shape.parts), dtype=np.uint8)
            errors = np.zeros(row["n"], dtype=object if shape.wide else np.int64)
            for p, (tree, z) in enumerate(zip(_trees(row, shape, kind), books, strict=True)):
                entry = assign(tree, z)[0]
                gaps = tree.points - z[entry]
                codes[tree.order, p] = entry
                errors[tree.order] += whole((gaps * gaps).sum(axis=1), shape.wide)
            named = [block.column(c).flatten() for c in ("ids", "labels")]
            told = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([*named, told, pa.array([min(int(e), LONGEST) for e in errors], pa.int64())], schema=schema)


def _finite(vector: str) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))


def compress(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[list[list[int]]]]:
    """``id``, ``label``, ``code`` (two hex digits for each part) and ``error`` (squared distance) of every vector, and the codebooks.

    Vectors that are null or hold a component that is null, NaN or infinite (or so after the scaling, in doubles) are left out.  A codebook starts as its part
    of the rows with the smallest ids, null ids last, ties by the vector; with fewer rows it has fewer entries.  Vectors shorter than the
    longest, and lengths that the parts do not divide, are as if zeros followed.  An error beyond a long is the largest
    long.  Repeated rows and ids each have their row; other columns of the table play no role; no rows give no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(_finite("vector"))
    # A component is at most 4,096 times the largest, and one more for the floor.
    longest, largest = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    width = max(1, -(-(longest or 0) // parts))
    most = SCALE * (largest or 0.0) + 1
    shape = Shape(parts, width, 16 * width * most * most >= 2.0**53)
    kind = np.float64 if shape.wide else np.int32
    start = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    numbers = _matrix(pa.array([r.vector for r in start], pa.list_(pa.float64())), shape)
    books = [whole(numbers[:, p * width : (p + 1) * width], True) for p in range(parts)]

    held = StructType().add("ids", ArrayType(rows.schema["id"].dataType)).add("labels", ArrayType(rows.schema["label"].dataType)).add("n", IntegerType())
    for name in ("points", "order", "boxes", "sums"):
        held = held.add(name, ArrayType(BinaryType()))
    arrow = to_arrow_schema(held)
    blocks = stage(rows.mapInArrow(lambda batches: _blocks(arrow, shape, batches), held), "vector-trees")
    ready = lambda: books if shape.wide else [z.astype(np.float64) for z in books]
    for _ in range(rounds if start else 0):
        now = ready()
        made = blocks.select("n", "points", "boxes", "sums").mapInArrow(lambda batches: _totals(now, shape, kind, batches), "part long, entry long, at long, digit long, value long")  # noqa: B023
        totals: dict[tuple[int, int, int], int] = {}
        for r in made.groupBy("part", "entry", "at", "digit").agg(F.sum("value").alias("value")).collect():
            key = (r.part, r.entry, r.at)
            totals[key] = totals.get(key, 0) + (r.value << 32 * r.digit)
        for (p, e, i), total in totals.items():
            if i >= 0:
                books[p][e, i] = total // totals[p, e, -1]
    final = ready()
    told = StructType().add("id", rows.schema["id"].dataType).add("label", rows.schema["label"].dataType).add("code", StringType()).add("error", LongType())
    out = to_arrow_schema(told)
    coded = stage(blocks.mapInArrow(lambda batches: _codes(final, shape, kind, out, batches), told), "vector-codes")
    discard(blocks)
    names = [F.col("id").alias(id), F.col("label").alias(label), "code", "error"]
    return coded.select(*names), [[[int(v) for v in z] for z in book] for book in books]
