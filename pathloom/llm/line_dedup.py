"""Line dedup by pairwise alignment.

Overlapping documents are found through shared hashes of runs.  A run is the shortest group of
consecutive lines, from a place onwards or up to a place, that has ``min_words`` words; a line
of so many words is a run by itself, and shorter lines, which many documents may hold, count
only with their neighbours.  Every line of a common block of ``min_words`` words or more is
in a run that lies within the block.  The earliest document that holds a run is its owner, and every later
holder is paired with the owner, so a passage shared by thousands of documents makes thousands
of pairs, not millions, and none is too frequent to be looked at.  Each pair is aligned with
patience diff: lines unique in both documents anchor the alignment, the longest increasing
run of anchors is kept, equal neighbours extend it, and the gaps between anchors are aligned
the same way (by numbered occurrences where no line is unique).  Aligned common blocks of at
least ``min_words`` words are deleted from the later document.  Where blocks stand in another order,
one alignment leaves some of them; the pair is aligned again from each run that is left.  So,
whole copies apart (below), a line goes if and only if it lies in a block of ``min_words`` words that an earlier document has.

Only hashes and word counts of lines are shuffled for the search; texts move once, to meet
their deletions.  Documents that share exactly the same lines are one class, of which the
earliest member stands for all in the search: a later member is a whole copy and loses all
its lines, however few words they have.

Order: by id, then by text hash; rows without an id come last.  Defined results: null and
blank texts have no lines with words and stay as they are; rows with equal id and text are
one document and get the same result; a text is changed only by deleting whole lines; an
empty table gives an empty result; other columns are carried and may have any names, but in
``deduplicated`` the two counts replace columns of their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import kernels as K
from pathloom.plans.staging import discard, stage

#: Words that a run has at least; aligned blocks of fewer words stay.
MIN_WORDS = 25
#: Parts into which the members of a class are dealt.
SALTS = 64


def _lines(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text, the hashes and word counts of its lines with words."""
    data, offsets = K.string_buffer(column)
    starts, ends = K.spans(data, offsets, K.NEWLINE)
    word_starts, _ = K.spans(data, offsets, K.SPACE)
    counts = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    hashes = K.hash_spans(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    for i in range(len(column)):
        a, b = first[i], first[i + 1]
        keep = np.flatnonzero(counts[a:b] > 0) + a
        yield hashes[keep], counts[keep]


def runs(hashes: np.ndarray, counts: np.ndarray, min_words: int) -> np.ndarray:
    """Distinct hashes of the shortest runs, from each line onwards and up to each line, that have ``min_words`` words."""
    return np.unique(placed_runs(hashes, counts, min_words)[2])


def placed_runs(hashes: np.ndarray, counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First lines, ends (exclusive) and hashes of the shortest runs."""
    total = np.concatenate(([0], np.cumsum(counts)))
    if total[-1] < min_words:
        none = np.zeros(0, dtype=np.int64)
        return none, none, hashes[:0]
    end = np.searchsorted(total, total[:-1] + min_words)
    onwards = np.flatnonzero(end <= len(hashes))
    upto = np.flatnonzero(total >= min_words)
    begin = np.searchsorted(total, total[upto] - min_words, side="right") - 1
    start, end = np.concatenate((onwards, begin)), np.concatenate((end[onwards], upto))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(hashes), K.BASE, dtype=np.uint64))
        back = np.cumprod(np.full(len(hashes), K.INVERSE, dtype=np.uint64))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(K.mix(hashes, 7) * power, dtype=np.uint64)))
        return start, end, K.mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64), 9)


def _describe(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch, "text"):
                found = list(_lines(piece.column(1)))
                whole = [K.sequence_hash(h) if len(h) else None for h, _ in found]
                yield pa.record_batch(
                    [
                        piece.column(0),
                        pa.array(whole, pa.int64()),
                        pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                        pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())),
                        pa.array([runs(h, c, min_words).view(np.int64) for h, c in found], pa.list_(pa.int64())),
                    ],
                    ["key", "cls", "hashes", "counts", "runs"],
                )

    return run


def matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment of two lists of line hashes: pairs of aligned places, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        at = {b[k]: k for k in range(j, j_end) if in_b[b[k]] == 1}
        anchors = [(k, at[a[k]]) for k in range(i, i_end) if in_a[a[k]] == 1 and a[k] in at]
        if not anchors:
            # No line is unique in both: the first, second, ... occurrences of a line anchor each other.
            nth = _numbered(b, j, j_end)
            anchors = [(k, nth[x]) for x, k in _numbered(a, i, i_end).items() if x in nth]
        if not anchors:
            continue
        last = (i, j)
        for x, y in _increasing(anchors):
            todo.append((*_gap(last, (x, y)),))
            out.append((x, y))
            last = (x + 1, y + 1)
        todo.append((last[0], i_end, last[1], j_end))
    return sorted(out)


def _numbered(lines: list[int], start: int, end: int) -> dict[tuple[int, int], int]:
    """Place of each (line, how many equal ones stand before it)."""
    seen: Counter[int] = Counter()
    out = {}
    for k in range(start, end):
        out[lines[k], seen[lines[k]]] = k
        seen[lines[k]] += 1
    return out


def _gap(start: tuple[int, int], end: tuple[int, int]) -> tuple[int, int, int, int]:
    return start[0], end[0], start[1], end[1]


def _increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of anchors that increases in both documents."""
    tops: list[int] = []
    heads: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(anchors):
        p = bisect_left(tops, y)
        before.append(heads[p - 1] if p else -1)
        if p == len(tops):
            tops.append(y)
            heads.append(k)
        else:
            tops[p], heads[p] = y, k
    run, k = [], heads[-1] if heads else -1
    while k >= 0:
        run.append(anchors[k])
        k = before[k]
    return run[::-1]


def aligned_blocks(a: list[int], b: list[int], counts: list[int], min_words: int) -> list[int]:
    """Places in ``b`` of the blocks of one alignment that have enough words; ``counts``: words of b's lines."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*matches(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(counts[k] for k in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def _numbered_runs(lines: list[int], counts: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """First line, end and hash of each shortest run, by place; ``lines``: a number for each distinct line."""
    found = placed_runs(np.array(lines, np.uint64), np.array(counts, np.int64), min_words)
    return sorted(zip(*(x.tolist() for x in found), strict=True))


def common_blocks(a: list[int], b: list[int], counts: list[int], min_words: int) -> list[int]:
    """Places in ``b`` of all blocks with enough words that ``a`` has too, in whatever order; ``counts``: words of b's lines.

    One alignment finds the blocks that stand in the same order in both.  While a run of both is
    left, the texts are aligned again from that run onwards, up to the next line that is gone.
    """
    gone = set(aligned_blocks(a, b, counts, min_words))
    number = {x: k for k, x in enumerate(a)}
    if all(k in gone or x not in number for k, x in enumerate(b)):
        return sorted(gone)
    words = dict(zip(b, counts, strict=True))
    there = _numbered_runs([number[x] for x in a], [words.get(x, 0) for x in a], min_words)
    here = _numbered_runs([number.get(x, len(a)) for x in b], counts, min_words)
    first = {run: start for start, _, run in reversed(there)}
    for start, end, run in here:
        if run in first and not gone.issuperset(range(start, end)):
            stop = next((k for k in range(end, len(b)) if k in gone), len(b))
            gone.update(start + k for k in aligned_blocks(a[first[run] :], b[start:stop], counts[start:stop], min_words))
    return sorted(gone)


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            gone = [
                common_blocks(a, b, c, min_words)
                for a, b, c in zip(rows["earlier"], rows["hashes"], rows["counts"], strict=True)
            ]
            keep = [k for k, x in enumerate(gone) if x]
            yield pa.record_batch(
                [
                    pa.array([rows["cls"][k] for k in keep], pa.int64()),
                    pa.array([gone[k] for k in keep], pa.list_(pa.int32())),
                ],
                ["cls", "gone"],
            )

    return run


def _key(id: str, text: str) -> Column:
    given = F.col(f"`{id}`")
    return F.struct(
        given.isNull().alias("no_id"), F.coalesce(given.cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("t")
    )


def deletions(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``key`` of each document that loses lines, and ``gone``: places among its lines with words, or null for all."""
    given = docs.select(_key(id, text).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    lines = stage(
        given.mapInArrow(
            _describe(min_words),
            "key struct<no_id:boolean,id:long,t:long>, cls long, hashes array<long>, counts array<int>, runs array<long>",
        ),
        "lines",
    )
    worded = lines.where("cls IS NOT NULL")
    # One member stands for all documents with the same lines.
    heads = stage(
        worded.groupBy("cls").agg(
            F.min("key").alias("head"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("hashes", "counts", "runs")]
        ),
        "heads",
    )
    each = heads.select("cls", "head", F.explode("runs").alias("run"))
    owners = each.groupBy("run").agg(F.min(F.struct("head", "cls")).alias("owner"), F.count(F.lit(1)).alias("n"))
    # Stored, so that the join deals both its sides anew and Spark can split the rows of a hot run.
    owners = stage(owners.where("n > 1").select("run", F.col("owner.cls").alias("owner")), "owners")
    pairs = each.join(owners, "run").where("cls <> owner").select("owner", "cls").distinct()
    pairs = pairs.join(heads.select("cls", "hashes", "counts"), "cls")
    pairs = pairs.join(heads.select(F.col("cls").alias("owner"), F.col("hashes").alias("earlier")), "owner")
    aligned = pairs.select("cls", "earlier", "hashes", "counts").mapInArrow(_align(min_words), "cls long, gone array<int>")
    parts = stage(aligned, "aligned")
    discard(owners)
    gone = parts.select("cls", F.explode("gone").alias("k")).distinct().groupBy("cls").agg(F.array_sort(F.collect_list("k")).alias("gone"))
    changed = gone.join(heads.select("cls", "head"), "cls").select(F.col("head").alias("key"), "gone")
    # Whole copies lose everything.  A class may have many of them, so its members are dealt into parts.
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt")
    several = heads.where("n > 1").select("cls", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = worded.select("key", "cls", salt).join(several, ["cls", "salt"]).where(F.col("key") != F.col("head"))
    copies = copies.select("key", F.lit(None).cast("array<int>").alias("gone")).distinct()
    return changed.unionByName(copies)


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone, lost = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "gone", "lost"))
        made = []
        for text, places, hit in zip(texts, gone, lost, strict=True):
            if not hit or text is None:
                made.append((text, 0, 0))
                continue
            lines = text.split("\n")
            worded = [k for k, line in enumerate(lines) if line.encode().split()]
            drop = set(worded if places is None else [worded[k] for k in places])
            kept = [line for k, line in enumerate(lines) if k not in drop]
            words = sum(len(lines[k].encode().split()) for k in drop)
            rest = "\n".join(kept)
            made.append((rest if rest.encode().split() else "", len(drop), words))
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] for m in made], pa.int64()),
                pa.array([m[2] for m in made], pa.int64()),
            ],
            ["row", "text", "n_removed_lines", "n_removed_words"],
        )


def _met(docs: DataFrame, id: str, text: str, **options) -> DataFrame:
    """``row`` (the columns of ``docs``, without the text), text, n_removed_lines and n_removed_words."""
    found = deletions(docs, id=id, text=text, **options)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(_key(id, text).alias("key"), F.struct(*rest).alias("row"), F.col(f"`{text}`").alias("text"))
    met = rows.join(found.withColumn("lost", F.lit(True)), "key", "left").select(
        "row", "text", "gone", F.coalesce("lost", F.lit(False)).alias("lost")
    )
    schema = T.StructType([met.schema["row"]]).add("text", "string").add("n_removed_lines", "long").add("n_removed_words", "long")
    return met.mapInArrow(_delete, schema)


def _columns(docs: DataFrame, text: str, but: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in but]


def deduplicated(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every document with its other columns, the text without repeated blocks, n_removed_lines and n_removed_words."""
    counts = ("n_removed_lines", "n_removed_words")
    return _met(docs, id, text, **options).select(*_columns(docs, text, counts), *counts)


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The columns of ``docs`` after dedup; documents that lost all their lines are gone."""
    made = _met(docs, id, text, **options).where((F.col("n_removed_lines") == 0) | (F.col("text") != ""))
    return made.select(*_columns(docs, text))
