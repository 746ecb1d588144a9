"""Source divergence audit: how the terms of the sources of a language differ.

Each task counts its terms in byte tries, one for a language, whose leaves count documents
and, by source, occurrences.  The tries are cut into ranges of terms, by bounds that a
sample of their leaves gives, and the pieces of a range are merged leaf by leaf; a language keeps the
terms with enough documents.  A walk over the kept tries in byte order then adds up what every
two sources differ by, and holds each source's foremost terms.  What meets in one task is a range
of terms, never a source or a language, and a term has one row for each task that saw it.

Smoothed shares are whole numbers: p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), with N the
group's occurrences of the V kept terms; two shares differ by floor((p - q)**2 / (p + q)).
"""

from __future__ import annotations

import bisect
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import kernels
from pathloom.llm.radix_trie import Trie, binary, dump, from_counts, load, merge, walk
from pathloom.plans.staging import discard, stage

LEAST_DOCS, TOP = 10, 10
SCALE = 10**9
#: Leaves in a row of a written trie, that wait for a merge, that a task holds, and that a range has, about.
ROW, WAITING, HELD, RANGE = 4096, 1 << 18, 1 << 20, 1 << 19
#: One leaf in so many is a candidate for a bound between ranges, of which the driver sees so many at most.
SPACING, SAMPLE = 128, 1 << 14
#: Groups whose totals a walk over the tries has at hand; more are compared block by block.
GROUPS = 1024

#: Separators of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` terms, of lower-cased bytes.
NOT_LETTER = np.zeros(256, dtype=bool)
NOT_LETTER[0x00:0x61] = True
NOT_LETTER[0x7B:0x80] = True

TRIE = "labels binary, shared binary, rest binary, docs binary, sizes binary, source binary, count binary"
_TRIE = pa.schema([(c.split()[0], pa.binary()) for c in TRIE.split(", ")])
_NAMES = pa.list_(pa.string())


def _text_counts(batch: pa.RecordBatch, group: np.ndarray, lang: np.ndarray) -> Iterator[tuple[int, Trie]]:
    """The language's number and trie, for each language of some documents."""
    data, offsets = kernels.string_buffer(batch.column(2))
    data = kernels.LOWER[data]
    starts, ends = kernels.spans(data, offsets, NOT_LETTER)
    if not len(starts):
        return
    coded = binary(data, starts, ends - starts).dictionary_encode()
    code, doc = coded.indices.to_numpy().astype(np.int64), np.searchsorted(offsets, starts, side="right") - 1
    width = len(coded.dictionary)
    for number in np.unique(lang):
        own = np.flatnonzero(lang[doc] == number)
        if not len(own):
            continue
        seen, term = np.unique(code[own], return_inverse=True)
        pairs = np.unique(doc[own] * width + term) % width
        keys, count = np.unique(term * (int(group.max()) + 1) + group[doc[own]], return_counts=True)
        leaf, source = np.divmod(keys, int(group.max()) + 1)
        yield int(number), from_counts(coded.dictionary.take(pa.array(seen)), np.bincount(pairs, minlength=len(seen)), leaf, source, count)


def _rows(lang: str, trie: Trie, names: list[str]) -> Iterator[dict]:
    """A trie in rows of ``ROW`` leaves, its sources numbered within each row."""
    for piece in walk(trie, ROW):
        used, source = np.unique(piece.source, return_inverse=True)
        marks = piece.terms.take(pa.array(range(min(SPACING // 2, len(piece.terms) // 2), len(piece.terms), SPACING)))
        yield {"lang": lang, "leaves": len(piece.terms), "sources": [names[s] for s in used], "marks": marks.to_pylist()} | dump(piece._replace(source=source))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


COUNTED = pa.schema([("lang", pa.string()), ("leaves", pa.int64()), ("sources", _NAMES), ("marks", pa.list_(pa.binary())), *_TRIE])
COUNTED_DDL = f"lang string, leaves long, sources array<string>, marks array<binary>, {TRIE}"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) as tries; one row without leaves for each language names the sources that were seen."""
    langs: dict[str, int] = {}
    groups: dict[tuple[str, str], int] = {}
    waiting: dict[int, list[Trie]] = defaultdict(list)

    def flush() -> Iterator[pa.RecordBatch]:
        sources = [s for _, s in groups]
        for lang, number in langs.items():
            for row in _rows(lang, merge(waiting[number]), sources) if waiting[number] else ():
                yield _batch([row], COUNTED)
        waiting.clear()

    for batch in batches:
        for piece in kernels.slices(batch, "text"):
            pairs = list(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True))
            group = np.array([groups.setdefault(p, len(groups)) for p in pairs])
            lang = np.array([langs.setdefault(p[0], len(langs)) for p in pairs])
            for number, trie in _text_counts(piece, group, lang):
                waiting[number].append(trie)
            if sum(len(t.terms) for ts in waiting.values() for t in ts) > WAITING:
                for number, ts in waiting.items():
                    waiting[number] = [merge(ts)] if len(ts) > 1 else ts
                if sum(len(t.terms) for ts in waiting.values() for t in ts) > HELD:
                    yield from flush()
    yield from flush()
    for lang in langs:
        names = [s for own, s in groups if own == lang]
        nothing = Trie(pa.array([], pa.binary()), *[np.zeros(0, np.int64)] * 4)
        yield _batch([{"lang": lang, "leaves": 0, "sources": names, "marks": []} | dump(nothing)], COUNTED)


CUT = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("leaves", pa.int64()), ("sources", _NAMES), *_TRIE])
CUT_DDL = f"range int, lang string, leaves long, sources array<string>, {TRIE}"


def _cut(bounds: list[tuple[bytes, bytes]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries by range: range k ends before bound k, of (language, term) in byte order."""
    for batch in batches:
        for row in batch.to_pylist():
            lang, trie = row["lang"].encode(), load(row)
            first = bisect.bisect_left(bounds, (lang, b""))
            own = [term for _, term in itertools.takewhile(lambda b: b[0] == lang, itertools.islice(bounds, first, None))]  # noqa: B023
            ends = [*trie.cut(own), len(trie.terms)]
            for k, (low, high) in enumerate(itertools.pairwise([0, *ends])):
                if low < high:
                    yield _batch([{"range": first + k, "lang": row["lang"], "leaves": high - low, "sources": row["sources"]} | dump(trie.range(low, high))], CUT)


KEPT = pa.schema([("lang", pa.string()), ("leaves", pa.int64()), ("sources", _NAMES), ("sums", pa.list_(pa.int64())), *_TRIE])
KEPT_DDL = f"lang string, leaves long, sources array<string>, sums array<bigint>, {TRIE}"


def _renamed(row: dict, names: dict[str, int]) -> Trie:
    trie = load(row)
    return trie._replace(source=np.array([names.setdefault(s, len(names)) for s in row["sources"]], dtype=np.int64)[trie.source])


def _merge(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merged trie of each range and language, with the terms that have ``least`` documents; rows come in this order."""
    rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
    for (_, lang), own in itertools.groupby(rows, key=lambda r: (r["range"], r["lang"])):
        names: dict[str, int] = {}
        waiting, leaves, most = [], 0, WAITING
        for row in own:
            waiting.append(_renamed(row, names))
            leaves += len(waiting[-1].terms)
            if leaves > most:
                waiting = [merge(waiting)]
                leaves = len(waiting[0].terms)
                most = max(WAITING, 2 * leaves)
        for row in _rows(lang, merge(waiting).at_least(least), list(names)):
            source = np.frombuffer(row["source"], f"u{row['source'][0]}", offset=1).astype(np.int64)
            sums = np.zeros(len(row["sources"]), dtype=np.int64)
            np.add.at(sums, source, np.frombuffer(row["count"], f"u{row['count'][0]}", offset=1).astype(np.int64))
            row.pop("marks")
            yield _batch([row | {"sums": sums.tolist()}], KEPT)


def share(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """Smoothed shares, exact: in longs where they hold the product, else in Python's integers."""
    if int(count.max(initial=0)) + 2 < (1 << 63) // SCALE:
        return 1 + SCALE * (count + 2) // (total + 2 * kept)
    return 1 + np.array([SCALE * (int(c) + 2) // (total + 2 * kept) for c in count.ravel()], dtype=np.int64).reshape(count.shape)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


Totals = dict[str, tuple[int, int, dict[str, int]]]
FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _dense(row: dict, trie: Trie, wanted: list[str]) -> np.ndarray:
    """Counts of each leaf (rows) in these sources (columns)."""
    place = {s: k for k, s in enumerate(wanted)}
    column = np.array([place.get(s, -1) for s in row["sources"]], dtype=np.int64)[trie.source]
    out = np.zeros((len(trie.terms), len(wanted)), dtype=np.int64)
    out[trie.leaf[column >= 0], column[column >= 0]] = trie.count[column >= 0]
    return out


def _compare(ours: Totals, theirs: Totals, with_terms: bool, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the sources in ``ours`` and ``theirs`` (by language: V, N and each source's N) differ by in a task's terms, and the foremost terms of ours."""
    sums: dict[str, np.ndarray] = {}
    best: dict[tuple[str, str], list[tuple[int, bytes]]] = defaultdict(list)
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            lang = row["lang"]
            if lang not in ours or lang not in theirs:
                continue
            trie, (kept, total, left), right = load(row), ours[lang], theirs[lang][2]
            own = _dense(row, trie, list(left))
            p = np.stack([share(own[:, i], n, kept) for i, n in enumerate(left.values())], axis=1)
            other = p if ours is theirs else _dense(row, trie, list(right))
            q = p if ours is theirs else np.stack([share(other[:, i], n, kept) for i, n in enumerate(right.values())], axis=1)
            found = np.stack([gap(p[:, i : i + 1], q).sum(axis=0) for i in range(p.shape[1])])
            sums[lang] = sums[lang] + found if lang in sums else found
            if not with_terms:
                continue
            everywhere = np.zeros(len(trie.terms), dtype=np.int64)
            np.add.at(everywhere, trie.leaf, trie.count)
            usual = share(everywhere, total, kept)
            for i, source in enumerate(left):
                at = np.flatnonzero((own[:, i] > 0) & (p[:, i] > usual))
                value = gap(p[at, i], usual[at])
                first = np.argsort(-value, kind="stable")[:top]
                named = trie.terms.take(pa.array(at[first], pa.int64())).to_pylist()
                held = [(-int(v), t) for v, t in zip(value[first], named, strict=True)]
                best[lang, source] = sorted(best[lang, source] + held)[:top]
    for lang, found in sums.items():
        left, right = list(ours[lang][2]), list(theirs[lang][2])
        for i, source in enumerate(left):
            yield _batch([{"lang": lang, "source": source, "part": "pair", "item": item, "value": int(v)} for item, v in zip(right, found[i], strict=True) if item != source], FOUND)
    for (lang, source), held in best.items():
        yield _batch([{"lang": lang, "source": source, "part": "term", "item": t.decode(), "value": -v} for v, t in held], FOUND)


def _bounds(tries: DataFrame, ranges: int) -> list[tuple[bytes, bytes]]:
    """Bounds between about equal ranges, by a sample of the tries' leaves of bounded size; they move work and no result."""
    marks = tries.select(F.encode("lang", "UTF-8").alias("lang"), F.explode("marks").alias("mark"))
    sample = sorted((bytes(r.lang), bytes(r.mark)) for r in marks.orderBy(F.rand(1)).limit(SAMPLE).collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def _block(groups: DataFrame, block: Column, number: int) -> Totals:
    out: Totals = {}
    for r in groups.where(block == number).orderBy("lang", "source").collect():
        out.setdefault(r.lang, (r.kept, r.total, {}))[2][r.source] = r.own
    return out


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` (value descending, then item by bytes, from 1) for every language and source.

    part ``pair``: the other sources of the language by how much the shares of the kept terms differ, 0 if none is kept.
    part ``term``: the ``top`` terms that have a larger share in the source than in the language, by that difference.
    Null languages, sources and texts are empty ones.  A source without terms has its pairs; a language with one source
    has no pair.  Repeated rows count again; very long texts are read whole; other columns play no role; no rows give none.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    tries = stage(rows.mapInArrow(_count, COUNTED_DDL), "tries")
    leaves = tries.agg(F.sum("leaves")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves // RANGE))
    bounds = _bounds(tries, ranges)
    pieces = tries.where("leaves > 0").drop("marks").mapInArrow(lambda batches: _cut(bounds, batches), CUT_DDL)
    pieces = pieces.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "lang")
    kept = stage(pieces.mapInArrow(lambda batches: _merge(least_docs, batches), KEPT_DDL), "kept-terms")

    own = kept.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("z")).groupBy("lang", F.col("z.sources").alias("source")).agg(F.sum("z.sums").alias("own"))
    terms = kept.groupBy("lang").agg(F.sum("leaves").alias("kept"))
    everyone = own.groupBy("lang").agg(F.sum("own").alias("total"))
    groups = tries.select("lang", F.explode("sources").alias("source")).distinct().join(own, ["lang", "source"], "left").join(terms, "lang", "left").join(everyone, "lang", "left")
    groups = stage(groups.na.fill(0, ["own", "kept", "total"]), "groups")
    discard(tries)

    blocks = -(-groups.count() // GROUPS)
    block = F.pmod(F.xxhash64("lang", "source"), F.lit(max(1, blocks)))
    found = groups.where("kept = 0").select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    found = [found.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))]
    for a in range(blocks):
        ours = _block(groups, block, a)
        for b in range(blocks):
            theirs = ours if a == b else _block(groups, block, b)
            met = kept.drop("sums").mapInArrow(lambda batches: _compare(ours, theirs, a == b, top, batches), "lang string, source string, part string, item string, value long")  # noqa: B023
            found.append(stage(met, "differences"))
    discard(kept)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    pairs = rows.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = rows.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)
