"""Mixing sources to target weights: how often each document is taken, by pivotal dependent rounding.

Every source has a target of words.  A document is taken as many whole times as its source's
target holds the source's words, and once more with the probability of the rest.  These
probabilities are rounded in dependence: two documents that are still open exchange words,
in one of two directions drawn at random, until one of them is settled at nought or one.  The exchange
moves words and not probabilities, so it keeps the words that the source expects, and each
document's own expectation.

Documents meet in groups of about ``FAN`` of a source, and in a group within a size class (powers
of two).  A group leaves a few open documents of each class; those of ``JOINED`` groups meet in
the next round, until a source has one group.  This reduction tree hangs on the rows alone, not on
their order or partitions, so reruns agree.  In a source's last group the large classes are
settled first, and the smaller ones make up for the words that a class's last document brings or lacks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.hot_keys import with_totals
from pathloom.plans.staging import discard, stage

#: Weights of the sources in order, repeating, and how often a document is taken at most.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents in a group of the reduction tree, about, groups that send their open documents to one of the next round, and
#: documents of a class that a group leaves open beside the one that no other settles, to make up for the last words.
FAN = 1024
JOINED = 8
KEPT = 4
WORD = r"[^\x20\x09-\x0D]+"
#: A share this near to nought or one is one of them.
CLOSE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, size, n and target of every row of ``sizes`` (source, size, n), one for each source.

    Sources by code point, null last, have the weights in turn and share all words by them.  What a source's
    share is above ``most`` times its size goes to the others by weight, until none is above.
    """
    ordered = stage(sizes.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source")).withColumn("place", F.monotonically_increasing_id()), "sources")
    # The place of a row is its partition and its number there; partitions are few, sources need not be.
    partition = F.shiftright("place", 33)
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ordered.groupBy(partition.alias("part")).agg(F.count(F.lit(1)).alias("rows")).select("part", before.alias("start"))
    rank = F.pmod(F.col("start") + F.col("place") - F.shiftleft("part", 33), F.lit(len(weights)))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), rank.cast("int")).cast("long")
    ranked = ordered.withColumn("part", partition).join(F.broadcast(starts), "part")
    weighed = stage(ranked.select("source", "size", "n", weight.alias("weight")), "weighed-sources")
    discard(ordered)
    # The level of the sources that are not at their limit rises as others reach theirs.
    words, over, under = None, 1, 1
    while True:
        at_limit = F.col("weight") * F.lit(over) >= F.lit(most) * F.col("size").cast("decimal(38,0)") * F.lit(under) if words is not None else F.lit(False)
        sums = weighed.agg(F.sum("size"), F.sum(F.when(~at_limit, F.col("weight"))), F.sum(F.when(at_limit, F.col("size")))).first()
        words = int(sums[0] or 0)
        level = (words - most * int(sums[2] or 0), int(sums[1] or 0))
        if not level[1] or level == (over, under):
            break
        over, under = level
    limit = (F.lit(most) * F.col("size")).cast("double")
    # Both whole numbers are exact in doubles below 2**53 words, so the quotient is the nearest double.
    free = F.col("weight").cast("double") * F.lit(float(over)) / F.lit(float(under))
    return weighed.select("source", "size", "n", F.least(limit, free).alias("target"))


def _words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*parts: object) -> float:
    """A number in [0, 1) that these values alone decide."""
    return (xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) >> 11) / (1 << 53)


def settle(sizes: list[int], shares: list[float], draws: list[float], kept: int = 0) -> list[int]:
    """Changes ``shares`` to 0 or 1, pair by pair, with the same words in all; returns the places still open, one and the last ``kept`` at most."""
    held, done = -1, lambda p: p <= CLOSE or p >= 1 - CLOSE
    for i, u in enumerate(draws[: len(draws) - kept]):
        if done(shares[i]):
            shares[i] = float(shares[i] > 0.5)
            continue
        if held < 0:
            held = i
            continue
        a, b, p, q = sizes[held], sizes[i], shares[held], shares[i]
        up = min((1 - p) * a, q * b)  # words that this document may give to the held one, and take from it
        down = min(p * a, (1 - q) * b)
        moved = up if u * (up + down) < down else -down
        pair = [(held, p + moved / a), (i, q - moved / b)]
        still = [k for k, share in pair if not done(share)]
        for k, share in pair:
            shares[k] = float(share > 0.5) if done(share) else share
        held = still[0] if still else -1
    return ([held] if held >= 0 else []) + [i for i in range(max(0, len(draws) - kept), len(draws)) if not done(shares[i])]


def shift(sizes: list[int], shares: list[float], owed: float) -> float:
    """Raises or lowers all ``shares`` so that they take ``owed`` words more; returns what they cannot take."""
    room = [(1 - p) * s if owed > 0 else p * s for p, s in zip(shares, sizes, strict=True)]
    total = math.fsum(room)
    if not total:
        return owed
    part = min(1.0, abs(owed) / total)
    for i, (r, s) in enumerate(zip(room, sizes, strict=True)):
        shares[i] += math.copysign(part * r / s, owed)
    return owed - math.copysign(part * total, owed)


def land(classes: list[tuple[list[int], list[float], list[float]]]) -> None:
    """Changes the shares of a source's last documents, (sizes, shares, draws) of each class, to 0 or 1, the large classes first.

    The last open document of a class is drawn too, and the words that this adds or takes away are made up for by the
    shares of the smaller ones, where they can; where they cannot, the nearer of the two ways is taken.
    """
    owed = 0.0
    for k, (sizes, shares, draws) in enumerate(classes):
        owed = shift(sizes, shares, owed)
        for i in settle(sizes, shares, draws):
            rest = [(s, p) for sizes_, shares_, _ in classes[k + 1 :] for s, p in zip(sizes_, shares_, strict=True)]
            ways = {take: owed + (shares[i] - take) * sizes[i] for take in (0, 1)}
            take = int(1 - draws[i] < shares[i])
            room = math.fsum(s * (1 - p) for s, p in rest) if ways[take] > 0 else math.fsum(s * p for s, p in rest)
            if abs(ways[take]) > room:
                take = min(ways, key=lambda t: abs(ways[t]))
            shares[i], owed = float(take), ways[take]


def _group(level: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """Settles the documents of a group class by class; where it is the source's only group, all of them."""

    def run(table: pa.Table) -> pa.Table:
        doc, words, kind, nth, mark, shares = (table.column(c).to_pylist() for c in ("doc", "words", "kind", "nth", "mark", "share"))
        order = sorted(range(table.num_rows), key=lambda i: (-kind[i], mark[i], nth[i], str(doc[i])))
        classes = [list(own) for _, own in itertools.groupby(order, key=kind.__getitem__)]
        told = [([words[i] for i in own], [shares[i] for i in own], [draw(seed, level, mark[i], doc[i], nth[i]) for i in own]) for own in classes]
        still = []
        if table.column("groups")[0].as_py() == 1:
            land(told)
        else:
            still = [own[k] for own, given in zip(classes, told, strict=True) for k in settle(*given, KEPT)]
        for own, (_, found, _) in zip(classes, told, strict=True):
            for i, share in zip(own, found, strict=True):
                shares[i] = share
        is_open = np.isin(np.arange(table.num_rows), still)
        for name, values in (("share", pa.array(shares, pa.float64())), ("take", pa.array([round(p) for p in shares], pa.int32())), ("open", pa.array(is_open))):
            at = table.schema.get_field_index(name)
            table = table.set_column(at, name, values)
        return table

    return run


def mixture(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0
) -> DataFrame:
    """``id``, ``source``, ``size`` (words), ``source_size``, ``target`` (words of its source) and ``copies`` (how often it is taken) of every row.

    The words that a source's copies hold differ from its target by what its small documents cannot make up for: a few words
    where it has many of them.  A text without words, or null, has the size 0; it has as many copies as its source has in whole and adds nothing.
    A null source is a source; a null id is an id; repeated rows are rounded each on its own, and which of equal rows has more copies is not told apart.
    A source without words has the target 0.  Very long texts are only counted.  Other columns play no role; no rows give no rows.
    """
    rows = docs.select(F.col(id).alias("doc"), F.col(source).alias("source"), _words(text).alias("words"))
    # Equal rows are numbered, so that each has draws of its own.
    counted = stage(rows.groupBy("doc", "source", "words").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    totals = counted.groupBy("source").agg(F.sum(F.col("words") * F.col("rows")).alias("size"), F.sum("rows").alias("n"))
    targets = stage(source_targets(totals, weights, most).withColumn("groups", F.ceil(F.col("n") / FAN)), "targets")
    numbered = counted.select("doc", "source", "words", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("nth"))
    units = with_totals(numbered, targets, "source", "n")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("size").cast("double")), F.lit(0.0))
    units = units.withColumns(
        {
            "whole": F.floor(rate).cast("int"),
            "share": F.when(F.col("words") > 0, rate - F.floor(rate)).otherwise(0.0),
            "kind": F.length(F.bin("words")),
            "mark": F.xxhash64("doc", "source", "words", "nth"),
        }
    )
    units = units.withColumns({"cell": F.pmod("mark", "groups"), "take": F.round("share").cast("int"), "open": F.col("share").between(CLOSE, 1 - CLOSE)})
    rounds, level = [stage(units, "units")], 0
    discard(counted, targets)
    while True:
        left = rounds[-1].where("open")
        if level:
            left = left.withColumns({"cell": F.floor(F.col("cell") / JOINED), "groups": F.ceil(F.col("groups") / JOINED)})
        rounds.append(stage(left.groupBy("source", "cell").applyInArrow(_group(level, seed), units.schema), "settled"))
        if not rounds[-1].where("open").limit(1).count():
            break
        level += 1
    done = reduce(DataFrame.unionByName, [r.where("NOT open") for r in rounds])
    return done.select(
        F.col("doc").alias(id), F.col("source").alias(source), F.col("words").alias("size"), F.col("size").alias("source_size"), "target", (F.col("whole") + F.col("take")).alias("copies")
    )


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixture`` takes it."""
    nth = lambda: F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.lit(0)))
    copies = mixture(docs, id, text, source, **more).select(F.col(id).alias("_id"), F.col(source).alias("_source"), F.col("size").alias("_size"), "copies")
    copies = copies.withColumn("_nth", nth()).select(F.struct("_id", "_source", "_size", "_nth").alias("_row"), F.col("copies").alias("_copies"))
    named = docs.withColumns({"_id": F.col(id), "_source": F.col(source), "_size": _words(text)}).withColumn("_nth", nth())
    met = named.withColumn("_own", F.struct("_id", "_source", "_size", "_nth")).join(copies, F.col("_own").eqNullSafe(F.col("_row")))
    return met.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])
