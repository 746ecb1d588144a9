"""N-gram Jaccard self-join of documents with several global token orders.

A document is its set of word shingles.  Two sets whose Jaccard similarity reaches the
threshold share a token within their prefixes, the first tenth or so of each set, under
*every* global order of the tokens.  The first order yields candidate pairs by an equi-join
on prefix tokens, of which a pair must share ``SHARED`` and one for each ``PER`` tokens of
the smaller set, in prefixes that are longer by as many less one; the prefixes under further orders are intersected for each pair; only pairs
that share a token under all of them are verified, on the whole sets.  (Different sets of a
similarity of 0.9 have nine tokens in common or more, so ``SHARED`` is never too many; the
number is lowered for a lower similarity.)  Of the shared tokens more than half are in
buckets of at most ``BUCKET`` classes, or at least half in larger ones, and either kind of
candidate is counted on its own.

All orders put very common shingles last, so that stock lines do not make candidates.  Which
shingles count as common changes the work and never the result.

Equal sets are one class from the start.  Links between classes feed connected components.

A prefix bucket of more than ``BUCKET`` classes, such as a family of thousands of near
copies, is never expanded into all its pairs.  Its members are compared with its leader,
the most central of them.  Two members that link to the leader are in one component already.  For
any other pair x, y and the leader l, let dx be the tokens that only one of x and l has.
The tokens that only one of x and y has are then those of just one of dx and dy, so a link
means that dx and dy have much in common, and prefixes of dx and dy, rare tokens first,
share a token: floor(t / 2) + 1 of the smaller and floor(t) + 1 of the larger of them, where
t bounds the difference of linked sets.  (There is something in common for sure, since
a y that does not link to l differs from l by more than it may from x with dx empty.)
Members that differ from the leader in their own rare tokens thus meet hardly anyone.
Members that lack the same tokens of the leader do meet; of their pairs only those become
rows that the places of the shared token, and parity marks of the whole sets (a bitmap whose
differing bits are never more than the tokens that only one of two sets has), leave within t.

Defined results: texts are cut into words at ASCII white space and lower-cased in A-Z; a
text of fewer words than a shingle is one shingle; null and wordless texts have an empty
set and link with nothing; rows with a null id are in no component; repeated rows share a
class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.operators.components import connected_components
from pathloom.plans.staging import discard, stage

ORDERS = (11, 23, 37)
BUCKET = 32
#: Bits of a set's parity marks.
MARKS = 512
#: Bounds of what is broadcast: common shingles, and ids of candidate documents.
COMMON = 1 << 18
CANDIDATES = 1 << 20
#: Shingles of one counting step, and documents of it that make a shingle common.
STEP = 1 << 21
OFTEN = 3
#: Tokens that a pair must share within its prefixes under the first order, which are longer for it.
SHARED = 8
PER = 20


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = K.scan(column, K.SPACE)
    hashes, at = K.windows(words, n)
    cuts = np.searchsorted(at, words.first)
    for i in range(len(column)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= n:
            yield np.unique(hashes[cuts[i] : cuts[i + 1]])
        elif b > a:
            h = np.zeros(1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(a, b):
                    h = h * np.uint64(K.BASE) + words.hashes[k]
            yield K.mix(h, n + b - a)
        else:
            yield hashes[:0]


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(K.mix(np.array([K.mix(shingles, 5).sum() + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


def prefix(shingles: np.ndarray, common: np.ndarray, order: int, percent: int, shared: int = 1) -> np.ndarray:
    """The first tokens under an order, of which two sets of this similarity share so many or more."""
    n = len(shingles)
    keep = n - (percent * n + 99) // 100 + shared
    key = K.mix(shingles, order) >> np.uint64(1)
    if len(common):
        place = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        key = key | ((common[place] == shingles).astype(np.uint64) << np.uint64(63))
    if keep < n:
        return shingles[np.argpartition(key, keep - 1)[:keep]]
    return shingles


def marks(shingles: np.ndarray) -> np.ndarray:
    """Parity of the tokens at each of MARKS places: sets differ in no fewer tokens than in marks."""
    place = (K.mix(shingles, 3) % np.uint64(MARKS)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=MARKS) & 1).view(np.uint64)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """At most COMMON shingles that many documents hold, counted over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def often() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= OFTEN
            return pa.record_batch([pa.array(values[keep].view(np.int64)), pa.array(counts[keep])], ["token", "n"])

        for batch in batches:
            for piece in K.slices(batch, "text"):
                for s in shingle_sets(piece.column(0), n):
                    held.append(s)
                    size += len(s)
                if size >= STEP:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(COMMON).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().astype(np.int64).view(np.uint64))


def _mapped(docs: DataFrame, rows: Callable[[int, np.ndarray], tuple], names: list[str], schema: str, n: int) -> DataFrame:
    """rows: of a document id and its set, the numbers and arrays of the output row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch, "text"):
                made = [rows(i, s) for i, s in zip(piece.column(0).to_pylist(), shingle_sets(piece.column(1), n), strict=True)]
                columns = list(zip(*made, strict=True))
                yield pa.record_batch(
                    [
                        _longs(list(c)) if isinstance(c[0], np.ndarray) else pa.array(c, pa.int64())
                        for c in columns
                    ],
                    names,
                )

    return docs.mapInArrow(run, schema)


def jaccard_components(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90
) -> DataFrame:
    """``id``, n_shingles and component_id of every document at a Jaccard of ``percent`` or more."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(docs, n))

    # Different sets have a union of at least ``least`` tokens and ``least - 1`` in common.
    least = -(-100 // (100 - percent)) if percent < 100 else 1 << 30
    share = max(1, min(SHARED, least - 1))

    def describe(i: int | None, s: np.ndarray) -> tuple:
        empty = i is None or not len(s)
        tokens = s[:0] if empty or len(s) < least - 1 else prefix(s, common.value, ORDERS[0], percent, share + len(s) // PER)
        return i, len(s), None if empty else class_of(s), tokens

    members = stage(
        _mapped(docs, describe, ["id", "n", "cls", "prefix"], "id long, n long, cls long, prefix array<long>", n), "sets"
    )
    known = members.where("cls IS NOT NULL")
    classes = stage(known.groupBy("cls").agg(F.min("id").alias("head")), "classes")
    tokens = known.where(F.size("prefix") > 0).groupBy("cls").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    tokens = tokens.select("cls", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    sizes = tokens.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("size")).where("size > 1")
    shared = stage(tokens.join(sizes, "token"), "shared")
    links = _links(docs, classes, shared, common, n, percent, share)
    if links is None:
        named = classes.select("cls", F.col("head").alias("component_id"))
    else:
        roots = connected_components(links)
        named = classes.join(roots, classes.cls == roots.node, "left").select(
            "cls", "head", F.coalesce("component", "cls").alias("root")
        )
        heads = named.groupBy("root").agg(F.min("head").alias("component_id"))
        named = named.join(heads, "root").select("cls", "component_id")
    return members.select("id", "n", "cls").join(named, "cls", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def _links(
    docs: DataFrame, classes: DataFrame, shared: DataFrame, common, n: int, percent: int, share: int
) -> DataFrame | None:
    """Enough verified links between classes for the exact components; None if no class has a candidate."""
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    left = shared.where(F.col("size") <= BUCKET).select("token", F.col("cls").alias("a"), F.col("n").alias("na"))
    right = left.select("token", F.col("a").alias("b"), F.col("na").alias("nb"))
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & near(F.col("na"), F.col("nb")))
    # A pair with fewer shared tokens in small buckets meets in a large one, or is none.
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.first(F.least("na", "nb")).alias("n"))
    must = F.lit(share) + F.floor(F.col("n") / PER)
    pairs = stage(pairs.where(F.col("m") > F.floor(must / 2)).select("a", "b"), "pairs")
    large = shared.where(F.col("size") > BUCKET).select("token", "cls", "n")
    must = F.lit(share) + F.floor(F.col("n") * percent / (100 * PER))
    counts = large.groupBy("cls").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    enough = counts.where(F.col("m") >= must - F.floor(must / 2)).select("cls")
    large = stage(large.join(enough, "cls", "left_semi"), "large")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    wanted = stage(wanted.unionByName(large.select("cls")).distinct().join(classes, "cls"), "wanted")
    count = wanted.count()
    if not count:
        return None
    ids = wanted.select(F.col("head").alias("id")).distinct()
    # The ids fit a broadcast up to a stated number; beyond it the texts are shuffled.
    texts = docs.join(F.broadcast(ids) if count <= CANDIDATES else ids, "id", "left_semi")

    def describe(i: int, s: np.ndarray) -> tuple:
        return (class_of(s), s, marks(s), *[prefix(s, common.value, order, percent) for order in ORDERS[1:]])

    more = [f"prefix{k}" for k in range(1, len(ORDERS))]
    schema = "cls long, tokens array<long>, marks array<long>, " + ", ".join(f"{m} array<long>" for m in more)
    sets = _mapped(texts, describe, ["cls", "tokens", "marks", *more], schema, n)
    # Repeated rows or ids may bring a class twice: each set counts once, as large buckets take the tokens of a class together.
    sets = stage(sets.where(F.size("tokens") > 0).dropDuplicates(["cls"]), "candidates")

    def of(pairs: DataFrame, *columns: str) -> DataFrame:
        """The sets in the pairs; their names fit a broadcast up to a stated number."""
        names = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        few = 2 * pairs.count() <= CANDIDATES
        return sets.select("cls", *columns).join(F.broadcast(names) if few else names, "cls", "left_semi")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        pairs = stage(pairs, label)
        near_sets = of(pairs, *more)
        for m in ("a", "b"):
            pairs = pairs.join(near_sets.select(F.col("cls").alias(m), *[F.col(p).alias(f"{p}{m}") for p in more]), m)
        for p in more:
            pairs = pairs.where(F.arrays_overlap(f"{p}a", f"{p}b"))
        pairs = stage(pairs.select("a", "b"), label)
        whole_sets = of(pairs, "tokens")
        for m in ("a", "b"):
            pairs = pairs.join(whole_sets.select(F.col("cls").alias(m), F.col("tokens").alias(f"tokens{m}")), m)
        same = F.size(F.array_intersect("tokensa", "tokensb"))
        union = F.size("tokensa") + F.size("tokensb") - same
        found = pairs.where(100 * same >= percent * union).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        return stage(found, label)

    links = verified(pairs, "links")
    if not large.limit(1).count():
        return links
    return links.unionByName(_large_buckets(large, of, verified, more, near, percent))


def _large_buckets(
    large: DataFrame, of: Callable, verified: Callable, more_orders: list[str], near: Callable[[Column, Column], Column], percent: int
) -> DataFrame:
    """Links of large buckets: with their leaders, and between members that differ from a leader alike."""
    sets = stage(of(large.select(F.col("cls").alias("a"), F.col("cls").alias("b")).distinct(), "tokens", "marks", *more_orders), "members")
    # The tokens of each set, those that the fewest of these sets hold first.  Both sides of the
    # join are stored, so that tokens are listed once and Spark can split the rows of one that all sets hold.
    each = stage(sets.select("cls", F.explode("tokens").alias("token")), "tokens")
    counts = stage(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "df")
    counted = each.join(counts, "token")
    ordered = counted.groupBy("cls").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("s"),
        F.sum(F.when(F.col("df") > BUCKET, 1).otherwise(-1)).alias("centre"),
    )
    ordered = ordered.select("cls", F.transform("s", lambda x: x["token"]).alias("own"), "centre")
    ordered = stage(ordered.join(sets.select("cls", "marks", *more_orders), "cls"), "ordered")
    discard(counts, each)
    # The leader is the most central member: many tokens that the others hold, few of its own.
    central = F.max(F.struct("centre", "cls"))["cls"]
    leaders = large.join(ordered.select("cls", "centre"), "cls").groupBy("token").agg(central.alias("lead"))
    star = large.join(leaders, "token").where("cls <> lead").select("lead", "cls").distinct()
    led = ordered.select(F.col("cls").alias("lead"), F.col("own").alias("other"), *[F.col(p).alias(f"{p}lead") for p in more_orders])
    met = star.join(ordered, "cls").join(led, "lead")
    # A member that links to its leader shares prefix tokens with it under the further orders, as any pair does.
    filtered = reduce(Column.__and__, [F.arrays_overlap(p, f"{p}lead") for p in more_orders])
    # A token that most of these sets hold is the one that a set seldom lacks.
    more, less = F.array_except("own", "other"), F.reverse(F.array_except("other", "own"))
    met = met.select(
        "lead", "cls", "marks", filtered.alias("met"), F.size("own").alias("n"), F.size("other").alias("m"), more.alias("more"), less.alias("less")
    )
    same = F.col("n") - F.size("more")
    met = met.select(
        "lead",
        "cls",
        "marks",
        "n",
        (F.size("more") + F.size("less")).alias("d"),
        (F.col("met") & (100 * same >= percent * (F.col("n") + F.col("m") - same))).alias("linked"),
        F.slice(F.concat("more", "less"), F.lit(1), _apart(F.col("n"), percent) + 1).alias("long"),
        (F.floor(F.col("n") * (100 - percent) / (2 * percent)).cast("int") + 1).alias("reach"),
    )
    met = stage(met, "met")
    rest = _alike(met.select("*", F.posexplode("long").alias("at", "token")), near, percent)
    return met.where("linked").select(F.col("lead").alias("src"), F.col("cls").alias("dst")).unionByName(verified(rest, "rest"))


def _apart(n: Column, percent: int) -> Column:
    """The most tokens that only one of two linked sets has, if one of them has n tokens."""
    return F.floor(n * (100 - percent) / percent).cast("int")


def _alike(each: DataFrame, near: Callable[[Column, Column], Column], percent: int) -> DataFrame:
    """Pairs whose differences from a leader share a token, unless a bound says that they are too far apart for a link.

    The bounds stand in the join's condition, so that pairs beyond them are never rows.
    """
    side = lambda x: [F.col(c).alias(c + x) for c in ("cls", "n", "d", "linked", "at", "marks")]
    small = each.where(F.col("at") < F.col("reach")).select("lead", "token", *side("a"))
    big = each.select("lead", "token", *side("b"))
    apart = _apart(F.least("na", "nb"), percent)
    # Both differences are in one order: before and after a shared token they have as much in
    # common as the shorter of the two parts.
    before = F.least("ata", "atb")
    after = F.least(F.col("da") - F.col("ata"), F.col("db") - F.col("atb"))
    placed = F.col("da") + F.col("db") - 2 * (before + after) <= apart
    marked = reduce(Column.__add__, [F.bit_count(F.col("marksa")[k].bitwiseXOR(F.col("marksb")[k])) for k in range(MARKS // 64)])
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("clsa") < F.col("clsb")))
    rest = small.join(big, ["lead", "token"]).where(
        first & ~(F.col("linkeda") & F.col("linkedb")) & near(F.col("na"), F.col("nb")) & placed & (marked <= apart)
    )
    return rest.select(F.least("clsa", "clsb").alias("a"), F.greatest("clsa", "clsb").alias("b")).distinct()


def one_per_group(docs: DataFrame, *, id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """The documents that head their component: one of each group of near copies stays.

    Of rows that repeat the heading id, one stays for each distinct text; rows without an
    id stay.
    """
    found = stage(jaccard_components(docs, id=id, text=text, n=n, percent=percent), "groups")
    out = found.where(F.col(id) != F.col("component_id")).select(id).distinct()
    rest = docs.join(out, id, "left_anti").select(*docs.columns)
    again = found.groupBy(id).count().where((F.col("count") > 1) & F.col(id).isNotNull()).select(id)
    if not again.limit(1).count():
        return rest
    # The row goes as one column, so that no name of its own is in the way.
    once = rest.join(again, id, "left_semi").select(F.col(id).alias("i"), F.xxhash64(F.col(text)).alias("t"), F.struct(*docs.columns).alias("row"))
    once = once.dropDuplicates(["i", "t"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return rest.join(again, id, "left_anti").select(*docs.columns).unionByName(once)
