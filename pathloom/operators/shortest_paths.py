"""Cheapest paths for many searches at once, as joins.

A search has sources and perhaps targets.  Each round joins the nodes that improved in the
round before with the arcs of the search's cost profile, leaves out the edges that the search
avoids, and keeps the cheapest arrival at every node.  Only arrivals that beat what is known are written; the
tables of the rounds are merged from time to time.  The search ends when nothing improves, however many rounds that takes.
Arrivals beyond the search's cheapest target are dropped, which is the set-wise form of
stopping at the first settled target.

Rounds know costs only.  Once these are final, one pass over the arcs finds the way by which each node was
reached: of its arcs that are exactly as cheap as its cost the one from the cheapest node, then
the smallest, then with the smallest edge.  That is the way of a search which settles nodes by cost and number,
and it is the same however the rows are spread.  Paths are read back from the ends that are asked for, several edges a job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.plans.staging import buckets, discard, stage, stage_by

KEYS = ["search", "profile", "node"]
#: Tables of rounds that are read side by side before they are merged, and edges of a path that one job reads.
MERGED = 5
HOPS = 6
#: Nodes that one end of a search expands in its first round, twice as many in each further one; the shares of its open nodes that it can take.
FIRST, SHARES = 64, [2.0**-k for k in range(12, -1, -1)]
#: Sums of costs in another order may be off by rounding.
SLACK = 1 + 1e-9


def _known(tables: list[DataFrame]) -> DataFrame:
    """The cheapest cost of each node and the round that found it: costs fall from round to round, so that is the last one."""
    return reduce(DataFrame.unionByName, tables).groupBy(*KEYS).agg(F.min("cost").alias("cost"), F.max("round").alias("round"))


def _without(rows: DataFrame, avoid: DataFrame | None) -> DataFrame:
    """``rows`` (search, edge and others) without the edges that their search avoids."""
    return rows if avoid is None else rows.join(avoid, ["search", "edge"], "left_anti")


def cheapest_paths(
    arcs: DataFrame, sources: DataFrame, targets: DataFrame | None = None, avoid: DataFrame | None = None, *, with_path: bool = False
) -> DataFrame:
    """The cheapest cost of every node that a search reaches.

    arcs: profile, src, dst, edge, cost (not negative); several arcs may join two nodes.
    sources: search, profile, node.  targets: search, node; a search without any is not run.  avoid: search, edge.
    Result: search, profile, node, cost, the round that found it, and with_path the edges from the source in order.
    With targets, nodes that cost more than the cheapest target may be missing or not final; the targets up to the
    cheapest are final.
    """
    start = sources.select(*KEYS).distinct()
    if targets is not None:
        targets = stage(targets.select("search", "node").distinct(), "targets")
        start = start.join(targets.select("search").distinct(), "search", "left_semi")
    ways = arcs.select("profile", "src", F.col("dst").alias("to"), "edge", F.col("cost").alias("step"))
    shut, whole = None, avoid is None and targets is None
    if avoid is None:
        # Parallel arcs: only the cheapest can be on a path.
        few = lambda rows: rows.groupBy("profile", "src", "to").agg(F.min("step").alias("step")).withColumn("edge", F.lit(None).cast("long"))
        if whole:
            # A search of everything reads all arcs in every round: in buckets by where they begin, they are neither shuffled nor sorted.
            lean = stage_by(few(ways.repartition(buckets(ways.sparkSession), "profile", "src")), "arcs", "profile", "src")
        else:
            lean = stage(few(ways), "arcs")
    else:
        # Read in every round by search and edge, without being shuffled.
        lean, shut = stage(ways, "arcs"), stage_by(avoid.select("search", "edge").distinct(), "avoided", "search", "edge")
    fresh = stage(start.select(*KEYS, F.lit(0.0).alias("cost"), F.lit(0).alias("round")), "round")
    tables, bounds, number = [fresh], None, 0
    while True:
        number += 1
        front = fresh.drop("round").withColumnRenamed("node", "src")
        new = (front.hint("shuffle_hash") if whole else front).join(lean, ["profile", "src"])
        new = new.select("search", "profile", F.col("to").alias("node"), "edge", (F.col("cost") + F.col("step")).alias("cost"))
        if bounds is not None:
            new = new.join(bounds, "search", "left").where(F.col("bound").isNull() | (F.col("cost") <= F.col("bound"))).drop("bound")
        new = _without(new, shut).select(*KEYS, "cost", F.lit(None).cast("double").alias("before"))
        # What is known and what arrives meet in one aggregate.
        told = [t.select(*KEYS, F.lit(None).cast("double").alias("cost"), F.col("cost").alias("before")) for t in tables]
        rows = reduce(DataFrame.unionByName, [new, *told]).groupBy(*KEYS).agg(F.min("cost").alias("cost"), F.min("before").alias("before"))
        better = F.col("cost").isNotNull() & (F.col("before").isNull() | (F.col("cost") < F.col("before")))
        fresh = stage(rows.where(better).drop("before").withColumn("round", F.lit(number)), "round")
        if not fresh.limit(1).count():
            break
        tables.append(fresh)
        if len(tables) >= MERGED:
            # The last round stays apart: the next one starts from it.
            merged = stage(_known(tables[:-1]), "rounds")
            discard(*tables[:-1])
            tables = [merged, fresh]
            if targets is not None:
                # A bound that is some rounds old is still one, and a written one costs the rounds no jobs of their own.
                bound = reduce(DataFrame.unionByName, tables).join(targets, ["search", "node"]).groupBy("search").agg(F.min("cost").alias("bound"))
                discard(*([bounds] if bounds is not None else []))
                bounds = stage(bound, "bounds")
    found = stage(_known(tables), "paths")
    discard(lean, fresh, *tables, *[t for t in (bounds, targets, shut) if t is not None])
    return paths_back(found, came_by(found, arcs, avoid)) if with_path else found


def corridor(
    arcs: DataFrame, sources: DataFrame, targets: DataFrame, avoid: DataFrame | None = None, price: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The arcs among which every search has its cheapest ways to its cheapest targets, all equally cheap ones with them, and the searches that have any (search).

    arcs, sources, targets and avoid: as of ``cheapest_paths``; arcs and avoid are read in every round and had better be staged.
    price: of arcs without profile and cost, those that the profile beside them may use, with their cost.  It sees only the arcs that a
    round's nodes meet, so all profiles read one table and no other arc is priced.

    A search grows from both its ends.  A round expands the cheapest open nodes of each end, twice as many as the round before.  What
    is cheaper than an end's cheapest open node is settled, so once both radii together exceed the cheapest meeting found, each node of a
    cheapest way lies in one of the two balls; and if one end has no open node left, nothing more is to be found.  Two balls of half
    the way hold far fewer nodes than one of all of it, so a round's nodes are few beside the arcs and these are read but not shuffled.
    """
    both, by = ["search", "profile", "node"], ["profile"] if price is None else []
    price = price or (lambda rows: rows)
    none = F.lit(None).cast("struct<cost:double,open:int>")
    begin = F.struct(F.lit(0.0).alias("cost"), F.lit(1).alias("open"))
    start = sources.select(*both).distinct().join(targets.select("search").distinct(), "search", "left_semi")
    ends = targets.select("search", "node").distinct().join(sources.select("search", "profile").distinct(), "search").select(*both)
    # Of each node the cheapest cost from the sources and to the targets; an expanded one goes before an open one that is as cheap.
    merged = lambda rows: rows.groupBy(*both).agg(F.min("f").alias("f"), F.min("b").alias("b"))
    state = stage(merged(start.select(*both, begin.alias("f"), none.alias("b")).unionByName(ends.select(*both, none.alias("f"), begin.alias("b")))), "balls")
    number = 0
    while True:
        opened = {e: F.when(F.col(f"{e}.open") == 1, F.col(f"{e}.cost")) for e in "fb"}
        facts = [F.min(opened[e]).alias(f"r{e}") for e in "fb"] + [F.count(opened[e]).alias(f"n{e}") for e in "fb"]
        facts += [F.percentile_approx(opened[e], SHARES).alias(f"p{e}") for e in "fb"]
        known = state.groupBy("search").agg(F.min(F.col("f.cost") + F.col("b.cost")).alias("met"), *facts)
        infinite = F.lit(float("inf"))
        bound = F.coalesce(F.col("met") * SLACK, infinite)
        known = known.withColumn("done", F.col("rf").isNull() | F.col("rb").isNull() | (F.col("rf") + F.col("rb") > bound))
        known = stage(known, "radii")
        if not known.where("NOT done").limit(1).count():
            break
        wanted = float(FIRST << min(number, 40))
        number += 1
        reach = {}
        for e, other in ("fb", "bf"):
            fits = F.filter(F.zip_with(F.col(f"p{e}"), F.lit(SHARES), lambda v, share: F.when(share * F.col(f"n{e}") <= wanted, v)), lambda v: v.isNotNull())
            # No node need be expanded that is dearer than the meeting less the other end's radius.
            reach[e] = F.least(F.greatest(F.coalesce(F.array_max(fits), F.col(f"r{e}")), F.col(f"r{e}")), bound - F.col(f"r{other}")).alias(f"to{e}")
        live = known.where("NOT done").select("search", reach["f"], reach["b"])
        near = stage(state.join(live, "search").where(F.greatest(*[F.coalesce(opened[e] <= F.col(f"to{e}"), F.lit(False)) for e in "fb"])), "near")
        came = []
        for e, at, to in (("f", "src", "dst"), ("b", "dst", "src")):
            front = near.where(opened[e] <= F.col(f"to{e}")).select("search", "profile", F.col("node").alias(at), F.col(f"{e}.cost").alias("_cost"))
            new = price(front.join(arcs, [*by, at]))
            cost = F.struct((F.col("_cost") + F.col("cost")).alias("cost"), F.lit(1).alias("open"))
            came.append(new.select("search", "profile", F.col(to).alias("node"), "edge", *[(cost if x == e else none).alias(x) for x in "fb"]))
        came = came[0].unionByName(came[1])
        if avoid is not None:
            # Read against the few edges of the round, the avoided ones are not shuffled either.
            met = stage(came, "came")
            shut = avoid.join(met.select("search", "edge").distinct(), ["search", "edge"], "left_semi")
            came = _without(met, shut)
        reached = {e: F.col(f"to{e}") for e in "fb"}
        closed = {e: F.when(opened[e] <= reached[e], F.struct(F.col(f"{e}.cost").alias("cost"), F.lit(0).alias("open"))).otherwise(F.col(e)).alias(e) for e in "fb"}
        kept = state.join(live, "search", "left").select(*both, closed["f"], closed["b"])
        before, state = state, stage(merged(kept.unionByName(came.drop("edge"))), "balls")
        discard(before, near, known, *([met] if avoid is not None else []))
    held = state.join(known.where("met IS NOT NULL").select("search", "met", "rf", "rb"), "search")
    inside = [F.coalesce(F.col(f"{e}.cost") <= F.least(F.coalesce(f"r{e}", infinite), F.col("met") * SLACK), F.lit(False)) for e in "fb"]
    inner = stage(held.where(inside[0] | inside[1]).select("profile", "node").distinct(), "inner")
    lean = arcs.join(inner.withColumnRenamed("node", "src"), [*by, "src"]).join(inner.withColumnRenamed("node", "dst"), ["profile", "dst"], "left_semi")
    lean = price(lean).select("profile", "src", "dst", "edge", "cost")
    lean, served = stage(lean, "corridor"), stage(known.where("met IS NOT NULL").select("search"), "served")
    discard(state, known, inner)
    return lean, served


def came_by(found: DataFrame, arcs: DataFrame, avoid: DataFrame | None = None) -> DataFrame:
    """``found`` with the edge and the node before each node, null at a source.

    found, arcs and avoid: as of ``cheapest_paths``.  Where a node is as cheap as the one before it, over an arc that costs
    nothing, the one before was found in an earlier round; so no path turns back on itself.
    """
    from_ = found.select("search", "profile", F.col("node").alias("prev"), F.col("cost").alias("prev_cost"), F.col("round").alias("prev_round"))
    ways = arcs.select("profile", F.col("src").alias("prev"), F.col("dst").alias("node"), "edge", F.col("cost").alias("step"))
    met = _without(from_.join(ways, ["profile", "prev"]), avoid).join(found, KEYS)
    tight = (F.col("prev_cost") + F.col("step") == F.col("cost")) & ((F.col("prev_cost") < F.col("cost")) | (F.col("prev_round") < F.col("round")))
    first = met.where(tight).groupBy(*KEYS).agg(F.min(F.struct("prev_cost", "prev", "edge")).alias("a")).select(*KEYS, "a.edge", "a.prev")
    return stage(found.join(first, KEYS, "left"), "ways")


def paths_back(ends: DataFrame, found: DataFrame) -> DataFrame:
    """``ends`` (search, node and any others) with ``path``, the edges from a source in order, and ``nodes``, one more than edges.

    found: rows of ``came_by``.
    """
    steps = found.select("search", F.col("node").alias("at"), F.col("edge").alias("_edge"), F.col("prev").alias("_prev"))
    rows = ends.select("*", F.col("node").alias("at"), F.array().cast("array<long>").alias("path"), F.array("node").alias("nodes"))
    while True:
        before = rows
        for _ in range(HOPS):
            # A path that has come to its source stays there.
            longer = [F.when(F.col("_edge").isNotNull(), F.concat(F.array(new), F.col(c))).otherwise(F.col(c)).alias(c) for new, c in (("_edge", "path"), ("_prev", "nodes"))]
            rows = rows.join(steps, ["search", "at"]).select(*ends.columns, F.coalesce("_prev", "at").alias("at"), F.col("_edge").isNull().alias("done"), *longer)
        rows = stage(rows, "back")
        discard(before)
        if not rows.where("NOT done").limit(1).count():
            return rows.drop("at", "done")
        rows = rows.drop("done")


def cheapest_target(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """The target that each search reaches first, ties by node."""
    met = paths.join(targets, ["search", "node"])
    columns = [c for c in paths.columns if c not in ("search", "cost", "node")]
    return met.groupBy("search").agg(F.min(F.struct("cost", "node", *columns)).alias("m")).select("search", "m.*")
