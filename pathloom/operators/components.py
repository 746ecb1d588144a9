"""Connected components of an undirected edge table, by contraction.

In each round every node joins the neighbour that comes first in an order by hash,
unless it comes first itself; edges then run between the groups so made, loops and repeats go.
About half of a chain's nodes are left after a round, and one of a star's after two, as its centre
has joined the very first by then; groups without edges to others leave the loop.  The groups of all rounds are then put together from the last
round to the first.  Every round is written to the shared folder, which keeps the
plans short and survives a lost executor; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.plans.staging import discard, stage


def _rank(node: str) -> Column:
    return F.xxhash64(node)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component``, the smallest node of its component, for every endpoint.

    Loops and repeated edges do no harm; edges with a null end are ignored; no edges give
    no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    # A loop stays in the first round, so that its node has a row.
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    joined = []
    while True:
        # Which of equal hashes is taken is no matter: any neighbour is in the same component.
        first = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", _rank("b")).alias("near"), F.min(_rank("b")).alias("rank"))
        group = F.when(_rank("node") <= F.col("rank"), F.col("node")).otherwise(F.col("near"))
        joined.append(stage(first.select("node", group.alias("group")), "groups"))
        ends = [joined[-1].select(F.col("node").alias(c), F.col("group").alias(f"_{c}")) for c in ("a", "b")]
        between = both.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct()
        before, both = both, stage(between, "edges")
        discard(before)
        if not both.limit(1).count():
            break
    discard(both)
    last = joined[-1]
    for earlier in reversed(joined[:-1]):
        later = last.select(F.col("node").alias("group"), F.col("group").alias("_last"))
        last = earlier.join(later, "group", "left").select("node", F.coalesce("_last", "group").alias("group"))
    last = stage(last, "components")
    discard(*joined)
    smallest = last.groupBy("group").agg(F.min("node").alias("component"))
    return last.join(smallest, "group").select("node", "component")
