"""Whole answers to requests: the verified path or the cheapest route, with its line, steps, hazards and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import cost as C
from pathloom.functions import geo
from pathloom.operators import routing
from pathloom.plans.staging import stage

#: What is assumed of a verified path whose safety was not measured, in percent.
ASSUMED_SAFETY = 92.0
#: Shares of a pair's verified paths that are put in order apart.
DEALT = 32


def first_verified(requests: DataFrame, doors: DataFrame, edges: DataFrame, avoid: DataFrame | None = None) -> DataFrame:
    """search, edge, backwards: of each request's verified paths that it does not avoid (search, edge), the one with the smallest number.

    Paths are found once for a pair of places.  A request that avoids k of its pair's paths takes one of the first k + 1, so it meets only these.
    """
    asked = requests.select(F.col("request").alias("search"), *routing.PAIR)
    ways = stage(routing.verified_ways(asked.select(*routing.PAIR).distinct(), doors, edges), "ways")
    if avoid is None:
        first = ways.groupBy(*routing.PAIR).agg(F.min(F.struct("edge", "backwards")).alias("v"))
        return asked.join(first, routing.PAIR).select("search", "v.*")
    shut = asked.join(avoid.select("search", "edge").distinct(), "search").join(ways.select(*routing.PAIR, "edge").distinct(), [*routing.PAIR, "edge"])
    shut = stage(shut.select("search", *routing.PAIR, "edge"), "shut")
    most = shut.groupBy("search", *routing.PAIR).count().groupBy(*routing.PAIR).agg((F.max("count") + 1).alias("most"))
    first = ways.join(most, routing.PAIR, "left").withColumns({"most": F.coalesce("most", F.lit(1)), "deal": F.pmod(F.xxhash64("edge"), F.lit(DEALT))})
    # Within shares first, so that no pair's paths are put in order by one task.
    for by in ([*routing.PAIR, "deal"], routing.PAIR):
        first = first.withColumn("k", F.dense_rank().over(Window.partitionBy(*by).orderBy("edge"))).where("k <= most")
    first = first.drop("most", "deal")
    room = asked.join(shut.groupBy("search").agg(F.count(F.lit(1)).alias("gone")), "search", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    rows = room.join(first, routing.PAIR).where(F.col("k") <= F.col("gone") + 1).join(shut.select("search", "edge"), ["search", "edge"], "left_anti")
    return rows.groupBy("search").agg(F.min(F.struct("edge", "backwards")).alias("v")).select("search", "v.*")


def answers(
    edges: DataFrame, hazards: DataFrame, doors: DataFrame, requests: DataFrame, avoid: DataFrame | None = None, ways: DataFrame | None = None
) -> DataFrame:
    """A row for each request with a way: the columns of ``routing.routes``, and ``surveyed``: the way is a verified path.

    A verified path that the request does not avoid is taken as it is, whatever the mode's gates, and is not searched for; it costs its
    time.  avoid: search, edge; ways: as of ``routing.routes``.  Requests without any way have no row; a request from a place to itself has a path without edges.
    """
    mine = stage(first_verified(requests, doors, edges, avoid), "verified")
    rest = requests.join(mine.select(F.col("search").alias("request")), "request", "left_anti")
    found = routing.routes(edges, hazards, doors, rest, avoid, ways).withColumn("surveyed", F.lit(False))
    path = edges.select(F.col("id").alias("edge"), "from_node", "to_node", "distance_m")
    asked = requests.withColumnRenamed("request", "search").select("search", "mode", "night", "smarter")
    rows = mine.join(path, "edge").join(asked, "search")
    ends = F.when(F.col("backwards"), F.array("to_node", "from_node")).otherwise(F.array("from_node", "to_node"))
    taken = rows.select(
        "search",
        (F.col("distance_m") / C.speed(F.col("mode"))).alias("cost"),
        F.get(ends, F.lit(1)).alias("node"),
        routing.profile_name(F.col("smarter") & (F.col("mode") == "walking")).alias("profile"),
        F.array("edge").alias("path"),
        ends.alias("nodes"),
        F.lit(True).alias("surveyed"),
    )
    return taken.unionByName(found.select(*taken.columns))


def lines(found: DataFrame, edges: DataFrame, nodes: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """search, line: [lng, lat] points along the drawn lines of a route's edges, joints once; without edges, the node.

    edges: with ``geometry``, JSON text or null.  rows: ``routing.route_edges`` of both, if they are at hand.
    """
    spot = lambda c, p: nodes.select(F.col("id").alias(c), F.col("longitude").alias(f"{p}_lng"), F.col("latitude").alias(f"{p}_lat"))
    rows = (routing.route_edges(found, edges) if rows is None else rows).select("search", "pos", "a", "b", "geometry", (F.col("a") != F.col("from_node")).alias("back"))
    rows = rows.join(spot("a", "a"), "a").join(spot("b", "b"), "b")
    rows = rows.withColumn("line", geo.edge_line(F.col("geometry"), F.col("back"), *[F.col(c) for c in ("a_lng", "a_lat", "b_lng", "b_lat")]))
    before = F.lag(F.element_at("line", -1)).over(Window.partitionBy("search").orderBy("pos"))
    joint = F.coalesce(before == F.get("line", F.lit(0)), F.lit(False))
    rows = rows.select("search", "pos", F.when(joint, F.slice("line", F.lit(2), F.size("line"))).otherwise(F.col("line")).alias("line"))
    sewn = rows.groupBy("search").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("all"))
    sewn = sewn.select("search", F.flatten(F.transform("all", lambda x: x["line"])).alias("line"))
    still = found.where(F.size("path") == 0).join(nodes, found.node == nodes.id)
    return sewn.unionByName(still.select("search", F.array(F.array("longitude", "latitude")).alias("line")))


def statistics(rows: DataFrame) -> DataFrame:
    """The summary of each route; a verified path counts as verified, compliant and measured throughout.

    rows: as of ``routing.route_edges``, with ``surveyed``.
    """
    known = rows.groupBy("search").agg(F.bool_or("surveyed").alias("surveyed"))
    given = {c: F.lit(0.0) for c in ("rough_m", "unlit_m", "shortcut_m", "unknown_m")}
    given |= {c: F.lit(100.0) for c in ("accessibility_score", "verified_percent", "compliant_percent")}
    given |= {
        "verified_m": F.col("distance_m"),
        "verified_segments": F.col("segments"),
        "shortcut_spaces": F.array().cast("array<string>"),
        "safety_score": F.coalesce(F.nullif("safety_score", F.lit(0.0)), F.lit(ASSUMED_SAFETY)),
    }
    sums = routing.summary(rows).join(known, "search")
    return sums.withColumns({c: F.when(F.col("surveyed"), x).otherwise(F.col(c)) for c, x in given.items()})


def documents(found: DataFrame, requests: DataFrame, edges: DataFrame, hazards: DataFrame, nodes: DataFrame) -> DataFrame:
    """One nested row for each answer: search, outcome, mode, night, start_node, end_node, edges, stats, steps, hazards, line.

    found: as of ``answers``; edges: with ``geometry``.  Hazards are the active ones on its edges, whatever the time of day.  The parts
    are brought together as rows and grouped once by search.  A path without edges has no stats, steps or hazards.
    """
    asked = requests.select(F.col("request").alias("search"), "mode", "night")
    # Every part reads the edges of the answers and their nodes; the tables of all edges and nodes are read once.
    rows = stage(routing.route_edges(found, edges).join(found.select("search", "surveyed"), "search").join(asked, "search"), "rows")
    nodes = stage(nodes.join(found.select(F.explode("nodes").alias("id")).distinct(), "id", "left_semi"), "spots")
    head = found.join(asked, "search").select(
        "search",
        F.struct(
            F.when(F.col("surveyed"), "verified").otherwise("route").alias("outcome"),
            "mode",
            "night",
            F.get("nodes", F.lit(0)).alias("start_node"),
            F.col("node").alias("end_node"),
            F.col("path").alias("edges"),
        ).alias("head"),
    )
    sums = statistics(rows).drop("surveyed", "graded")
    stats = sums.select("search", F.struct(*[c for c in sums.columns if c != "search"]).alias("stats"))
    step = F.struct("step", "edge_id", "kind", "name", "surface", "distance_m", "risers", "cautions", "instruction")
    steps = routing.guided(rows, nodes, surveyed="surveyed").select("search", step.alias("one_step"))
    met = hazards.where("active").select(F.col("edge_id").alias("id"), F.struct("id", "title", "severity", "edge_id", "active_when", "latitude", "longitude").alias("hazard"))
    warned = rows.select("search", "id").join(met, "id").select("search", "hazard")
    parts = [head, stats, steps, warned, lines(found, edges, nodes, rows)]
    together = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    whole = together.groupBy("search").agg(
        F.first("head", ignorenulls=True).alias("head"),
        F.first("stats", ignorenulls=True).alias("stats"),
        F.array_sort(F.collect_list("one_step")).alias("steps"),
        F.array_sort(F.collect_list("hazard")).alias("hazards"),
        F.first("line", ignorenulls=True).alias("line"),
    )
    return whole.select("search", "head.*", "stats", "steps", "hazards", "line")


def as_json(told: DataFrame) -> DataFrame:
    """search, document: the rows of ``documents`` as JSON text."""
    return told.select("search", F.to_json(F.struct(*[c for c in told.columns if c != "search"])).alias("document"))


def recalculated(
    edges: DataFrame,
    hazards: DataFrame,
    doors: DataFrame,
    requests: DataFrame,
    previous: DataFrame,
    avoid: DataFrame | None = None,
    ways: DataFrame | None = None,
) -> DataFrame:
    """``answers`` without the edges of each request's previous answer (search, path), and without those it avoids already (search, edge)."""
    gone = previous.select("search", F.explode("path").alias("edge"))
    gone = gone if avoid is None else gone.unionByName(avoid.select("search", "edge"))
    return answers(edges, hazards, doors, requests, gone.distinct(), ways)
