"""Routes: arcs, terminals, search, summary, steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import cost as C
from pathloom.operators.shortest_paths import came_by, cheapest_paths, cheapest_target, corridor, paths_back
from pathloom.plans.staging import buckets, discard, stage

PAIR = ["start_place", "end_place"]
#: Verified paths of a pair of places that a request meets in one row.
LISTED = 1024
#: The columns of ``measured_edges`` that a price hangs on.
MEASURED = [
    "distance_m", "surface", "roughness", "slope", "safety", "lit", "stairs", "curb", "grade", "kind", "verified", "confidence", "closed",
    "source", "published", "at_night", "by_day",
]


def severities(hazards: DataFrame, night: Column) -> DataFrame:
    """The worst active hazard of each edge at this time."""
    counts = F.col("active") & C.hazard_applies(F.col("active_when"), night)
    return hazards.where(F.col("edge_id").isNotNull()).groupBy("edge_id").agg(
        F.coalesce(F.max(F.when(counts, F.col("severity"))), F.lit(0)).alias("severity")
    )


def profiles(requests: DataFrame) -> DataFrame:
    """The distinct cost profiles of requests: mode, night and whether shortcuts count."""
    shortcuts = (F.col("smarter") & (F.col("mode") == "walking")).alias("shortcuts")
    return requests.select("mode", "night", shortcuts).distinct().withColumn("profile", profile_name())


def profile_name(shortcuts: str | Column = "shortcuts") -> Column:
    return F.concat_ws("/", "mode", F.col("night").cast("string"), (F.col(shortcuts) if isinstance(shortcuts, str) else shortcuts).cast("string"))


def measured_edges(edges: DataFrame, hazards: DataFrame) -> DataFrame:
    """Every published edge with the severity of its worst active hazard at_night and by_day, null without any."""
    counts = lambda night: F.col("active") & C.hazard_applies(F.col("active_when"), F.lit(night))
    worst = hazards.where(F.col("edge_id").isNotNull()).groupBy("edge_id").agg(
        *[F.coalesce(F.max(F.when(counts(night), F.col("severity"))), F.lit(0)).alias(name) for night, name in ((True, "at_night"), (False, "by_day"))]
    )
    return edges.where("published").join(worst, edges.id == worst.edge_id, "left").drop("edge_id")


def priced(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` that their profile may use, with their cost; rows: of ``measured_edges`` with mode, night and shortcuts."""
    severity = F.coalesce(F.when(F.col("night"), F.col("at_night")).otherwise(F.col("by_day")), F.lit(0))
    rows = rows.where(~C.blocked(F.col("mode")) & ((F.col("kind") != "shortcut") | F.col("shortcuts")))
    return rows.withColumn("cost", C.edge_cost(F.col("mode"), F.col("night"), severity))


def priced_edges(edges: DataFrame, hazards: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every edge that a profile may use, with its cost; ``wanted``: mode, night, shortcuts, profile.

    The profiles are a handful of rows by nature (modes x day and night x shortcuts).
    """
    return priced(measured_edges(edges, hazards).crossJoin(F.broadcast(wanted)))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of two-way edges; the cost does not turn with the direction."""
    way = lambda src, dst, back: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(back).alias("reversed"))
    forth, back = way("from_node", "to_node", False), way("to_node", "from_node", True)
    # Out of each row, so that what stands before, as the price, is worked out once.
    return edges.select("*", F.inline(F.when(F.col("bidirectional"), F.array(forth, back)).otherwise(F.array(forth))))


def usable_doors(doors: DataFrame, step_free: Column) -> DataFrame:
    """Step-free doors where they are wanted and the place has any, else all doors of the place."""
    any_free = F.max("step_free").over(Window.partitionBy("search", "place_id"))
    marked = doors.withColumn("any_free", any_free)
    return marked.where(~step_free | F.col("step_free") | ~F.col("any_free")).drop("any_free")


def terminals(requests: DataFrame, doors: DataFrame, place: str) -> DataFrame:
    """The nodes at which a request may start or end."""
    found = requests.withColumnRenamed(place, "place_id").withColumnRenamed("request", "search").join(doors, "place_id")
    found = usable_doors(found, F.col("mode").isin("wheelchair", "scooter"))
    shortcuts = F.col("smarter") & (F.col("mode") == "walking")
    return found.withColumn("profile", profile_name(shortcuts)).select(
        "search", "profile", F.col("node_id").alias("node"), F.col("id").alias("door")
    )


def network(edges: DataFrame, hazards: DataFrame) -> DataFrame:
    """src, dst, edge and what ``priced`` reads, written once for all profiles: arcs are priced when a search meets them."""
    return stage(arcs(measured_edges(edges, hazards)).select("src", "dst", F.col("id").alias("edge"), *MEASURED), "network")


def routes(
    edges: DataFrame, hazards: DataFrame, doors: DataFrame, requests: DataFrame, avoid: DataFrame | None = None, ways: DataFrame | None = None
) -> DataFrame:
    """For each request with a way: search, cost, node (its end), profile, path (edges in order) and nodes.

    avoid: search, edge.  ways: the ``network``, if it is at hand.
    """
    mine = network(edges, hazards) if ways is None else None
    wanted = stage(profiles(requests), "profiles")
    starts = stage(terminals(requests, doors, "start_place").select("search", "profile", "node"), "starts")
    ends = stage(terminals(requests, doors, "end_place").select("search", "node").distinct(), "ends")
    avoid = None if avoid is None else stage(avoid.select("search", "edge"), "avoided")
    price = lambda rows: priced(rows.join(F.broadcast(wanted), "profile"))
    lean, served = corridor(mine if ways is None else ways, starts, ends, avoid, price)
    discard(*([mine] if ways is None else []))
    # From here on only the few arcs between a search's ends are read.
    ends = ends.join(served, "search", "left_semi")
    avoid = None if avoid is None else stage(avoid.join(lean.select("edge").distinct(), "edge", "left_semi").distinct(), "avoided")
    found = cheapest_paths(lean, starts, ends, avoid)
    reached = stage(cheapest_target(found, ends).drop("round"), "reached")
    # Beyond its cheapest end no node is on the way of a search.
    near = found.join(reached.select("search", F.col("cost").alias("bound")), "search").where("cost <= bound").drop("bound")
    back = came_by(near, lean, avoid)
    discard(lean, found)
    return paths_back(reached, back)


def avoided(chosen: DataFrame, hazards: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """search, edge: the edges of the hazards that a request chose (search, hazard) and, to find another way, those of its previous route (search, path)."""
    of = chosen.join(hazards.select(F.col("id").alias("hazard"), F.col("edge_id").alias("edge")), "hazard").where(F.col("edge").isNotNull())
    out = of.select("search", "edge")
    return (out if previous is None else out.unionByName(previous.select("search", F.explode("path").alias("edge")))).distinct()


def unreached(requests: DataFrame, found: DataFrame, doors: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests without a way, and the closure around their ends: its first name, "construction" if it has none, null if nothing is closed."""
    rest = requests.join(found.select(F.col("search").alias("request")), "request", "left_anti")
    touched = [terminals(rest, doors, c).select("search", "node") for c in ("start_place", "end_place")]
    shut = edges.where("closed")
    ends = [shut.select(F.col(c).alias("node"), F.coalesce(F.nullif("space", F.lit("")), F.lit(None)).alias("space")) for c in ("from_node", "to_node")]
    met = touched[0].unionByName(touched[1]).distinct().join(ends[0].unionByName(ends[1]), "node")
    names = met.groupBy("search").agg(F.coalesce(F.min("space"), F.lit("construction")).alias("closure"))
    return rest.select(F.col("request").alias("search")).join(names, "search", "left")


def verified_ways(pairs: DataFrame, doors: DataFrame, edges: DataFrame) -> DataFrame:
    """start_place, end_place, edge, backwards, each once: the open paths of the survey that join the two places of a pair, or doors of both.

    pairs: start_place, end_place, each once.  As many rows as there are paths for a pair, however many requests ask for it.
    """
    held = doors.groupBy("place_id").agg(F.collect_set("node_id").alias("nodes"))
    side = lambda c, n: held.select(F.col("place_id").alias(c), F.col("nodes").alias(n))
    asked = pairs.select(*PAIR).where("start_place <> end_place")
    asked = asked.join(side("start_place", "s"), "start_place").join(side("end_place", "t"), "end_place")
    path = edges.where("source = 'admin' AND published AND NOT closed").select(F.col("id").alias("edge"), "from_node", "to_node", "from_place", "to_place")
    keyed = path.withColumn("ends", F.array_sort(F.array("from_place", "to_place")))
    by_place = asked.withColumn("ends", F.array_sort(F.array("start_place", "end_place"))).join(keyed, "ends").drop("ends")
    near = asked.withColumn("near", F.explode(F.array_union("s", "t")))
    by_door = near.join(path.withColumn("near", F.col("from_node")), "near").drop("near")
    has = lambda a, n: F.array_contains(a, F.col(n))
    by_door = by_door.where((has("s", "from_node") & has("t", "to_node")) | (has("t", "from_node") & has("s", "to_node")))
    forth = ((F.col("from_place") == F.col("start_place")) & (F.col("to_place") == F.col("end_place"))) | (has("s", "from_node") & has("t", "to_node"))
    return by_place.unionByName(by_door).select(*PAIR, "edge", (~F.coalesce(forth, F.lit(False))).alias("backwards")).distinct()


def verified_routes(requests: DataFrame, doors: DataFrame, edges: DataFrame) -> DataFrame:
    """request, edge, backwards: an open path of the survey that joins the request's two places, or doors of both.

    The rows are by nature requests times paths of a pair of places.  A pair's paths are dealt over lists of about ``LISTED``, and
    requests meet lists, so no pair is one task's, and what is shuffled are requests and lists and never the rows.
    request: a key.
    """
    asked = requests.select("request", *PAIR).distinct()
    ways = stage(verified_ways(asked.select(*PAIR).distinct(), doors, edges), "verified")
    lists = ways.groupBy(*PAIR).agg(F.ceil(F.count(F.lit(1)) / LISTED).cast("int").alias("lists"))
    part = F.pmod(F.xxhash64("edge"), F.col("lists")).cast("int")
    held = ways.join(lists, PAIR).groupBy(*PAIR, part.alias("list")).agg(F.collect_list(F.struct("edge", "backwards")).alias("held"))
    met = asked.join(lists, PAIR).select("request", *PAIR, F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"))
    # Small rows that become many: their partitions are not to be brought together.
    keys = [*PAIR, "list"]
    return met.repartition(buckets(ways.sparkSession), *keys).join(held.hint("shuffle_hash"), keys).select("request", F.inline("held"))


def outcomes(requests: DataFrame, found: DataFrame, verified: DataFrame, unreachable: DataFrame, avoid: DataFrame | None = None) -> DataFrame:
    """One row for each request: a verified path goes before a search and its gates; without either, the closure is named.

    avoid: search, edge; a verified path that is avoided is not taken.
    """
    if avoid is not None:
        verified = verified.join(avoid.select(F.col("search").alias("request"), "edge"), ["request", "edge"], "left_anti")
    first = verified.groupBy("request").agg(F.min(F.struct("edge", "backwards"))["edge"].alias("verified"))
    rows = requests.select("request").join(first, "request", "left")
    rows = rows.join(found.select(F.col("search").alias("request"), "path"), "request", "left")
    rows = rows.join(unreachable.withColumnRenamed("search", "request"), "request", "left")
    return rows.select(
        "request",
        F.when(F.col("verified").isNotNull(), "verified").when(F.col("path").isNotNull(), "route").otherwise("unreachable").alias("outcome"),
        F.when(F.col("verified").isNotNull(), F.array("verified")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("verified").isNull(), F.col("closure")).alias("closure"),
    )


def route_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each edge on a route: search, pos, total, the nodes in travel order (a, b) and the edge's columns."""
    rows = found.select("search", F.col("cost").alias("total"), "profile", "nodes", F.posexplode("path").alias("pos", "edge"))
    rows = rows.withColumns({"a": F.get("nodes", F.col("pos")), "b": F.get("nodes", F.col("pos") + 1)}).drop("nodes")
    return rows.join(edges, rows.edge == edges.id)


def summary(rows: DataFrame) -> DataFrame:
    """Length-weighted statistics of each route; unmeasured attributes are disclosed, not scored."""
    d = F.col("distance_m")
    total = lambda x: F.sum(F.when(x, d).otherwise(0.0))
    unknown = F.greatest(*[F.col(c).isNull().cast("int") for c in ("slope", "safety", "surface", "roughness", "lit")]) == 1
    measured = F.col("safety").isNotNull()
    grade = (
        F.when(F.col("grade") == "FullyCompliant", 100.0)
        .when(F.col("grade") == "PartiallyCompliant", 70.0)
        .when(F.col("grade") == "NonCompliant", 40.0)
        .otherwise(55.0)
    )
    sums = rows.groupBy("search").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(d).alias("distance_m"),
        total(F.col("verified")).alias("verified_m"),
        F.count_if(F.col("verified")).alias("verified_segments"),
        total(F.col("lit").eqNullSafe(False)).alias("unlit_m"),
        total(F.coalesce(F.col("roughness") >= 0.4, F.lit(False))).alias("rough_m"),
        F.count_if(F.col("stairs")).alias("stairs_count"),
        F.sum(F.when(F.col("stairs"), F.col("riser_count")).otherwise(0)).alias("riser_count"),
        total(F.col("kind") == "shortcut").alias("shortcut_m"),
        F.array_sort(F.collect_set(F.when((F.col("kind") == "shortcut"), F.col("space")))).alias("shortcut_spaces"),
        total(unknown).alias("unknown_m"),
        total(F.coalesce(F.col("grade") == "FullyCompliant", F.lit(False))).alias("compliant_m"),
        (F.try_divide(F.sum(F.when(measured, F.col("safety") * d)), F.sum(F.when(measured, d))) * 100).alias("safety_score"),
        F.sum(F.when(F.col("grade").isNotNull(), d)).alias("graded_m"),
        F.sum(grade * d).alias("graded_points"),
        F.max(F.abs("slope")).alias("max_abs_slope"),
        F.max("total").alias("cost"),
    )
    at_least_one = F.greatest(F.col("distance_m"), F.lit(1.0))
    ungraded = F.greatest(F.lit(0.0), F.lit(100.0) - 35 * F.col("stairs_count") - F.col("rough_m") / at_least_one * 30)
    return sums.withColumns(
        {
            "accessibility_score": F.when(F.col("graded_m").isNotNull(), F.col("graded_points") / at_least_one).otherwise(ungraded),
            "verified_percent": F.when(F.col("distance_m") > 0, F.col("verified_m") / F.col("distance_m") * 100).otherwise(100.0),
            "compliant_percent": F.try_divide("compliant_m", "distance_m") * 100,
            "graded": F.col("graded_m").isNotNull(),
        }
    ).drop("graded_m", "graded_points")


def explanation() -> Column:
    """What a summary tells the traveller, in order.

    Beside the summary's columns: mode, night, snap_from and snap_to (metres from the doors to the
    network), avoided (number of edges) and hazards (whether any applies).
    """
    percent = lambda part: F.round(F.col(part) / F.greatest(F.col("distance_m"), F.lit(1.0)) * 100, 0).cast("int").cast("string")
    gap = lambda c, end: F.when(
        F.col(c) > 40, F.concat(F.lit("Paths end "), F.round(c, 0).cast("int").cast("string"), F.lit(f" m from the {end}"))
    )
    return F.array_compact(
        F.array(
            F.concat(F.lit("Costs for "), "mode", F.lit(" by "), F.when(F.col("night"), "night").otherwise("day")),
            F.when(F.col("mode") == "wheelchair", "Stairs and raised curbs are excluded"),
            F.when(F.col("shortcut_m") > 0, F.concat(F.lit("Crosses open lawn: "), F.array_join("shortcut_spaces", ", "))),
            gap("snap_from", "start"),
            gap("snap_to", "end"),
            F.when(F.col("graded"), F.concat(F.lit("Surveyed as fully compliant: "), percent("compliant_m"), F.lit("%"))),
            F.when(F.col("unknown_m") > 0, F.concat(percent("unknown_m"), F.lit("% lacks a reading"))),
            F.when(F.col("avoided") > 0, F.concat(F.lit("Edges left out on request: "), F.col("avoided").cast("string"))),
            F.when(F.col("hazards"), "Hazards on the way raise its cost"),
            F.when(F.col("verified_m") < F.col("distance_m"), "Unverified segments are disclosed"),
            F.when(F.col("night"), "Lighting weighs more at night"),
        )
    )


def cautions(night: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("stairs"), "stairs"),
            F.when(F.col("curb"), "unlowered curb"),
            F.when(F.col("roughness") >= 0.4, "rough surface"),
            F.when(night & F.col("lit").eqNullSafe(False), "unlit at night"),
            F.when(F.col("grade") == "NonCompliant", "may have travel hazards"),
            F.when(F.col("kind") == "shortcut", "crosses open lawn"),
        )
    )


def direction(dx: Column, dy: Column) -> Column:
    """The larger component wins; a tie goes to north or south, no move to south."""
    return F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "east").otherwise("west")).otherwise(F.when(dy > 0, "north").otherwise("south"))


# Names that read as common nouns.
COMMON_NOUNS = (
    "Hallway", "Sidewalk", "Crosswalk", "Curb", "Ramp", "Stairs", "Curb Ramp", "Escalator", "Elevator", "Wheelchair Lift",
    "Temporary Pathway",
)


def instruction(kind: Column, name: Column, heading: Column, risers: Column) -> Column:
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    noun = F.when(name.isin(*COMMON_NOUNS), F.lower(name)).otherwise(name)
    return (
        F.when(kind == "shortcut", text("Cut ", heading, " across ", F.coalesce(name, F.lit("the lawn"))))
        .when(kind == "stairs", text("Take the steps ", heading, F.when(risers > 0, text(" (", risers.cast("string"), " steps)")).otherwise("")))
        .when(kind == "ramp", text("Follow the ramp ", heading))
        .when(kind == "indoor", F.when(name.isNotNull(), text("Go ", heading, " through ", name)).otherwise(text("Continue ", heading, " indoors")))
        .when(name.isNotNull(), text("Head ", heading, " along the ", noun))
        .otherwise(text("Head ", heading))
    )


def _islands(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Numbers the runs of adjacent segments of the same kind and name: ``step``."""
    along = Window.partitionBy(by).orderBy(order)
    changed = ~(F.col("kind").eqNullSafe(F.lag("kind").over(along)) & F.col("name").eqNullSafe(F.lag("name").over(along)))
    first = F.row_number().over(along) == 1
    island = F.sum((changed | first).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("step", island)


def steps(rows: DataFrame, *, by: str = "search", order: str = "pos") -> DataFrame:
    """Runs of adjacent segments of the same kind and name become one step."""
    return (
        _islands(rows, by, order)
        .groupBy(by, "step")
        .agg(
            F.sum("distance_m").alias("distance_m"),
            F.min_by("id", order).alias("edge_id"),
            F.min_by("surface", order).alias("surface"),
            F.min_by("kind", order).alias("kind"),
            F.min_by("name", order).alias("name"),
            F.sum(F.when(F.col("stairs"), F.col("riser_count")).otherwise(0)).alias("risers"),
            F.count(F.lit(1)).alias("segments"),
        )
    )


def guided(rows: DataFrame, nodes: DataFrame, *, by: str = "search", order: str = "pos", surveyed: str | None = None) -> DataFrame:
    """Steps with their first and last node, an instruction and the cautions of their edges, each once, in order.

    rows: as of ``route_edges``, with ``night``; surveyed: their column that marks the edges of verified paths.
    """
    told = rows.withColumn("told", cautions(F.col("night")))
    each = _islands(told, by, order)
    more = each.groupBy(by, "step").agg(
        F.min_by("a", order).alias("from_node"),
        F.max_by("b", order).alias("to_node"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "told"))).alias("all"),
        F.bool_or(F.col(surveyed) if surveyed else F.lit(False)).alias("on_survey"),
    )
    more = more.withColumn("cautions", F.array_distinct(F.flatten(F.transform("all", lambda x: x["told"])))).drop("all")
    spot = lambda c, p: nodes.select(F.col("id").alias(c), F.col("latitude").alias(f"{p}lat"), F.col("longitude").alias(f"{p}lng"))
    found = steps(rows, by=by, order=order).join(more, [by, "step"]).join(spot("from_node", "a_"), "from_node").join(spot("to_node", "b_"), "to_node")
    heading = direction(F.col("b_lng") - F.col("a_lng"), F.col("b_lat") - F.col("a_lat"))
    told = instruction(F.col("kind"), F.col("name"), heading, F.col("risers"))
    follow = F.concat(F.lit("Follow the surveyed path "), heading, F.lit(" along "), F.coalesce("name", F.lit("the path")))
    told = F.when(F.col("on_survey"), follow).otherwise(told)
    return found.withColumn("instruction", told).drop("a_lat", "a_lng", "b_lat", "b_lng", "on_survey")
