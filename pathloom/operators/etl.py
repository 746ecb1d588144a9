"""From geodata to a graph: edges from lines, closures, shortcuts, doors for places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.functions.text import node_key, tokens
from pathloom.operators.nearest import cell, nearest

# Confidence of an edge by its kind.
CONFIDENCE = {"paved": 0.55, "stairs": 0.55, "ramp": 0.6, "indoor": 0.5, "shortcut": 0.3}


def edge_kind(shortcut: Column, stairs: Column, ramp: Column, indoor: Column) -> Column:
    """The first that holds, in this order."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return F.when(flag(shortcut), "shortcut").when(flag(stairs), "stairs").when(flag(ramp), "ramp").when(flag(indoor), "indoor").otherwise("paved")


def confidence(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p])[kind]


def segments(lines: DataFrame, *, id: str = "id", line: str = "line", direction: str = "direction") -> DataFrame:
    """Edges between adjacent snapped vertices of lines (arrays of (x, y)); direction 3 runs backwards.

    Vertices that snap to the same key make no edge.
    """
    points = lines.select(id, F.col(direction).alias("direction"), F.posexplode(line).alias("i", "p"))
    along = Window.partitionBy(id).orderBy("i")
    pairs = points.withColumn("q", F.lead("p").over(along)).where(F.col("q").isNotNull())
    a, b = node_key(F.col("p.x"), F.col("p.y")), node_key(F.col("q.x"), F.col("q.y"))
    back = F.col("direction").eqNullSafe(3)
    rows = pairs.withColumns({"_a": a, "_b": b}).where("_a <> _b")
    return rows.select(
        F.concat(F.lit("e-"), F.col(id).cast("string"), F.lit("-"), F.col("i").cast("string")).alias("edge"),
        F.when(back, F.col("_b")).otherwise(F.col("_a")).alias("from_node"),
        F.when(back, F.col("_a")).otherwise(F.col("_b")).alias("to_node"),
        geo.plane_campus(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")).alias("distance_m"),
    )


def _in_box(points: DataFrame, zones: DataFrame, degrees: float, metres: float = 0.0) -> DataFrame:
    """Points with the zones whose bounding box, widened, holds them, by a grid equi-join."""
    px, py = metres / (geo.PLANE_X * geo.COS_PLANE), metres / geo.PLANE_Y
    end = lambda f, c, by: f(F.transform("ring", lambda p: p[c])) + by
    boxes = zones.withColumns(
        {
            "x0": end(F.array_min, "x", -px), "x1": end(F.array_max, "x", px),
            "y0": end(F.array_min, "y", -py), "y1": end(F.array_max, "y", py),
        }
    )
    # A large zone uses larger cells, so that each covers a few; points meet every size in use.
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(degrees))
    boxes = boxes.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(span / (4 * degrees))).cast("int")))
    sizes = [r.level for r in boxes.select("level").distinct().collect()]
    if not sizes:
        sizes = [0]
    side = F.lit(degrees) * F.pow(F.lit(2.0), F.col("level"))
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    boxes = boxes.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    here = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in sizes]))).withColumns({"cx": at("x"), "cy": at("y")})
    met = here.join(boxes, ["level", "cx", "cy"]).drop("level", "cx", "cy")
    return met.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).drop("x0", "x1", "y0", "y1")


def containing(points: DataFrame, zones: DataFrame, *, degrees: float = 0.002) -> DataFrame:
    """Pairs of a point (id, x, y) and a zone (zone, ring) that holds it."""
    met = _in_box(points, zones, degrees)
    return met.where(geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).drop("ring")


def near_zone(points: DataFrame, zones: DataFrame, metres: float, *, degrees: float = 0.002) -> DataFrame:
    """Pairs of a point and a zone that holds it or has a side closer than ``metres``."""
    met = _in_box(points, zones, degrees, metres)
    closed = F.concat("ring", F.slice("ring", F.lit(1), F.lit(1)))
    close = geo.nearest_on_line(F.col("x"), F.col("y"), closed)["d"] < metres
    return met.where(geo.in_ring(F.col("x"), F.col("y"), F.col("ring")) | close).drop("ring")


def closures(edges: DataFrame, nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """Edges whose both ends lie in one closed zone, with the first such zone."""
    held = containing(nodes, zones)
    a = held.select(F.col("id").alias("from_node"), F.col("zone"))
    b = held.select(F.col("id").alias("to_node"), F.col("zone").alias("zone_b"))
    both = edges.join(a, "from_node").join(b, "to_node").where("zone = zone_b")
    return both.groupBy("edge").agg(F.min("zone").alias("zone"))


def shortcuts(nodes: DataFrame, lawns: DataFrame, obstacles: DataFrame, *, low: float = 15.0, high: float = 250.0, share: float = 0.85) -> DataFrame:
    """Node pairs across a lawn: long enough, clear of obstacles and mostly on the lawn at points 2 m apart or a little more.

    Each pair counts for its first lawn.  Pairs come from a grid, and a pair's length is
    checked before it is sampled.
    """
    border = near_zone(nodes, lawns, 15.0).select("zone", "id", "x", "y")
    # Only nodes of the same and the eight cells around can be near enough.
    degrees = high / (geo.PLANE_X * geo.COS_PLANE)
    ring = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    other = border.select("zone", F.col("id").alias("to_node"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(ring).alias("i"))
    other = other.select("*", F.explode(ring).alias("j"))
    other = other.withColumns({"cx": cell(F.col("x2"), degrees) + F.col("i"), "cy": cell(F.col("y2"), degrees) + F.col("j")}).drop("i", "j")
    here = border.withColumnsRenamed({"id": "from_node"}).withColumns({"cx": cell(F.col("x"), degrees), "cy": cell(F.col("y"), degrees)})
    length = geo.plane_campus(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    pairs = here.join(other, ["zone", "cx", "cy"]).where("from_node < to_node").drop("cx", "cy")
    pairs = pairs.withColumn("distance_m", length).where(F.col("distance_m").between(low, high))
    count = F.greatest(F.lit(2), F.floor(F.col("distance_m") / 2).cast("int"))
    samples = pairs.withColumn("n", count).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    part = F.col("k") / F.col("n")
    samples = samples.select(
        "zone", "from_node", "to_node", "distance_m",
        F.struct("zone", "from_node", "to_node", "k").alias("id"),
        (F.col("x") + part * (F.col("x2") - F.col("x"))).alias("x"),
        (F.col("y") + part * (F.col("y2") - F.col("y"))).alias("y"),
    )
    spots = samples.select("id", "x", "y")
    hit = containing(spots, obstacles).select("id.zone", "id.from_node", "id.to_node").distinct()
    on = containing(spots, lawns.select("zone", "ring")).where(F.col("zone") == F.col("id.zone")).select("id").distinct().withColumn("on", F.lit(1))
    keys = ["zone", "from_node", "to_node"]
    scored = samples.join(on, "id", "left").groupBy(*keys).agg(F.avg(F.coalesce("on", F.lit(0))).alias("share"), F.first("distance_m").alias("distance_m"))
    clear = scored.where(F.col("share") >= share).join(hit, keys, "left_anti")
    return clear.groupBy("from_node", "to_node").agg(F.min("zone").alias("zone"), F.min("distance_m").alias("distance_m"))


def door_buildings(doors: DataFrame, buildings: DataFrame, *, metres: float = 12.0, second: float = 50.0) -> DataFrame:
    """The building of each door (id, x, y, name) among buildings (zone, ring, title).

    Among buildings within ``metres``: the door's name begins with the title, contains it,
    shares all its words, or else the nearest wall.  Doors without one look again up to
    ``second`` metres for a building all of whose words they name.
    """
    def ranked(reach: float, rest: DataFrame, words_only: bool) -> DataFrame:
        met = _in_box(rest, buildings, 0.002, reach)
        closed = F.concat("ring", F.slice("ring", F.lit(1), F.lit(1)))
        inside = geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))
        met = met.withColumn("d", F.when(inside, 0.0).otherwise(geo.nearest_on_line(F.col("x"), F.col("y"), closed)["d"]))
        met = met.where(F.col("d") <= reach)
        name, title = F.lower("name"), F.lower("title")
        words = (F.size(tokens(F.col("title"))) > 0) & (F.size(F.array_except(tokens(F.col("title")), tokens(F.col("name")))) == 0)
        tier = F.when(name.startswith(title), 1).when(F.contains(name, title), 2).when(words, 3)
        met = met.withColumn("tier", tier if words_only else F.coalesce(tier, F.lit(4))).where(F.col("tier").isNotNull())
        return met.groupBy("id").agg(F.min(F.struct("tier", "d", "zone")).alias("b")).select("id", "b.zone", "b.tier", "b.d")

    first = ranked(metres, doors, False)
    return first.unionByName(ranked(second, doors.join(first.select("id"), "id", "left_anti"), True))


def place_points(buildings: DataFrame, owned: DataFrame) -> DataFrame:
    """Doors of each building, or its centroid where it has none."""
    without = buildings.join(owned.select("zone").distinct(), "zone", "left_anti")
    middle = without.select("zone", geo.centroid(F.col("ring")).alias("c")).select(
        "zone", F.lit(None).cast("string").alias("id"), F.lit("centre").alias("kind"), F.col("c.x").alias("x"), F.col("c.y").alias("y")
    )
    return owned.select("zone", F.col("id").cast("string").alias("id"), F.lit("entrance").alias("kind"), "x", "y").unionByName(middle)


def observed(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges with measured columns put over theirs; seen: edge and any of the columns, null where not measured."""
    columns = [c for c in seen.columns if c != "edge" and c in edges.columns]
    marked = seen.select("edge", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_seen"))
    joined = edges.join(marked, edges.id == marked.edge, "left")
    hit = F.coalesce(F.col("_seen"), F.lit(False))
    joined = joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    joined = joined.withColumns({"verified": F.col("verified") | hit, "confidence": F.when(hit, 0.96).otherwise(F.col("confidence"))})
    return joined.select(*edges.columns)


def snapped_doors(doors: DataFrame, nodes: DataFrame, most: float = 400.0) -> DataFrame:
    """place_id, door, node and metres: doors (id, place_id, latitude, longitude) at their nearest node, at most ``most`` metres away."""
    targets = nodes.select(F.col("id").alias("target"), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lng"))
    found = nearest(doors.select("id", "latitude", "longitude"), targets, most)
    return doors.select("id", "place_id").join(found, "id").select("place_id", F.col("id").alias("door"), F.col("target").alias("node"), "metres")
