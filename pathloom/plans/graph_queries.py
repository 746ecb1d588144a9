"""Queries over several tables: joins, routes, text search, edits, geodata, live positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import cost as C
from pathloom.functions import geo
from pathloom.functions.text import OFFLINE_STOPWORDS
from pathloom.operators import etl, lifecycle, places, routing
from pathloom.operators.components import connected_components
from pathloom.operators.nearest import nearest, within
from pathloom.operators.shortest_paths import cheapest_paths
from pathloom.plans.registry import query
from pathloom.plans.scalar_queries import (
    APPLIES_SQL, BLOCKED_SQL, CAUTIONS_SQL, COST_SQL, DIRECTION_SQL, ENDS_SQL, HAVERSINE_SQL, INSTRUCTION_SQL, close, ends,
)
from pathloom.plans.staging import stage
from pathloom.plans.views import Graph
from pathloom.streaming import live

PLANE_SQL = "sqrt(pow(({1} - {3}) * 111320.0::DOUBLE * 0.7735::DOUBLE, 2) + pow(({0} - {2}) * 110540.0::DOUBLE, 2))".format
SEVERITY_SQL = f"""SELECT edge_id, max(CASE WHEN active AND {APPLIES_SQL} THEN severity END) AS severity
FROM g_hazards, (SELECT {{}} AS night) t WHERE edge_id IS NOT NULL GROUP BY edge_id"""


def priced_sql(mode: str, night: bool) -> str:
    """Arcs of one profile, in both directions."""
    severity = SEVERITY_SQL.format(str(night).upper())
    return f"""p AS (SELECT e.*, '{mode}' AS mode, {str(night).upper()} AS night, coalesce(h.severity, 0) AS severity
  FROM g_edges e LEFT JOIN ({severity}) h ON h.edge_id = e.id WHERE e.kind <> 'shortcut' OR '{mode}' = 'walking'),
c AS (SELECT id, from_node, to_node, bidirectional, {COST_SQL} AS cost FROM p WHERE NOT {BLOCKED_SQL}),
arcs AS (SELECT from_node AS src, to_node AS dst, id AS edge, cost FROM c UNION ALL
         SELECT to_node, from_node, id, cost FROM c WHERE bidirectional)"""


def priced(g: Graph, mode: str, night: bool) -> DataFrame:
    rows = g.spark.createDataFrame([(mode, night, True)], "mode string, night boolean, smarter boolean")
    return routing.arcs(routing.priced_edges(g.edges, g.hazards, routing.profiles(rows)))


def sssp_sql(mode: str, night: bool) -> str:
    return f"""WITH RECURSIVE {priced_sql(mode, night)},
d(node, cost) USING KEY (node) AS (
  SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost
  UNION SELECT a.dst, min(d.cost + a.cost) FROM d JOIN arcs a ON a.src = d.node
  LEFT JOIN recurring.d AS r ON r.node = a.dst WHERE d.cost + a.cost < coalesce(r.cost, CAST('infinity' AS DOUBLE)) GROUP BY a.dst)
SELECT node, cost FROM d"""


def sssp(g: Graph, mode: str, night: bool) -> DataFrame:
    ways = priced(g, mode, night).select("profile", "src", "dst", F.col("id").alias("edge"), "cost")
    start = ways.limit(1).select(F.lit(0).cast("long").alias("search"), "profile", F.lit(0).cast("long").alias("node"))
    return cheapest_paths(ways, start).select("node", "cost")


@query(sssp_sql("wheelchair", False))
def route_sssp_wheelchair(g: Graph) -> DataFrame:
    return sssp(g, "wheelchair", False)


@query(sssp_sql("walking", True))
def route_sssp_walking_night(g: Graph) -> DataFrame:
    return sssp(g, "walking", True)


@query(f"WITH {priced_sql('bicycle', False)} SELECT src, dst, edge, cost FROM arcs")
def priced_arcs(g: Graph) -> DataFrame:
    return priced(g, "bicycle", False).select("src", "dst", F.col("id").alias("edge"), "cost")


# All requests at once: a row for each request and node, with the path so far.
ALL_SEVERITIES = f"""SELECT edge_id, night, max(CASE WHEN active AND {APPLIES_SQL} THEN severity END) AS severity
FROM g_hazards, (VALUES (TRUE), (FALSE)) t(night) WHERE edge_id IS NOT NULL GROUP BY edge_id, night"""
ROUTES_SQL = f"""WITH RECURSIVE pr AS (SELECT DISTINCT mode, night, smarter AND mode = 'walking' AS shortcuts FROM g_requests),
p AS (SELECT e.*, pr.mode, pr.night, pr.shortcuts, coalesce(h.severity, 0) AS severity FROM g_edges e CROSS JOIN pr
  LEFT JOIN ({ALL_SEVERITIES}) h ON h.edge_id = e.id AND h.night = pr.night WHERE e.kind <> 'shortcut' OR pr.shortcuts),
c AS (SELECT id, from_node, to_node, bidirectional, mode, night, shortcuts, {COST_SQL} AS cost FROM p WHERE NOT {BLOCKED_SQL}),
arcs AS (SELECT mode, night, shortcuts, from_node AS src, to_node AS dst, id AS edge, cost FROM c UNION ALL
  SELECT mode, night, shortcuts, to_node, from_node, id, cost FROM c WHERE bidirectional),
doors AS (SELECT d.*, bool_or(step_free) OVER (PARTITION BY place_id) AS any_free FROM g_doors d),
s AS (SELECT DISTINCT request, mode, night, smarter AND mode = 'walking' AS shortcuts, node_id AS node FROM g_requests JOIN doors ON place_id = start_place
  WHERE mode NOT IN ('wheelchair', 'scooter') OR step_free OR NOT any_free),
t AS (SELECT DISTINCT request, node_id AS node FROM g_requests JOIN doors ON place_id = end_place
  WHERE mode NOT IN ('wheelchair', 'scooter') OR step_free OR NOT any_free),
d(request, node, mode, night, shortcuts, cost, path, nodes) USING KEY (request, node) AS (
  SELECT request, node, mode, night, shortcuts, CAST(0 AS DOUBLE), CAST([] AS BIGINT[]), [node] FROM s
  UNION SELECT d.request, a.dst, d.mode, d.night, d.shortcuts, min(d.cost + a.cost), arg_min(list_append(d.path, a.edge), d.cost + a.cost), arg_min(list_append(d.nodes, a.dst), d.cost + a.cost)
  FROM d JOIN arcs a ON a.src = d.node AND a.mode = d.mode AND a.night = d.night AND a.shortcuts = d.shortcuts
  LEFT JOIN recurring.d AS r ON r.request = d.request AND r.node = a.dst
  WHERE d.cost + a.cost < coalesce(r.cost, CAST('infinity' AS DOUBLE)) GROUP BY d.request, a.dst, d.mode, d.night, d.shortcuts),
best AS (SELECT request, arg_min(node, cost) AS node, min(cost) AS cost, arg_min(path, cost) AS path, arg_min(nodes, cost) AS nodes FROM d JOIN t USING (request, node) GROUP BY request)"""


def found_routes(g: Graph) -> DataFrame:
    return routing.routes(g.edges, g.hazards, g.doors, g.requests)


@query(ROUTES_SQL + " SELECT CAST(request AS INT) AS request, node, cost, array_to_string(path, '-') AS path FROM best")
def routes(g: Graph) -> DataFrame:
    return found_routes(g).select(F.col("search").cast("int").alias("request"), "node", "cost", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query(ROUTES_SQL + """, r AS (SELECT b.request, b.cost AS total, e.* FROM (SELECT request, cost, unnest(path) AS edge FROM best) b JOIN g_edges e ON e.id = b.edge)
SELECT CAST(request AS INT) AS request, round(max(total), 6) AS cost, count(*) AS segments, round(sum(distance_m), 6) AS distance_m,
round(sum(CASE WHEN verified THEN distance_m ELSE 0 END), 6) AS verified_m, count(*) FILTER (WHERE verified) AS verified_segments,
round(sum(CASE WHEN lit IS NOT DISTINCT FROM FALSE THEN distance_m ELSE 0 END), 6) AS unlit_m, round(sum(CASE WHEN roughness >= 0.4 THEN distance_m ELSE 0 END), 6) AS rough_m,
count(*) FILTER (WHERE stairs) AS stairs_count, CAST(sum(CASE WHEN stairs THEN riser_count ELSE 0 END) AS BIGINT) AS riser_count,
round(sum(CASE WHEN kind = 'shortcut' THEN distance_m ELSE 0 END), 6) AS shortcut_m,
coalesce(array_to_string(list_sort(list(DISTINCT space) FILTER (WHERE kind = 'shortcut' AND space IS NOT NULL)), '/'), '') AS shortcut_spaces,
round(sum(CASE WHEN slope IS NULL OR safety IS NULL OR surface IS NULL OR roughness IS NULL OR lit IS NULL THEN distance_m ELSE 0 END), 6) AS unknown_m,
round(sum(safety * distance_m) / sum(distance_m) FILTER (WHERE safety IS NOT NULL) * 100, 6) AS safety_score, max(abs(slope)) AS max_abs_slope,
round(CASE WHEN count(grade) > 0 THEN sum(distance_m * CASE grade WHEN 'FullyCompliant' THEN 100 WHEN 'PartiallyCompliant' THEN 70 WHEN 'NonCompliant' THEN 40 ELSE 55 END) / greatest(sum(distance_m), 1)
  ELSE greatest(0, 100 - 35 * count(*) FILTER (WHERE stairs) - sum(CASE WHEN roughness >= 0.4 THEN distance_m ELSE 0 END) / greatest(sum(distance_m), 1) * 30) END, 6) AS accessibility_score,
round(sum(CASE WHEN verified THEN distance_m ELSE 0 END) / sum(distance_m) * 100, 6) AS verified_percent,
round(sum(CASE WHEN grade = 'FullyCompliant' THEN distance_m ELSE 0 END) / sum(distance_m) * 100, 6) AS compliant_percent FROM r GROUP BY request""")
def route_summaries(g: Graph) -> DataFrame:
    s = routing.summary(routing.route_edges(found_routes(g), g.edges))
    rounded = ("cost", "distance_m", "verified_m", "unlit_m", "rough_m", "shortcut_m", "unknown_m", "safety_score", "accessibility_score", "verified_percent", "compliant_percent")
    return s.select(
        F.col("search").cast("int").alias("request"), "segments", "verified_segments", "stairs_count",
        F.col("riser_count").cast("long"), F.array_join("shortcut_spaces", "/").alias("shortcut_spaces"), "max_abs_slope",
        *[close(c).alias(c) for c in rounded],
    )


@query(ROUTES_SQL + f""", r AS (SELECT b.request, b.night, b.pos, b.a, b.b, e.* FROM (SELECT best.request, q.night, unnest(path) AS edge, generate_subscripts(path, 1) AS pos, nodes[pos] AS a, nodes[pos + 1] AS b
  FROM best JOIN g_requests q ON q.request = best.request) b JOIN g_edges e ON e.id = b.edge),
f AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND name IS NOT DISTINCT FROM lag(name) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY request ORDER BY pos)),
st AS (SELECT *, sum(fresh) OVER (PARTITION BY request ORDER BY pos) AS step FROM f),
cc AS (SELECT request, step, c, min(pos * 10 + k) AS o FROM (SELECT request, step, pos, unnest([1, 2, 3, 4, 5, 6]) AS k, unnest({CAUTIONS_SQL}) AS c FROM st) WHERE c IS NOT NULL GROUP BY request, step, c),
cs AS (SELECT request, step, string_agg(c, '; ' ORDER BY o) AS cautions FROM cc GROUP BY request, step),
g AS (SELECT request, step, arg_min(id, pos) AS edge_id, first(kind) AS kind, first(name) AS name, round(sum(distance_m), 6) AS distance_m,
  CAST(sum(CASE WHEN stairs THEN riser_count ELSE 0 END) AS BIGINT) AS risers, count(*) AS segments, arg_min(a, pos) AS from_node, arg_max(b, pos) AS to_node FROM st GROUP BY request, step),
h AS (SELECT g.*, {DIRECTION_SQL.replace("lng1", "m.longitude").replace("lng2", "n.longitude").replace("lat1", "m.latitude").replace("lat2", "n.latitude")} AS heading
  FROM g JOIN g_nodes m ON m.id = g.from_node JOIN g_nodes n ON n.id = g.to_node)
SELECT CAST(h.request AS INT) AS request, CAST(h.step AS BIGINT) AS step, edge_id, kind, name, distance_m, risers, segments, from_node, to_node,
  coalesce(cautions, '') AS cautions, {INSTRUCTION_SQL.replace("riser_count", "risers")} AS instruction FROM h LEFT JOIN cs ON cs.request = h.request AND cs.step = h.step""")
def route_steps(g: Graph) -> DataFrame:
    asked = g.requests.select(F.col("request").alias("search"), "night")
    s = routing.guided(routing.route_edges(found_routes(g), g.edges).join(asked, "search"), g.nodes)
    return s.select(
        F.col("search").cast("int").alias("request"), F.col("step").cast("long"), "edge_id", "kind", "name", close("distance_m").alias("distance_m"),
        F.col("risers").cast("long"), "segments", "from_node", "to_node", F.array_join("cautions", "; ").alias("cautions"), "instruction",
    )


VERIFIED_SQL = """h AS (SELECT place_id, list(DISTINCT node_id) AS nodes FROM g_doors GROUP BY place_id),
v AS (SELECT id, from_node, to_node, from_place, to_place FROM g_edges WHERE source = 'admin' AND published AND NOT closed),
ask AS (SELECT request, start_place, end_place, x.nodes AS s, y.nodes AS t FROM {} JOIN h x ON x.place_id = start_place JOIN h y ON y.place_id = end_place WHERE start_place <> end_place),
ver AS (SELECT DISTINCT request, v.id AS edge, CASE WHEN from_place = start_place AND to_place = end_place OR (list_contains(s, from_node) AND list_contains(t, to_node)) THEN FALSE ELSE TRUE END AS backwards
FROM ask JOIN v ON (from_place = start_place AND to_place = end_place) OR (from_place = end_place AND to_place = start_place)
 OR (list_contains(s, from_node) AND list_contains(t, to_node)) OR (list_contains(t, from_node) AND list_contains(s, to_node)))"""


@query(ROUTES_SQL + ", " + VERIFIED_SQL.format("g_requests") + """,
shut AS (SELECT from_node AS node, space FROM g_edges WHERE closed UNION ALL SELECT to_node, space FROM g_edges WHERE closed),
un AS (SELECT request, coalesce(min(nullif(space, '')), 'construction') AS closure FROM (SELECT request, node FROM s UNION SELECT request, node FROM t) JOIN shut USING (node) GROUP BY request),
first AS (SELECT request, min(edge) AS edge FROM ver GROUP BY request)
SELECT CAST(q.request AS INT) AS request, CASE WHEN first.edge IS NOT NULL THEN 'verified' WHEN best.path IS NOT NULL THEN 'route' ELSE 'unreachable' END AS outcome,
array_to_string(CASE WHEN first.edge IS NOT NULL THEN [first.edge] ELSE best.path END, '-') AS path,
CASE WHEN first.edge IS NULL AND best.path IS NULL THEN un.closure END AS closure
FROM g_requests q LEFT JOIN best ON best.request = q.request LEFT JOIN first ON first.request = q.request LEFT JOIN un ON un.request = q.request""")
def route_outcomes(g: Graph) -> DataFrame:
    """Every request: its verified path, its route, or what closes it off."""
    found = stage(found_routes(g), "found")
    rows = routing.outcomes(g.requests, found, routing.verified_routes(g.requests, g.doors, g.edges), routing.unreached(g.requests, found, g.doors, g.edges))
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "-")
    return rows.select(F.col("request").cast("int"), "outcome", path.alias("path"), "closure")


AVOID_SQL = ROUTES_SQL.replace("WHERE e.kind <> 'shortcut' OR pr.shortcuts)", """WHERE (e.kind <> 'shortcut' OR pr.shortcuts)
  AND e.id NOT IN (SELECT edge_id FROM g_hazards WHERE severity = 3 AND active AND edge_id IS NOT NULL))""").replace(
    "ON a.src = d.node AND", "ON a.src = d.node AND a.edge % 10 <> d.request % 10 AND")


@query(AVOID_SQL + " SELECT CAST(request AS INT) AS request, node, cost, array_to_string(path, '-') AS path FROM best")
def routes_avoiding(g: Graph) -> DataFrame:
    """Routes without a tenth of the edges, another one for each request, and without those of the worst hazards."""
    asked = g.requests.select(F.col("request").alias("search"))
    chosen = asked.crossJoin(g.hazards.where("severity = 3 AND active").select(F.col("id").alias("hazard")))
    tenth = g.edges.select(F.col("id").alias("edge"), (F.col("id") % 10).alias("k")).join(asked.withColumn("k", (F.col("search") % 10).cast("long")), "k")
    avoid = routing.avoided(chosen, g.hazards).unionByName(tenth.select("search", "edge")).distinct()
    found = routing.routes(g.edges, g.hazards, g.doors, g.requests, avoid)
    return found.select(F.col("search").cast("int").alias("request"), "node", "cost", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


def undirected(g: Graph) -> DataFrame:
    return g.edges.where("NOT closed AND published").select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))


@query("""WITH RECURSIVE e AS (SELECT from_node AS a, to_node AS b FROM g_edges WHERE NOT closed AND published UNION SELECT to_node, from_node FROM g_edges WHERE NOT closed AND published),
k(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(k.component) FROM k JOIN e ON e.a = k.node
  LEFT JOIN recurring.k AS r ON r.node = e.b WHERE k.component < coalesce(r.component, 9223372036854775807) GROUP BY e.b)
SELECT node, component FROM k""")
def components(g: Graph) -> DataFrame:
    return connected_components(undirected(g))


@query("""WITH RECURSIVE e AS (SELECT from_node AS a, to_node AS b FROM g_edges WHERE NOT closed AND published UNION SELECT to_node, from_node FROM g_edges WHERE NOT closed AND published),
k(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(k.component) FROM k JOIN e ON e.a = k.node
  LEFT JOIN recurring.k AS r ON r.node = e.b WHERE k.component < coalesce(r.component, 9223372036854775807) GROUP BY e.b)
SELECT node FROM k WHERE component = (SELECT component FROM k GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)""")
def backbone(g: Graph) -> DataFrame:
    """Nodes of the largest component."""
    found = connected_components(undirected(g))
    top = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return found.join(F.broadcast(top), "component", "left_semi").select("node")


@query(f"""WITH RECURSIVE e AS (SELECT from_node AS a, to_node AS b FROM g_edges WHERE NOT closed AND published UNION SELECT to_node, from_node FROM g_edges WHERE NOT closed AND published),
k(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(k.component) FROM k JOIN e ON e.a = k.node
  LEFT JOIN recurring.k AS r ON r.node = e.b WHERE k.component < coalesce(r.component, 9223372036854775807) GROUP BY e.b),
b AS (SELECT n.* FROM k JOIN g_nodes n ON n.id = k.node WHERE component = (SELECT component FROM k GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)),
d AS (SELECT d.id, d.place_id, n.latitude + d.snap_m * 0.0002::DOUBLE AS latitude, n.longitude - d.snap_m * 0.0001::DOUBLE AS longitude FROM g_doors d JOIN g_nodes n ON n.id = d.node_id),
m AS (SELECT d.id, d.place_id, b.id AS node, {PLANE_SQL("d.latitude", "d.longitude", "b.latitude", "b.longitude")} AS metres FROM d, b)
SELECT place_id, id AS door, node, round(metres, 4) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, node) AS k FROM m) WHERE k = 1 AND metres <= 400""")
def doors_on_backbone(g: Graph) -> DataFrame:
    """Places with their doors, drawn some way off the network, snapped to the backbone's nearest node within 400 m."""
    spots = g.nodes.select(F.col("id").alias("node_id"), "latitude", "longitude")
    doors = g.doors.join(spots, "node_id")
    doors = doors.withColumns({"latitude": F.col("latitude") + F.col("snap_m") * 0.0002, "longitude": F.col("longitude") - F.col("snap_m") * 0.0001})
    on = g.nodes.join(backbone(g).withColumnRenamed("node", "id"), "id", "left_semi")
    return etl.snapped_doors(doors, on).select("place_id", "door", "node", close("metres", 4).alias("metres"))


@query("""WITH blocked AS (SELECT from_node AS node, space FROM g_edges WHERE closed UNION ALL SELECT to_node, space FROM g_edges WHERE closed)
SELECT d.place_id, coalesce(min(b.space), 'construction') AS closure FROM g_doors d JOIN blocked b ON b.node = d.node_id GROUP BY d.place_id""")
def closure_names(g: Graph) -> DataFrame:
    shut = g.edges.where("closed")
    ends = shut.select(F.col("from_node").alias("node_id"), "space").unionByName(shut.select(F.col("to_node").alias("node_id"), "space"))
    return g.doors.join(ends, "node_id").groupBy("place_id").agg(F.coalesce(F.min("space"), F.lit("construction")).alias("closure"))


@query(f"""SELECT id, target, round(metres, 4) AS metres FROM (SELECT f.id, n.id AS target, {PLANE_SQL("f.latitude", "f.longitude", "n.latitude", "n.longitude")} AS metres,
row_number() OVER (PARTITION BY f.id ORDER BY {PLANE_SQL("f.latitude", "f.longitude", "n.latitude", "n.longitude")}, n.id) AS k FROM g_fixes f, g_nodes n) WHERE k = 1""")
def nearest_nodes(g: Graph) -> DataFrame:
    targets = g.nodes.select(F.col("id").alias("target"), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lng"))
    return nearest(g.fixes.select("id", "latitude", "longitude"), targets).select("id", "target", close("metres", 4).alias("metres"))


@query(f"""WITH m AS (SELECT e.id, (a.latitude + b.latitude) / 2 AS lat, (a.longitude + b.longitude) / 2 AS lng FROM g_edges e JOIN g_nodes a ON a.id = e.from_node JOIN g_nodes b ON b.id = e.to_node WHERE e.kind <> 'shortcut'),
r AS (SELECT h.id, round({PLANE_SQL("h.latitude", "h.longitude", "m.lat", "m.lng")}, 4) AS metres FROM g_hazards h, m)
SELECT id, min(metres) AS metres FROM r GROUP BY id""")
def nearest_midpoints(g: Graph) -> DataFrame:
    a = g.nodes.select(F.col("id").alias("from_node"), F.col("latitude").alias("la"), F.col("longitude").alias("ga"))
    b = g.nodes.select(F.col("id").alias("to_node"), F.col("latitude").alias("lb"), F.col("longitude").alias("gb"))
    mid = g.edges.where("kind <> 'shortcut'").join(a, "from_node").join(b, "to_node")
    mid = mid.select(F.col("id").alias("target"), ((F.col("la") + F.col("lb")) / 2).alias("t_lat"), ((F.col("ga") + F.col("gb")) / 2).alias("t_lng"))
    return nearest(g.hazards.select("id", "latitude", "longitude"), mid).select("id", close("metres", 4).alias("metres"))


@query("""SELECT p.id, p.name, d.id AS door, n.latitude, n.longitude FROM g_places p JOIN (
SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY step_free DESC, id) AS k FROM g_doors) d ON d.place_id = p.id AND k = 1 JOIN g_nodes n ON n.id = d.node_id""")
def places_with_door(g: Graph) -> DataFrame:
    first = places.first_doors(g.doors).select(F.col("place_id").alias("id"), F.col("id").alias("door"), "node_id")
    spots = g.nodes.select(F.col("id").alias("node_id"), "latitude", "longitude")
    return g.places.join(first, "id").join(spots, "node_id").select("id", "name", "door", "latitude", "longitude")


@query("""SELECT e.id, a.name AS from_name, b.name AS to_name, x.name AS place_a, y.name AS place_b FROM g_edges e JOIN g_nodes a ON a.id = e.from_node JOIN g_nodes b ON b.id = e.to_node
LEFT JOIN g_places x ON x.id = e.from_place LEFT JOIN g_places y ON y.id = e.to_place""")
def edge_names(g: Graph) -> DataFrame:
    node = lambda c, alias: g.nodes.select(F.col("id").alias(c), F.col("name").alias(alias))
    place = lambda c, alias: g.places.select(F.col("id").alias(c), F.col("name").alias(alias))
    rows = g.edges.drop("name").join(node("from_node", "from_name"), "from_node").join(node("to_node", "to_name"), "to_node")
    rows = rows.join(place("from_place", "place_a"), "from_place", "left").join(place("to_place", "place_b"), "to_place", "left")
    return rows.select("id", "from_name", "to_name", "place_a", "place_b")


@query("""SELECT 'edge without start' AS problem, CAST(id AS VARCHAR) AS subject FROM g_edges e WHERE NOT EXISTS (SELECT 1 FROM g_nodes n WHERE n.id = e.from_node)
UNION ALL SELECT 'edge without end', CAST(id AS VARCHAR) FROM g_edges e WHERE NOT EXISTS (SELECT 1 FROM g_nodes n WHERE n.id = e.to_node AND n.id % 50 <> 0)
UNION ALL SELECT 'door without place', CAST(id AS VARCHAR) FROM g_doors d WHERE NOT EXISTS (SELECT 1 FROM g_places p WHERE p.id = d.place_id)
UNION ALL SELECT 'door without node', CAST(id AS VARCHAR) FROM g_doors d WHERE NOT EXISTS (SELECT 1 FROM g_nodes n WHERE n.id = d.node_id)
UNION ALL SELECT 'place without door', CAST(id AS VARCHAR) FROM g_places p WHERE NOT EXISTS (SELECT 1 FROM g_doors d WHERE d.place_id = p.id)
UNION ALL SELECT 'hazard without edge', CAST(id AS VARCHAR) FROM g_hazards h WHERE edge_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.id = h.edge_id AND e.published)""")
def integrity(g: Graph) -> DataFrame:
    def missing(problem: str, left: DataFrame, key: str, right: DataFrame, other: str = "id") -> DataFrame:
        keys = right.select(F.col(other).alias(key)).distinct()
        return left.join(keys, key, "left_anti").select(F.lit(problem).alias("problem"), F.col("id").cast("string").alias("subject"))

    parts = [
        missing("edge without start", g.edges, "from_node", g.nodes),
        missing("edge without end", g.edges, "to_node", g.nodes.where("id % 50 <> 0")),
        missing("door without place", g.doors, "place_id", g.places),
        missing("door without node", g.doors, "node_id", g.nodes),
        missing("place without door", g.places, "id", g.doors, "place_id"),
        missing("hazard without edge", g.hazards.where("edge_id IS NOT NULL"), "edge_id", g.edges.where("published")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT id, title FROM g_hazards h WHERE EXISTS (SELECT 1 FROM g_edges e WHERE e.id = h.edge_id AND e.published)")
def hazards_on_published(g: Graph) -> DataFrame:
    return g.hazards.join(g.edges.where("published").select(F.col("id").alias("edge_id")), "edge_id", "left_semi").select("id", "title")


@query("WITH " + VERIFIED_SQL.format("(SELECT id AS request, from_place AS start_place, (from_place + id % 3 + 36) % 100 AS end_place FROM g_edges WHERE from_place IS NOT NULL)") + " SELECT request, edge, backwards FROM ver")
def verified_paths(g: Graph) -> DataFrame:
    """Requests that an admin path serves as it is: same two places, or doors at both its ends."""
    asked = g.edges.where("from_place IS NOT NULL").select(
        F.col("id").alias("request"), F.col("from_place").alias("start_place"), ((F.col("from_place") + F.col("id") % 3 + 36) % 100).alias("end_place")
    )
    return routing.verified_routes(asked, g.doors, g.edges)


QUERY_VALUES = """(VALUES (0, 'Supplier#000000004'), (1, 'supplier#00000001'), (2, 'hall 1'), (3, 'the nation hall'), (4, '7'), (5, 'Supplier 000000021 building'), (6, 'xyzzy'), (7, 'Hall 1_')) q(query, value)"""
STOP_SQL = "('the','and','for','building','hall','center','centre','house')"
FIND_SQL = f"""WITH q AS (SELECT query, value, list_filter(regexp_split_to_array(lower(value), '[^A-Za-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN {STOP_SQL}) AS words FROM {QUERY_VALUES}),
h AS (SELECT query, id, name, CASE WHEN CAST(id AS VARCHAR) = value OR coalesce(name ILIKE value, FALSE) OR coalesce(alias ILIKE value, FALSE) THEN 1
 WHEN coalesce(name ILIKE concat('%', value, '%'), FALSE) OR coalesce(alias ILIKE concat('%', value, '%'), FALSE) THEN 2
 WHEN len(words) > 0 AND len(list_filter(words, lambda w: NOT contains(lower(name), w))) = 0 THEN 3 END AS tier FROM q, g_places),
b AS (SELECT *, min(tier) OVER (PARTITION BY query) AS best FROM h WHERE tier IS NOT NULL)"""


def typed(g: Graph) -> DataFrame:
    rows = ["Supplier#000000004", "supplier#00000001", "hall 1", "the nation hall", "7", "Supplier 000000021 building", "xyzzy", "Hall 1_"]
    return g.spark.createDataFrame(list(enumerate(rows)), "query int, value string")


@query(FIND_SQL + " SELECT query, CAST(tier AS INT) AS tier, id, name FROM b WHERE tier = best")
def place_search(g: Graph) -> DataFrame:
    return places.find_places(typed(g), g.places)


@query(FIND_SQL + """ SELECT query, CAST(min(tier) AS INT) AS tier, count(*) AS hits, CASE WHEN count(*) = 1 OR min(tier) = 1 THEN min(id) END AS place_id,
CASE WHEN count(*) = 1 OR min(tier) = 1 THEN '' ELSE array_to_string(list_slice(list_sort(list(name)), 1, 12), ',') END AS candidates FROM b WHERE tier = best GROUP BY query""")
def place_answers(g: Graph) -> DataFrame:
    found = places.answers(places.find_places(typed(g), g.places))
    return found.withColumn("candidates", F.array_join("candidates", ","))


@query("SELECT id, name FROM g_places WHERE contains(lower(concat_ws(' ', name, alias, category)), 'garage')")
def place_listing(g: Graph) -> DataFrame:
    return g.places.where(F.contains(F.lower(F.concat_ws(" ", "name", "alias", "category")), F.lit("garage"))).select("id", "name")


@query(f"""WITH v AS (SELECT CAST(query AS INT) AS query, value FROM (VALUES (0, '17'), (1, '39.3301, -76.6212'), (2, 'Supplier#000000004'), (3, 'nowhere')) t(query, value)),
spot AS (SELECT 1 AS query, 39.3301::DOUBLE AS lat, -76.6212::DOUBLE AS lng)
SELECT query, n.id AS node, 0.0::DOUBLE AS snap_m, 'node' AS kind FROM v JOIN g_nodes n ON CAST(n.id AS VARCHAR) = value
UNION ALL SELECT query, id, round(m, 4), 'node' FROM (SELECT s.query, n.id, {PLANE_SQL("s.lat", "s.lng", "n.latitude", "n.longitude")} AS m, row_number() OVER (ORDER BY {PLANE_SQL("s.lat", "s.lng", "n.latitude", "n.longitude")}, n.id) AS k FROM spot s, g_nodes n) WHERE k = 1
UNION ALL SELECT query, d.node_id, snap_m, kind FROM v JOIN g_places p ON p.name ILIKE value JOIN g_doors d ON d.place_id = p.id""")
def snapped_values(g: Graph) -> DataFrame:
    values = g.spark.createDataFrame([(0, "17"), (1, "39.3301, -76.6212"), (2, "Supplier#000000004"), (3, "nowhere")], "query int, value string")
    return places.snap(values, g.nodes, g.places, g.doors, nearest).withColumn("snap_m", close("snap_m", 4))


@query("""WITH d AS (SELECT d.*, r.request, r.mode, bool_or(step_free) OVER (PARTITION BY r.request) AS any_free FROM g_requests r JOIN g_doors d ON d.place_id = r.start_place)
SELECT CAST(request AS INT) AS request, id AS door, node_id AS node FROM d WHERE mode NOT IN ('wheelchair', 'scooter') OR step_free OR NOT any_free""")
def start_doors(g: Graph) -> DataFrame:
    return routing.terminals(g.requests, g.doors, "start_place").select(F.col("search").cast("int").alias("request"), "door", "node")


def fold_sql() -> str:
    arms_s, arms_j, fits = [], [], []
    for (a, s, j), (ns, nj) in lifecycle.TRANSITIONS.items():
        cond = f"action = '{a}'" + (f" AND status = '{s}'" if s != "*" else "") + (f" AND job = '{j}'" if j != "*" else "")
        fits.append(f"({cond})")
        arms_s.append(f"WHEN {cond} THEN " + ("status" if ns == "*" else f"'{ns}'"))
        arms_j.append(f"WHEN {cond} THEN " + ("job" if nj == "*" else f"'{nj}'"))
    return f"""WITH RECURSIVE o AS (SELECT submission, action, row_number() OVER (PARTITION BY submission ORDER BY seq, action) AS k FROM g_reviews),
f(submission, k, status, job, refused) AS (SELECT DISTINCT submission, CAST(0 AS BIGINT), 'pending', 'none', 0 FROM o
 UNION ALL SELECT f.submission, o.k, CASE {' '.join(arms_s)} ELSE status END, CASE {' '.join(arms_j)} ELSE job END, refused + CASE WHEN {' OR '.join(fits)} THEN 0 ELSE 1 END
 FROM f JOIN o ON o.submission = f.submission AND o.k = f.k + 1)
SELECT submission, arg_max(status, k) AS status, arg_max(job, k) AS job, arg_max(refused, k) AS refused FROM f GROUP BY submission"""


@query(fold_sql())
def submission_states(g: Graph) -> DataFrame:
    return lifecycle.fold(g.reviews)


@query("""SELECT submission, action, reviewed_at FROM (SELECT *, row_number() OVER (PARTITION BY submission ORDER BY seq DESC, reviewed_at DESC, action DESC) AS k FROM g_reviews) WHERE k = 1 AND action <> 'reject'""")
def latest_reviews(g: Graph) -> DataFrame:
    log = g.reviews.withColumn("deleted", F.col("action") == "reject")
    return lifecycle.latest(log, "submission", ["seq", "reviewed_at", "action"]).select("submission", "action", "reviewed_at")


@query(f"""SELECT f.id, f.user_id, h.id AS hazard, round({PLANE_SQL("f.latitude", "f.longitude", "h.latitude", "h.longitude")}, 4) AS metres FROM g_fixes f JOIN g_hazards h
ON h.active AND {PLANE_SQL("f.latitude", "f.longitude", "h.latitude", "h.longitude")} <= 45""")
def near_hazards(g: Graph) -> DataFrame:
    spots = g.hazards.where("active").select(F.col("id").alias("hazard"), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lng"))
    rows = within(g.fixes.select("id", "user_id", "latitude", "longitude"), spots, 45.0, degrees=0.001, digits=4)
    return rows.select("id", "user_id", "hazard", "metres")


@query(f"""WITH m AS (SELECT f.id, f.user_id, f.ts, min({HAVERSINE_SQL.replace("lat1", "f.latitude").replace("lng1", "f.longitude").replace("lat2", "n.latitude").replace("lng2", "n.longitude")}) > 60 AS off
 FROM g_fixes f JOIN g_nodes n ON n.id % 7 = f.user_id % 7 GROUP BY f.id, f.user_id, f.ts)
SELECT id, user_id, ts FROM (SELECT *, lag(off) OVER (PARTITION BY user_id ORDER BY ts, id) AS before FROM m) WHERE off AND NOT coalesce(before, FALSE)""")
def off_route(g: Graph) -> DataFrame:
    """The fixes at which a user leaves the route; each user's route is a set of nodes."""
    vertices = g.nodes.withColumn("route", F.col("id") % 7)
    return live.left_route(live.off_route_flags(g.fixes.withColumn("route", F.col("user_id") % 7), vertices, 60.0))


ZONES = [
    (0, "quad", [(-76.6295, 39.3205), (-76.6255, 39.3205), (-76.6255, 39.3245), (-76.6295, 39.3245)]),
    (1, "yard", [(-76.6205, 39.3305), (-76.6165, 39.3325), (-76.6205, 39.3365)]),
    (2, "green", [(-76.6285, 39.3265), (-76.6215, 39.3265), (-76.6215, 39.3285), (-76.6285, 39.3285)]),
]
ZONES_SQL = "(VALUES " + ", ".join(
    "({}, '{}', [{}])".format(z, t, ", ".join(f"{{'x': CAST({x} AS DOUBLE), 'y': CAST({y} AS DOUBLE)}}" for x, y in r)) for z, t, r in ZONES
) + ") z(zone, title, ring)"
HELD_SQL = f"""s AS (SELECT n.id, z.zone, ring[k] AS a, ring[CASE WHEN k = len(ring) THEN 1 ELSE k + 1 END] AS b, n.longitude AS x, n.latitude AS y
 FROM g_nodes n, (SELECT zone, ring, unnest(range(1, len(ring) + 1)) AS k FROM {ZONES_SQL}) z),
held AS (SELECT id, zone FROM s GROUP BY id, zone HAVING count(*) FILTER (WHERE (a.y > y) <> (b.y > y) AND x < (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x) % 2 = 1)"""


def zones(g: Graph) -> DataFrame:
    return g.spark.createDataFrame(ZONES, "zone int, title string, ring array<struct<x:double,y:double>>")


def spots(g: Graph) -> DataFrame:
    return g.nodes.select("id", F.col("longitude").alias("x"), F.col("latitude").alias("y"))


@query(f"WITH {HELD_SQL} SELECT id, CAST(zone AS INT) AS zone FROM held")
def nodes_in_zones(g: Graph) -> DataFrame:
    return etl.containing(spots(g), zones(g).drop("title")).select("id", "zone")


@query(f"WITH {HELD_SQL} SELECT e.id AS edge, CAST(min(a.zone) AS INT) AS zone FROM g_edges e JOIN held a ON a.id = e.from_node JOIN held b ON b.id = e.to_node AND b.zone = a.zone GROUP BY e.id")
def closed_by_zone(g: Graph) -> DataFrame:
    edges = g.edges.select(F.col("id").alias("edge"), "from_node", "to_node")
    return etl.closures(edges, spots(g), zones(g).drop("title"))


@query("""WITH p AS (SELECT e.from_node AS id, e.id AS edge, b.longitude AS x, b.latitude AS y FROM g_edges e JOIN g_nodes b ON b.id = e.to_node),
k AS (SELECT *, concat('n', CAST(CAST(round_even(x * 100000, 0) AS BIGINT) AS VARCHAR), '_', CAST(CAST(round_even(y * 100000, 0) AS BIGINT) AS VARCHAR)) AS key, row_number() OVER (PARTITION BY id ORDER BY edge) - 1 AS i FROM p),
n AS (SELECT *, lead(key) OVER (PARTITION BY id ORDER BY i) AS next FROM k)
SELECT concat('e-', CAST(id AS VARCHAR), '-', CAST(i AS VARCHAR)) AS edge, CASE WHEN id % 4 = 0 THEN next ELSE key END AS from_node, CASE WHEN id % 4 = 0 THEN key ELSE next END AS to_node
FROM n WHERE next IS NOT NULL AND key <> next""")
def line_segments(g: Graph) -> DataFrame:
    b = g.nodes.select(F.col("id").alias("to_node"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    rows = g.edges.join(b, "to_node").groupBy("from_node").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("l"))
    line = F.transform("l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rows = rows.select(F.col("from_node").alias("id"), line.alias("line"), F.when(F.col("from_node") % 4 == 0, 3).otherwise(1).alias("direction"))
    return etl.segments(rows).select("edge", "from_node", "to_node")


@query("""SELECT e.id, coalesce(s.surface, e.surface) AS surface, coalesce(s.slope, e.slope) AS slope, e.verified OR s.edge IS NOT NULL AS verified,
CASE WHEN s.edge IS NOT NULL THEN CAST(0.96 AS DOUBLE) ELSE e.confidence END AS confidence FROM g_edges e
LEFT JOIN (SELECT id AS edge, CASE WHEN id % 2 = 0 THEN 'brick' END AS surface, CASE WHEN id % 3 = 0 THEN CAST(0.01 AS DOUBLE) END AS slope FROM g_edges WHERE id % 97 = 0) s ON s.edge = e.id""")
def observed_edges(g: Graph) -> DataFrame:
    k = F.col("id")
    seen = g.edges.where(k % 97 == 0).select(k.alias("edge"), F.when(k % 2 == 0, "brick").alias("surface"), F.when(k % 3 == 0, 0.01).alias("slope"))
    return etl.observed(g.edges, seen).select("id", "surface", "slope", "verified", "confidence")


@query()
def lawn_shortcuts(g: Graph) -> DataFrame:
    z = zones(g).drop("title")
    return etl.shortcuts(spots(g), z.where("zone <> 1"), z.where("zone = 1"))


@query()
def door_buildings(g: Graph) -> DataFrame:
    doors = g.doors.join(spots(g).withColumnRenamed("id", "node_id"), "node_id")
    doors = doors.select("id", "x", "y", F.concat(F.when(F.col("id") % 3 == 0, "Quad ").otherwise("North "), "label").alias("name"))
    return etl.door_buildings(doors, zones(g))


@query(f"""WITH {HELD_SQL} SELECT CAST(zone AS INT) AS zone, CAST(id AS VARCHAR) AS id, 'entrance' AS kind FROM held WHERE zone = 0
UNION ALL SELECT zone, NULL, 'centre' FROM {ZONES_SQL} WHERE zone <> 0""")
def place_points(g: Graph) -> DataFrame:
    held = etl.containing(spots(g), zones(g).drop("title").where("zone = 0")).select("zone", "id", "x", "y")
    return etl.place_points(zones(g), held).select("zone", "id", "kind")


@query(ROUTES_SQL + """ SELECT CAST(r.request AS INT) AS request, h.id AS hazard, h.severity FROM (SELECT request, unnest(path) AS edge FROM best) r JOIN g_hazards h ON h.edge_id = r.edge AND h.active""")
def route_hazards(g: Graph) -> DataFrame:
    """Active hazards on each route, whatever the time of day."""
    on = found_routes(g).select("search", F.explode("path").alias("edge_id"))
    return on.join(g.hazards.where("active"), "edge_id").select(F.col("search").cast("int").alias("request"), F.col("id").alias("hazard"), "severity")


EXPLAIN_SQL = ROUTES_SQL + f""", r AS (SELECT b.request, e.* FROM (SELECT request, unnest(path) AS edge FROM best) b JOIN g_edges e ON e.id = b.edge),
m AS (SELECT request, sum(distance_m) AS d, sum(CASE WHEN kind = 'shortcut' THEN distance_m ELSE 0 END) AS shortcut_m,
  coalesce(array_to_string(list_sort(list(DISTINCT space) FILTER (WHERE kind = 'shortcut' AND space IS NOT NULL)), ', '), '') AS spaces, count(grade) > 0 AS graded,
  sum(CASE WHEN grade = 'FullyCompliant' THEN distance_m ELSE 0 END) AS compliant_m, sum(CASE WHEN verified THEN distance_m ELSE 0 END) AS verified_m,
  sum(CASE WHEN slope IS NULL OR safety IS NULL OR surface IS NULL OR roughness IS NULL OR lit IS NULL THEN distance_m ELSE 0 END) AS unknown_m FROM r GROUP BY request),
x AS (SELECT r.request, bool_or({APPLIES_SQL}) AS hazards FROM r JOIN g_hazards hz ON hz.edge_id = r.id AND hz.active JOIN g_requests q ON q.request = r.request GROUP BY r.request)
SELECT CAST(q.request AS INT) AS request, array_to_string(list_filter([concat('Costs for ', mode, ' by ', CASE WHEN night THEN 'night' ELSE 'day' END),
 CASE WHEN mode = 'wheelchair' THEN 'Stairs and raised curbs are excluded' END, CASE WHEN shortcut_m > 0 THEN concat('Crosses open lawn: ', spaces) END,
 CASE WHEN a.snap_m > 40 THEN concat('Paths end ', CAST(CAST(round(a.snap_m) AS INT) AS VARCHAR), ' m from the start') END,
 CASE WHEN b.snap_m > 40 THEN concat('Paths end ', CAST(CAST(round(b.snap_m) AS INT) AS VARCHAR), ' m from the end') END,
 CASE WHEN graded THEN concat('Surveyed as fully compliant: ', CAST(CAST(round(compliant_m / greatest(d, 1) * 100) AS INT) AS VARCHAR), '%') END,
 CASE WHEN unknown_m > 0 THEN concat(CAST(CAST(round(unknown_m / greatest(d, 1) * 100) AS INT) AS VARCHAR), '% lacks a reading') END,
 CASE WHEN hazards THEN 'Hazards on the way raise its cost' END, CASE WHEN verified_m < d THEN 'Unverified segments are disclosed' END,
 CASE WHEN night THEN 'Lighting weighs more at night' END], lambda v: v IS NOT NULL), '; ') AS explanation
FROM m JOIN g_requests q ON q.request = m.request JOIN best ON best.request = m.request LEFT JOIN x ON x.request = m.request
JOIN (SELECT place_id, node_id, min(snap_m) AS snap_m FROM g_doors GROUP BY place_id, node_id) a ON a.place_id = q.start_place AND a.node_id = best.nodes[1]
JOIN (SELECT place_id, node_id, min(snap_m) AS snap_m FROM g_doors GROUP BY place_id, node_id) b ON b.place_id = q.end_place AND b.node_id = best.node"""


@query(EXPLAIN_SQL)
def route_explanations(g: Graph) -> DataFrame:
    found = stage(found_routes(g), "found")
    rows = routing.route_edges(found, g.edges)
    asked = g.requests.select(F.col("request").alias("search"), "mode", "night", "start_place", "end_place")
    met = found.select("search", F.col("node").alias("last"), F.get("nodes", F.lit(0)).alias("first")).join(asked, "search")
    gap = g.doors.groupBy("place_id", "node_id").agg(F.min("snap_m").alias("snap_m"))
    for place, node, name in (("start_place", "first", "snap_from"), ("end_place", "last", "snap_to")):
        met = met.join(gap.select(F.col("place_id").alias(place), F.col("node_id").alias(node), F.col("snap_m").alias(name)), [place, node])
    on = rows.select("search", F.col("id").alias("edge_id")).join(g.hazards.where("active"), "edge_id").join(asked.select("search", "night"), "search")
    on = on.groupBy("search").agg(F.bool_or(C.hazard_applies(F.col("active_when"), F.col("night"))).alias("hazards"))
    s = routing.summary(rows).join(met, "search").join(on, "search", "left").withColumn("avoided", F.lit(0))
    return s.select(F.col("search").cast("int").alias("request"), F.array_join(routing.explanation(), "; ").alias("explanation"))


def written(lng: str, lat: str) -> F.Column:
    """A position as whole hundred-thousandths of a degree."""
    part = lambda c: F.round(F.col(c) * 100000, 0).cast("long").cast("string")
    return F.concat_ws(" ", part(lng), part(lat))


WRITTEN_SQL = "concat(CAST(CAST(round({} * 100000) AS BIGINT) AS VARCHAR), ' ', CAST(CAST(round({} * 100000) AS BIGINT) AS VARCHAR))".format


@query(ROUTES_SQL + f""" SELECT CAST(request AS INT) AS request, string_agg({WRITTEN_SQL("n.longitude", "n.latitude")}, ',' ORDER BY k) AS geometry
FROM (SELECT request, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS k FROM best) p JOIN g_nodes n ON n.id = p.node GROUP BY request""")
def route_geometry(g: Graph) -> DataFrame:
    """The vertices of each route in travel order, joints once."""
    spots = found_routes(g).select("search", F.posexplode("nodes").alias("k", "id")).join(g.nodes, "id")
    line = F.array_sort(F.collect_list(F.struct("k", written("longitude", "latitude").alias("p"))))
    return spots.groupBy(F.col("search").cast("int").alias("request")).agg(F.array_join(F.transform(line, lambda x: x["p"]), ",").alias("geometry"))


def drawn_edges(g: Graph, edges: DataFrame | None = None) -> DataFrame:
    """These edges, or all, with the positions of their ends and ``geometry``: a third has a line by way of a third point, a third an empty one."""
    k, middle = F.col("id"), lambda a, b: (F.col(a) + F.col(b)) / 2 + 0.0001
    pair = lambda lat, lng: F.concat(F.lit("["), lat.cast("string"), F.lit(","), lng.cast("string"), F.lit("]"))
    drawn = F.concat(F.lit("["), pair(F.col("lat1"), F.col("lng1")), F.lit(","), pair(middle("lat1", "lat2"), middle("lng1", "lng2")), F.lit(","), pair(F.col("lat2"), F.col("lng2")), F.lit("]"))
    return ends(g, edges).withColumn("geometry", F.when(k % 3 == 1, "[]").when(k % 3 == 2, drawn))


@query(f"""SELECT id, CASE WHEN id % 3 < 2 THEN concat(a, ',', b) WHEN id % 2 = 0 THEN concat(b, ',', m, ',', a) ELSE concat(a, ',', m, ',', b) END AS line FROM (
SELECT id, {WRITTEN_SQL("lng1", "lat1")} AS a, {WRITTEN_SQL("lng2", "lat2")} AS b, {WRITTEN_SQL("((lng1 + lng2) / 2 + 0.0001::DOUBLE)", "((lat1 + lat2) / 2 + 0.0001::DOUBLE)")} AS m FROM ({ENDS_SQL}))""")
def edge_lines(g: Graph) -> DataFrame:
    """Edges' drawn lines, latitude first in the text, in travel order; edges without a drawing have their ends."""
    k, rows = F.col("id"), drawn_edges(g)
    line = geo.edge_line(F.col("geometry"), k % 2 == 0, F.col("lng1"), F.col("lat1"), F.col("lng2"), F.col("lat2"))
    part = lambda x: F.round(x * 100000, 0).cast("long").cast("string")
    return rows.select("id", F.array_join(F.transform(line, lambda p: F.concat_ws(" ", part(p[0]), part(p[1]))), ",").alias("line"))


@query(f"""SELECT id, CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END AS points FROM ({ENDS_SQL})""")
def drawn_to_doors(g: Graph) -> DataFrame:
    """Points of drawn lines that begin 17 m or 4 m beside the door of their start."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b = point(F.col("lng1"), F.col("lat1")), point(F.col("lng2"), F.col("lat2"))
    begin = point(F.col("lng1") + F.when(F.col("id") % 2 == 0, 0.0002).otherwise(0.00005), F.col("lat1"))
    return ends(g).select("id", F.size(geo.joined_to_doors(F.array(begin, b), a, b)).alias("points"))


@query("""SELECT id, CASE WHEN id % 4 <> 0 THEN label END AS label, CASE WHEN id % 4 <> 0 THEN kind END AS kind, CASE WHEN id % 4 <> 0 THEN step_free END AS step_free FROM g_doors""")
def door_cards(g: Graph) -> DataFrame:
    """What a traveller is told of a door; a bare node is none."""
    kind = F.when(F.col("id") % 4 == 0, "node").otherwise(F.col("kind"))
    return g.doors.withColumn("kind", kind).select("id", places.door_card().alias("card")).select("id", "card.*")


@query("SELECT id, name FROM g_places WHERE contains(lower(name), '#00000001') OR contains(lower(name), '7')")
def titled_places(g: Graph) -> DataFrame:
    return g.places.where(places.contains_any(F.col("name"), ["#00000001", "7"])).select("id", "name")


RESOLVE_VALUES = ["Supplier 000000004", "hall 3", "lawn 000000002", "the 000000017 supplier", "0000000", "  ", "nowhere"]
PLAIN_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format


@query(f"""WITH v AS (SELECT k AS query, {PLAIN_SQL("value")} AS q FROM (SELECT unnest(range(0, {len(RESOLVE_VALUES)})) AS k, unnest({RESOLVE_VALUES}) AS value)),
p AS (SELECT id, name, {PLAIN_SQL("name")} AS n, CASE WHEN category <> 'lawn' THEN {PLAIN_SQL("alias")} END AS a FROM g_places),
h AS (SELECT query, id, name, CASE WHEN n = q THEN 1 WHEN coalesce(a = q, FALSE) THEN 2 WHEN contains(n, q) THEN 3
 WHEN len(list_filter(string_split(q, ' '), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in OFFLINE_STOPWORDS)}))) > 0
  AND len(list_filter(string_split(q, ' '), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in OFFLINE_STOPWORDS)}) AND NOT contains(n, w))) = 0 THEN 4 END AS tier FROM v, p WHERE q <> ''),
b AS (SELECT *, min(tier) OVER (PARTITION BY query) AS best FROM h WHERE tier IS NOT NULL)
SELECT CAST(query AS INT) AS query, CAST(min(tier) AS INT) AS tier, count(*) AS hits, CASE WHEN count(*) = 1 OR min(tier) <= 2 THEN min(id) END AS place_id FROM b WHERE tier = best GROUP BY query""")
def resolved_places(g: Graph) -> DataFrame:
    """The offline resolver: normalised names, then aliases of what is no lawn, then parts and words of names."""
    asked = g.spark.createDataFrame(list(enumerate(RESOLVE_VALUES)), "query int, value string")
    table = g.places.withColumn("alias", F.when(F.col("category") != "lawn", F.col("alias")))
    return places.resolve(asked, table)
