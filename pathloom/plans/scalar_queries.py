"""Queries over single rows, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import cost as C
from pathloom.functions import geo, rules, text
from pathloom.operators import etl, routing
from pathloom.plans.registry import query
from pathloom.plans.views import Graph

MODES = "(VALUES ('walking'), ('wheelchair'), ('scooter'), ('bicycle')) m(mode)"
TIMES = "(VALUES (TRUE), (FALSE)) t(night)"


def _case(table: dict[str, dict[str, float]], column: str, other: str) -> str:
    arms = " ".join(f"WHEN mode = '{m}' AND {column} = '{k}' THEN {v}" for m, row in table.items() for k, v in row.items())
    return f"CAST(CASE {arms} {other} END AS DOUBLE)"


SPEED_SQL = "CAST(CASE mode " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in C.SPEED.items()) + " END AS DOUBLE)"
BLOCKED_SQL = """(closed OR NOT published OR (mode = 'wheelchair' AND (stairs OR curb OR coalesce(abs(slope) > CAST(0.1 AS DOUBLE), FALSE)))
  OR (mode IN ('scooter', 'bicycle') AND stairs) OR (mode = 'scooter' AND coalesce(surface IN ('dirt', 'gravel'), FALSE)))"""
D = "CAST({} AS DOUBLE)".format
COST_SQL = f"""(distance_m / {SPEED_SQL}
  * coalesce({_case(C.SURFACE, "surface", "WHEN surface IS NOT NULL THEN 1.4")}, {D(1)})
  * coalesce({D(1)} + roughness * CAST(CASE WHEN mode IN ('wheelchair', 'scooter') THEN 2.5 ELSE 0.8 END AS DOUBLE), {D(1)})
  * coalesce({D(1)} + CASE WHEN slope IS NOT NULL THEN greatest({D(0)}, slope) END * CAST(CASE WHEN mode = 'wheelchair' THEN 8.0 ELSE 3.0 END AS DOUBLE), {D(1)})
  * coalesce({D(1)} + ({D(1)} - safety) * CAST(CASE WHEN night THEN 1.8 ELSE 0.8 END AS DOUBLE), {D(1)})
  * CAST(CASE WHEN night AND lit IS NOT DISTINCT FROM FALSE THEN 1.7 ELSE 1.0 END AS DOUBLE)
  * coalesce({_case(C.GRADE, "grade", "")}, {D(1)})
  * ({D(1)} + severity * {D(0.15)})
  * CASE WHEN verified AND source = 'admin' THEN {D(0.82)} WHEN verified THEN {D(0.96)}
         ELSE {D(1)} + greatest({D(0)}, {D(0.7)} - confidence) * {D(0.08)} END)"""
APPLIES_SQL = """CASE lower(coalesce(nullif(active_when, ''), 'always')) WHEN 'night' THEN night WHEN 'day' THEN NOT night ELSE TRUE END"""
HAVERSINE_SQL = """(2 * 6371000.0::DOUBLE * atan2(
  sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2)),
  sqrt(1 - (pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2)))))"""
ENDS_SQL = """SELECT e.id, a.latitude AS lat1, a.longitude AS lng1, b.latitude AS lat2, b.longitude AS lng2
FROM g_edges e JOIN g_nodes a ON a.id = e.from_node JOIN g_nodes b ON b.id = e.to_node"""


def ends(g: Graph, edges: DataFrame | None = None) -> DataFrame:
    """These edges, or all, with the positions of their ends."""
    a = g.nodes.select(F.col("id").alias("from_node"), F.col("latitude").alias("lat1"), F.col("longitude").alias("lng1"))
    b = g.nodes.select(F.col("id").alias("to_node"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lng2"))
    return (g.edges if edges is None else edges).join(a, "from_node").join(b, "to_node")


def close(column, digits: int = 6):
    """Doubles from trigonometry agree between engines to many digits, not to the last."""
    return F.round(column, digits)


def profiles(g: Graph) -> DataFrame:
    modes = g.spark.createDataFrame([(m,) for m in C.SPEED], "mode string")
    return modes.crossJoin(g.spark.createDataFrame([(True,), (False,)], "night boolean"))


@query(f"SELECT id, mode, night, severity, {BLOCKED_SQL} AS blocked, {COST_SQL} AS cost FROM (SELECT *, CAST(id % 4 AS INT) AS severity FROM g_edges) e, {MODES}, {TIMES}")
def edge_costs(g: Graph) -> DataFrame:
    rows = g.edges.withColumn("severity", (F.col("id") % 4).cast("int")).crossJoin(F.broadcast(profiles(g)))
    mode, night = F.col("mode"), F.col("night")
    return rows.select("id", "mode", "night", "severity", C.blocked(mode).alias("blocked"), C.edge_cost(mode, night, F.col("severity")).alias("cost"))


@query(f"""SELECT edge_id, night, CAST(coalesce(max(CASE WHEN active AND {APPLIES_SQL} THEN severity END), 0) AS INT) AS severity
FROM g_hazards, {TIMES} WHERE edge_id IS NOT NULL GROUP BY edge_id, night""")
def hazard_severity(g: Graph) -> DataFrame:
    parts = [routing.severities(g.hazards, F.lit(n)).withColumn("night", F.lit(n)) for n in (True, False)]
    return parts[0].unionByName(parts[1]).select("edge_id", "night", F.col("severity").cast("int"))


@query("""SELECT id, from_node, to_node FROM g_edges WHERE published AND id NOT IN (3, 5, 8, 13, 21)
AND (kind <> 'shortcut' OR id % 2 = 0)""")
def usable_edges(g: Graph) -> DataFrame:
    smarter = F.col("id") % 2 == 0
    rows = g.edges.where("published").where(~F.col("id").isin(3, 5, 8, 13, 21))
    return rows.where(C.usable(smarter, F.lit("walking"))).select("id", "from_node", "to_node")


@query("SELECT id, edge_id, severity FROM g_hazards WHERE active AND edge_id IS NOT NULL")
def active_hazards(g: Graph) -> DataFrame:
    return g.hazards.where("active AND edge_id IS NOT NULL").select("id", "edge_id", "severity")


@query("SELECT id, name, alias, category FROM g_places WHERE id = 42")
def place_by_id(g: Graph) -> DataFrame:
    return g.places.where(F.col("id") == 42).limit(1).select("id", "name", "alias", "category")


@query("SELECT id, name, category FROM g_places WHERE upper(name) = upper('supplier#000000007')")
def place_by_code(g: Graph) -> DataFrame:
    return g.places.where(F.upper("name") == F.upper(F.lit("supplier#000000007"))).select("id", "name", "category")


@query(f"""SELECT id, round({HAVERSINE_SQL}, 5) AS haversine,
round(sqrt(pow((lng2 - lng1) * {D(111320)} * {D(0.7735)}, 2) + pow((lat2 - lat1) * {D(110540)}, 2)), 5) AS plane_fixed,
round(sqrt(pow((lng2 - lng1) * ({D(111320)} * cos(radians(39.329))), 2) + pow((lat2 - lat1) * {D(110540)}, 2)), 5) AS plane_campus,
round(sqrt(pow((lng2 - lng1) * {D(111320)} * cos(radians(lat1)), 2) + pow((lat2 - lat1) * {D(111320)}, 2)), 5) AS plane_local
FROM ({ENDS_SQL})""")
def edge_distances(g: Graph) -> DataFrame:
    a, b, c, d = (F.col(x) for x in ("lat1", "lng1", "lat2", "lng2"))
    return ends(g).select(
        "id",
        close(geo.haversine(a, b, c, d), 5).alias("haversine"),
        close(geo.plane_fixed(a, b, c, d), 5).alias("plane_fixed"),
        close(geo.plane_campus(b, a, d, c), 5).alias("plane_campus"),
        close(geo.plane_local(a, b, c, d), 5).alias("plane_local"),
    )


@query(f"""SELECT id, round(CASE WHEN angle < 0 THEN angle + 360 ELSE angle END, 6) AS bearing FROM (
SELECT id, degrees(atan2(sin(radians(lng2 - lng1)) * cos(radians(lat2)),
  cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng2 - lng1)))) AS angle
FROM ({ENDS_SQL}) WHERE lat1 <> lat2 OR lng1 <> lng2)""")
def edge_bearings(g: Graph) -> DataFrame:
    rows = ends(g).where("lat1 <> lat2 OR lng1 <> lng2")
    return rows.select("id", close(geo.bearing(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))).alias("bearing"))


@query("""SELECT id, key, CAST(split_part(substr(key, 2), '_', 1) AS DOUBLE) / 100000 AS longitude,
CAST(split_part(key, '_', 2) AS DOUBLE) / 100000 AS latitude FROM (
SELECT id, concat('n', CAST(CAST(round_even(longitude * 100000, 0) AS BIGINT) AS VARCHAR), '_', CAST(CAST(round_even(latitude * 100000, 0) AS BIGINT) AS VARCHAR)) AS key FROM g_nodes)""")
def node_keys(g: Graph) -> DataFrame:
    rows = g.nodes.select("id", text.node_key(F.col("longitude"), F.col("latitude")).alias("key"))
    return rows.select("id", "key", text.key_position(F.col("key"))["longitude"].alias("longitude"), text.key_position(F.col("key"))["latitude"].alias("latitude"))


@query(r"""WITH t AS (SELECT id, CASE id % 5 WHEN 0 THEN concat(CAST(39 + id % 7 AS VARCHAR), '.5, -76.25') WHEN 1 THEN concat('-120.5,', CAST(id % 60 AS VARCHAR))
 WHEN 2 THEN concat('76.5,', CAST(id % 40 AS VARCHAR), ',12.0') WHEN 3 THEN 'Current location' ELSE ' 12.5 , 13 ' END AS value FROM g_fixes),
p AS (SELECT id, list_transform(string_split(trim(value), ','), lambda x: trim(x)) AS p FROM t),
n AS (SELECT id, CASE WHEN len(p) IN (2, 3) AND len(list_filter(p, lambda x: NOT regexp_full_match(x, '-?[0-9]+([.][0-9]+)?'))) = 0 THEN CAST(p[1] AS DOUBLE) END AS a,
 CASE WHEN len(p) IN (2, 3) AND len(list_filter(p, lambda x: NOT regexp_full_match(x, '-?[0-9]+([.][0-9]+)?'))) = 0 THEN CAST(p[2] AS DOUBLE) END AS b FROM p)
SELECT id, CASE WHEN (abs(a) > 90 AND abs(b) <= 90) OR (abs(a) > 50 AND abs(b) < 50) THEN b ELSE a END AS latitude,
 CASE WHEN (abs(a) > 90 AND abs(b) <= 90) OR (abs(a) > 50 AND abs(b) < 50) THEN a ELSE b END AS longitude FROM n""")
def gps_values(g: Graph) -> DataFrame:
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    k = F.col("id")
    value = (
        F.when(k % 5 == 0, F.concat(s(39 + k % 7), F.lit(".5, -76.25")))
        .when(k % 5 == 1, F.concat(F.lit("-120.5,"), s(k % 60)))
        .when(k % 5 == 2, F.concat(F.lit("76.5,"), s(k % 40), F.lit(",12.0")))
        .when(k % 5 == 3, "Current location")
        .otherwise(" 12.5 , 13 ")
    )
    rows = g.fixes.select("id", text.parse_gps(value).alias("p"))
    return rows.select("id", "p.latitude", "p.longitude")


DIRECTION_SQL = """CASE WHEN abs(lng2 - lng1) > abs(lat2 - lat1) THEN CASE WHEN lng2 > lng1 THEN 'east' ELSE 'west' END
 WHEN lat2 > lat1 THEN 'north' ELSE 'south' END"""
NOUNS_SQL = ", ".join(f"'{n}'" for n in routing.COMMON_NOUNS)
INSTRUCTION_SQL = f"""CASE WHEN kind = 'shortcut' THEN concat('Cut ', heading, ' across ', coalesce(name, 'the lawn'))
 WHEN kind = 'stairs' THEN concat('Take the steps ', heading, CASE WHEN riser_count > 0 THEN concat(' (', CAST(riser_count AS VARCHAR), ' steps)') ELSE '' END)
 WHEN kind = 'ramp' THEN concat('Follow the ramp ', heading)
 WHEN kind = 'indoor' THEN CASE WHEN name IS NOT NULL THEN concat('Go ', heading, ' through ', name) ELSE concat('Continue ', heading, ' indoors') END
 WHEN name IS NOT NULL THEN concat('Head ', heading, ' along the ', CASE WHEN name IN ({NOUNS_SQL}) THEN lower(name) ELSE name END)
 ELSE concat('Head ', heading) END"""
CAUTIONS_SQL = """[CASE WHEN stairs THEN 'stairs' END, CASE WHEN curb THEN 'unlowered curb' END,
CASE WHEN roughness >= 0.4 THEN 'rough surface' END, CASE WHEN night AND lit IS NOT DISTINCT FROM FALSE THEN 'unlit at night' END,
CASE WHEN grade = 'NonCompliant' THEN 'may have travel hazards' END, CASE WHEN kind = 'shortcut' THEN 'crosses open lawn' END]"""


@query(f"""WITH r AS (SELECT e.id, e.kind, e.name, e.riser_count, {DIRECTION_SQL} AS heading FROM g_edges e JOIN ({ENDS_SQL}) x ON x.id = e.id)
SELECT id, heading, {INSTRUCTION_SQL} AS instruction FROM r""")
def edge_instructions(g: Graph) -> DataFrame:
    rows = ends(g).withColumn("heading", routing.direction(F.col("lng2") - F.col("lng1"), F.col("lat2") - F.col("lat1")))
    return rows.select("id", "heading", routing.instruction(F.col("kind"), F.col("name"), F.col("heading"), F.col("riser_count")).alias("instruction"))


@query(f"""SELECT id, night, array_to_string(list_filter({CAUTIONS_SQL}, lambda x: x IS NOT NULL), '; ') AS cautions
FROM g_edges, {TIMES}""")
def edge_cautions(g: Graph) -> DataFrame:
    rows = g.edges.crossJoin(F.broadcast(g.spark.createDataFrame([(True,), (False,)], "night boolean")))
    return rows.select("id", "night", F.array_join(routing.cautions(F.col("night")), "; ").alias("cautions"))


@query("""SELECT id, kind2 AS kind, CASE kind2 WHEN 'ramp' THEN CAST(0.6 AS DOUBLE) WHEN 'indoor' THEN CAST(0.5 AS DOUBLE) WHEN 'shortcut' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.55 AS DOUBLE) END AS trust
FROM (SELECT id, CASE WHEN space IS NOT NULL AND id % 2 = 0 THEN 'shortcut' WHEN stairs THEN 'stairs' WHEN curb THEN 'ramp' WHEN lit THEN 'indoor' ELSE 'paved' END AS kind2 FROM g_edges)""")
def edge_kinds(g: Graph) -> DataFrame:
    kind = etl.edge_kind(F.col("space").isNotNull() & (F.col("id") % 2 == 0), F.col("stairs"), F.col("curb"), F.col("lit"))
    rows = g.edges.select("id", kind.alias("kind"))
    return rows.withColumn("trust", etl.confidence(F.col("kind")))


@query(r"""WITH t AS (SELECT id, name, concat(name, ' -- The ', coalesce(alias, category), ' Building') AS long FROM g_places),
c AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Non-Compliant' WHEN 1 THEN 'partially compliant' WHEN 2 THEN 'FULLY COMPLIANT' WHEN 3 THEN '--' ELSE 'Other' END AS code FROM g_places)
SELECT t.id, regexp_replace(regexp_replace(lower(long), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
trim(regexp_replace(lower(long), '[^a-z0-9]+', ' ', 'g')) AS plain,
len(list_filter(list_distinct(string_split(trim(regexp_replace(lower(long), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w <> '')) AS n_tokens,
len(list_filter(regexp_split_to_array(lower(long), '[^A-Za-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN ('the','and','for','building','hall','center','centre','house'))) AS n_signal,
CASE WHEN contains(x, 'non') THEN 'NonCompliant' WHEN contains(x, 'partial') THEN 'PartiallyCompliant' WHEN contains(x, 'compliant') THEN 'FullyCompliant' WHEN x <> '' THEN 'Other' END AS grade
FROM t JOIN (SELECT id, lower(regexp_replace(code, '[^A-Za-z]', '', 'g')) AS x FROM c) USING (id)""")
def place_texts(g: Graph) -> DataFrame:
    k = F.col("id") % 5
    code = F.when(k == 0, "Non-Compliant").when(k == 1, "partially compliant").when(k == 2, "FULLY COMPLIANT").when(k == 3, "--").otherwise("Other")
    long = F.concat("name", F.lit(" -- The "), F.coalesce("alias", "category"), F.lit(" Building"))
    return g.places.select(
        "id",
        text.slug(long).alias("slug"),
        text.plain(long).alias("plain"),
        F.size(text.tokens(long)).cast("long").alias("n_tokens"),
        F.size(text.signal_words(long)).cast("long").alias("n_signal"),
        text.accessibility(code).alias("grade"),
    )


@query("""SELECT id, CASE WHEN distance_m >= 200 THEN 'long' ELSE 'short' END AS label, CAST(greatest(1, floor(distance_m / 60 + 0.5)) AS BIGINT) AS minutes,
coalesce(nullif(safety, 0), 0.92) AS safety, sha256(CAST(id AS VARCHAR)) AS token,
greatest(distance_m * CAST(0.3048 AS DOUBLE), CAST(1 AS DOUBLE)) AS metres FROM g_edges""")
def edge_labels(g: Graph) -> DataFrame:
    return g.edges.select(
        "id",
        F.when(F.col("distance_m") >= 200, "long").otherwise("short").alias("label"),
        F.greatest(F.lit(1), F.floor(F.col("distance_m") / 60 + 0.5)).cast("long").alias("minutes"),
        F.coalesce(F.nullif("safety", F.lit(0.0)), F.lit(0.92)).alias("safety"),
        F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("token"),
        F.greatest(F.col("distance_m") * 0.3048, F.lit(1.0)).alias("metres"),
    )


@query("""SELECT id, array_to_string(list_filter([CASE WHEN NOT coalesce(distance_m BETWEEN 2 AND 450, FALSE) THEN 'distance' END,
CASE WHEN NOT coalesce(surface IN ('paved','brick','grass','gravel','dirt'), FALSE) THEN 'surface' END,
CASE WHEN NOT coalesce(abs(slope) <= 0.12, FALSE) THEN 'slope' END, CASE WHEN NOT coalesce(length(name) BETWEEN 1 AND 10, FALSE) THEN 'name' END], lambda x: x IS NOT NULL), ',') AS broken FROM g_edges""")
def edge_violations(g: Graph) -> DataFrame:
    checks = {
        "distance": F.col("distance_m").between(2, 450),
        "surface": F.col("surface").isin("paved", "brick", "grass", "gravel", "dirt"),
        "slope": F.abs("slope") <= 0.12,
        "name": F.length("name").between(1, 10),
    }
    return g.edges.select("id", F.array_join(rules.violations(checks), ",").alias("broken"))


LINE_SQL = """SELECT from_node AS id, list(struct_pack(x := lng1, y := lat1) ORDER BY edge) AS line FROM
(SELECT e.from_node, e.id AS edge, b.longitude AS lng1, b.latitude AS lat1 FROM g_edges e JOIN g_nodes b ON b.id = e.to_node) GROUP BY from_node HAVING count(*) >= 3"""


def lines(g: Graph) -> DataFrame:
    """A polyline for each node: the far ends of its edges, by edge."""
    b = g.nodes.select(F.col("id").alias("to_node"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    rows = g.edges.join(b, "to_node").groupBy("from_node").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("l"))
    rows = rows.where(F.size("l") >= 3)
    return rows.select(F.col("from_node").alias("id"), F.transform("l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


@query(f"""WITH l AS ({LINE_SQL}), v AS (SELECT id, i, line[i].x AS x, line[i].y AS y, line[i + 1].x AS x2, line[i + 1].y AS y2, len(line) AS n FROM (SELECT id, line, unnest(range(1, len(line) + 1)) AS i FROM l))
SELECT id, round(sum(CASE WHEN i < n THEN sqrt(pow((x2 - x) * ({D(111320)} * cos(radians(39.329))), 2) + pow((y2 - y) * {D(110540)}, 2)) ELSE 0 END), 4) AS length_m,
round(sum(x) / max(n), 9) AS cx, round(sum(y) / max(n), 9) AS cy, round(sum(CASE WHEN i < n THEN x * y2 - x2 * y ELSE 0 END) / 2 * 1e6, 3) AS area
FROM v GROUP BY id""")
def line_measures(g: Graph) -> DataFrame:
    c = geo.centroid(F.col("line"))
    return lines(g).select(
        "id",
        close(geo.line_length(F.col("line")), 4).alias("length_m"),
        close(c["x"], 9).alias("cx"),
        close(c["y"], 9).alias("cy"),
        close(geo.signed_area(F.col("line")) * 1e6, 3).alias("area"),
    )


@query(f"""WITH l AS ({LINE_SQL}), s AS (
SELECT l.id, k, n.longitude AS px, n.latitude AS py, line[k].x AS ax, line[k].y AS ay, line[k + 1].x AS bx, line[k + 1].y AS by_
FROM (SELECT id, line, unnest(range(1, len(line))) AS k FROM l) l JOIN g_nodes n ON n.id = l.id),
m AS (SELECT *, (bx - ax) * ({D(111320)} * cos(radians(39.329))) AS dx, (by_ - ay) * {D(110540)} AS dy, (px - ax) * ({D(111320)} * cos(radians(39.329))) AS qx, (py - ay) * {D(110540)} AS qy FROM s),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, (qx * dx + qy * dy) / (dx * dx + dy * dy))) END AS t FROM m)
SELECT id, round(min(sqrt(pow(qx - t * dx, 2) + pow(qy - t * dy, 2))), 4) AS metres FROM t GROUP BY id""")
def node_to_line(g: Graph) -> DataFrame:
    rows = lines(g).join(g.nodes, "id")
    best = geo.nearest_on_line(F.col("longitude"), F.col("latitude"), F.col("line"))
    return rows.select("id", close(best["d"], 4).alias("metres"))


@query("SELECT count(*) AS nodes, (SELECT count(*) FROM g_edges WHERE published) AS edges, (SELECT count(*) FROM g_hazards WHERE active) AS hazards FROM g_nodes")
def health_counts(g: Graph) -> DataFrame:
    one = g.nodes.agg(F.count(F.lit(1)).alias("nodes"))
    two = g.edges.where("published").agg(F.count(F.lit(1)).alias("edges"))
    return one.crossJoin(two).crossJoin(g.hazards.where("active").agg(F.count(F.lit(1)).alias("hazards")))


@query("""SELECT kind, count(*) AS n, count(*) FILTER (WHERE grade = 'FullyCompliant') AS full, count(*) FILTER (WHERE grade IS NULL) AS ungraded,
bool_or(stairs) AS any_stairs, bool_and(published) AS all_published FROM g_edges GROUP BY kind""")
def counts_by_kind(g: Graph) -> DataFrame:
    return g.edges.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("grade") == "FullyCompliant").alias("full"),
        F.count_if(F.col("grade").isNull()).alias("ungraded"),
        F.bool_or("stairs").alias("any_stairs"),
        F.bool_and("published").alias("all_published"),
    )


@query("""SELECT coalesce(surface, 'unknown') AS surface, count(*) FILTER (WHERE kind = 'paved') AS paved, count(*) FILTER (WHERE kind = 'stairs') AS stairs,
count(*) FILTER (WHERE kind = 'shortcut') AS shortcut FROM g_edges GROUP BY 1""")
def surface_by_kind(g: Graph) -> DataFrame:
    rows = g.edges.withColumn("surface", F.coalesce("surface", F.lit("unknown")))
    return rows.groupBy("surface").pivot("kind", ["paved", "stairs", "shortcut"]).count().na.fill(0)


@query("""SELECT id, place_id, label, count(*) OVER (PARTITION BY place_id) AS doors FROM g_doors""")
def doors_per_place(g: Graph) -> DataFrame:
    return g.doors.select("id", "place_id", "label", F.count(F.lit(1)).over(Window.partitionBy("place_id")).alias("doors"))


@query("""SELECT user_id, min(longitude) AS west, max(longitude) AS east, min(latitude) AS south, max(latitude) AS north FROM g_fixes GROUP BY user_id""")
def fix_bounds(g: Graph) -> DataFrame:
    return g.fixes.groupBy("user_id").agg(
        F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.min("latitude").alias("south"), F.max("latitude").alias("north")
    )


@query("""SELECT user_id, id, dense, round(sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY ts, id), 3) AS travelled FROM (
SELECT user_id, id, ts, row_number() OVER w AS dense, sqrt(pow((longitude - lag(longitude) OVER w) * 111320.0::DOUBLE * 0.7735::DOUBLE, 2) + pow((latitude - lag(latitude) OVER w) * 110540.0::DOUBLE, 2)) AS step
FROM g_fixes WINDOW w AS (PARTITION BY user_id ORDER BY ts, id))""")
def travelled(g: Graph) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    step = geo.plane_fixed(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    rows = g.fixes.select("user_id", "id", "ts", F.row_number().over(w).cast("long").alias("dense"), F.coalesce(step, F.lit(0.0)).alias("step"))
    return rows.select("user_id", "id", "dense", close(F.sum("step").over(w), 3).alias("travelled"))


@query("""WITH r AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND name IS NOT DISTINCT FROM lag(name) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh
FROM g_edges WINDOW w AS (PARTITION BY from_node ORDER BY id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY from_node ORDER BY id) AS step FROM r)
SELECT from_node, CAST(step AS BIGINT) AS step, round(sum(distance_m), 6) AS distance_m, min(id) AS edge_id, first(surface ORDER BY id) AS surface,
first(kind) AS kind, CAST(sum(CASE WHEN stairs THEN riser_count ELSE 0 END) AS BIGINT) AS risers, count(*) AS segments FROM s GROUP BY from_node, step""")
def merged_steps(g: Graph) -> DataFrame:
    rows = routing.steps(g.edges, by="from_node", order="id")
    return rows.select(
        "from_node", F.col("step").cast("long"), close("distance_m").alias("distance_m"), "edge_id", "surface", "kind",
        F.col("risers").cast("long"), "segments",
    )


@query("SELECT id, name FROM g_places ORDER BY name LIMIT 6")
def first_places(g: Graph) -> DataFrame:
    return g.places.orderBy("name").limit(6).select("id", "name")


@query("SELECT id, title, severity FROM g_hazards ORDER BY severity DESC, id DESC LIMIT 12")
def worst_hazards(g: Graph) -> DataFrame:
    return g.hazards.orderBy(F.desc("severity"), F.desc("id")).limit(12).select("id", "title", "severity")


@query("SELECT EXISTS (SELECT 1 FROM g_edges WHERE source = 'seed') AS any_seed")
def any_seed_edge(g: Graph) -> DataFrame:
    return g.edges.where("source = 'seed'").limit(1).agg((F.count(F.lit(1)) > 0).alias("any_seed"))


@query("""SELECT node, string_agg(role, '+' ORDER BY role) AS roles FROM (
SELECT from_node AS node, 'from' AS role FROM g_edges UNION SELECT to_node, 'to' FROM g_edges UNION SELECT node_id, 'door' FROM g_doors) GROUP BY node""")
def live_nodes(g: Graph) -> DataFrame:
    part = lambda df, c, role: df.select(F.col(c).alias("node"), F.lit(role).alias("role"))
    rows = part(g.edges, "from_node", "from").unionByName(part(g.edges, "to_node", "to")).unionByName(part(g.doors, "node_id", "door")).distinct()
    return rows.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("role")), "+").alias("roles"))


@query("SELECT from_node AS node FROM g_edges WHERE stairs EXCEPT SELECT to_node FROM g_edges WHERE stairs")
def stairs_only_out(g: Graph) -> DataFrame:
    rows = g.edges.where("stairs")
    return rows.select(F.col("from_node").alias("node")).subtract(rows.select("to_node"))


@query("SELECT from_node AS node FROM g_edges WHERE kind = 'ramp' INTERSECT SELECT to_node FROM g_edges WHERE kind = 'indoor'")
def ramp_meets_indoor(g: Graph) -> DataFrame:
    return g.edges.where("kind = 'ramp'").select(F.col("from_node").alias("node")).intersect(g.edges.where("kind = 'indoor'").select("to_node"))


@query("SELECT from_node, to_node, min(id) AS id FROM g_edges GROUP BY from_node, to_node")
def first_of_pair(g: Graph) -> DataFrame:
    w = Window.partitionBy("from_node", "to_node").orderBy("id")
    return g.edges.withColumn("n", F.row_number().over(w)).where("n = 1").select("from_node", "to_node", "id")


@query("""SELECT from_node, arg_max(id, distance_m) AS longest, arg_min(id, distance_m) AS shortest, max(abs(slope)) AS steepest,
sum(safety * distance_m) / sum(distance_m) FILTER (WHERE safety IS NOT NULL) AS safety FROM g_edges GROUP BY from_node""")
def node_extremes(g: Graph) -> DataFrame:
    d, measured = F.col("distance_m"), F.col("safety").isNotNull()
    return g.edges.groupBy("from_node").agg(
        F.max_by("id", "distance_m").alias("longest"),
        F.min_by("id", "distance_m").alias("shortest"),
        F.max(F.abs("slope")).alias("steepest"),
        F.try_divide(F.sum(F.col("safety") * d), F.sum(F.when(measured, d))).alias("safety"),
    )
