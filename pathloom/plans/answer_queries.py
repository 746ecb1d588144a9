"""Queries for whole answers: verified paths in place of routes, their documents, and recalculation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import shown
from pathloom.operators import answers, lifecycle, routing
from pathloom.plans.graph_queries import ROUTES_SQL as REQUESTED_SQL
from pathloom.plans.graph_queries import VERIFIED_SQL, WRITTEN_SQL, drawn_edges, fold_sql
from pathloom.plans.registry import query
from pathloom.plans.scalar_queries import DIRECTION_SQL, INSTRUCTION_SQL, SPEED_SQL, close
from pathloom.plans.staging import discard, stage
from pathloom.plans.views import Graph

ROUTES_SQL = REQUESTED_SQL.replace("g_requests", "g_asked")
VERIFIED = VERIFIED_SQL.format("g_asked")
ANSWERS_SQL = f"""{ROUTES_SQL}, {VERIFIED},
first AS (SELECT request, min(edge) AS edge, arg_min(backwards, edge) AS backwards FROM ver GROUP BY request),
ans AS (SELECT q.request, q.night, f.edge IS NOT NULL AS surveyed, CASE WHEN f.edge IS NULL THEN best.path ELSE [f.edge] END AS path,
  CASE WHEN f.edge IS NULL THEN best.nodes WHEN f.backwards THEN [e.to_node, e.from_node] ELSE [e.from_node, e.to_node] END AS nodes,
  CASE WHEN f.edge IS NULL THEN best.cost ELSE e.distance_m / {SPEED_SQL} END AS cost
  FROM g_asked q LEFT JOIN first f ON f.request = q.request LEFT JOIN g_edges e ON e.id = f.edge LEFT JOIN best ON best.request = q.request
  WHERE f.edge IS NOT NULL OR best.path IS NOT NULL)"""

A, B = WRITTEN_SQL("m.longitude", "m.latitude"), WRITTEN_SQL("n.longitude", "n.latitude")
MIDDLE = WRITTEN_SQL("((m.longitude + n.longitude) / 2 + 0.0001::DOUBLE)", "((m.latitude + n.latitude) / 2 + 0.0001::DOUBLE)")
HEADING = DIRECTION_SQL.replace("lng1", "m.longitude").replace("lng2", "n.longitude").replace("lat1", "m.latitude").replace("lat2", "n.latitude")


@query(f"""{ANSWERS_SQL},
r AS (SELECT b.request, b.surveyed, b.pos, b.a, b.b, e.* FROM (SELECT request, surveyed, unnest(path) AS edge, generate_subscripts(path, 1) AS pos,
  nodes[pos] AS a, nodes[pos + 1] AS b FROM ans) b JOIN g_edges e ON e.id = b.edge),
su AS (SELECT request, sum(distance_m) AS d, sum(CASE WHEN verified OR surveyed THEN distance_m ELSE 0 END) AS verified_m,
  CASE WHEN bool_or(surveyed) THEN coalesce(nullif(max(safety) * 100, 0), 92) ELSE sum(safety * distance_m) / sum(distance_m) FILTER (WHERE safety IS NOT NULL) * 100 END AS safe,
  CASE WHEN bool_or(surveyed) THEN 100 WHEN count(grade) > 0
  THEN sum(distance_m * CASE grade WHEN 'FullyCompliant' THEN 100 WHEN 'PartiallyCompliant' THEN 70 WHEN 'NonCompliant' THEN 40 ELSE 55 END) / greatest(sum(distance_m), 1)
  ELSE greatest(0, 100 - 35 * count(*) FILTER (WHERE stairs) - sum(CASE WHEN roughness >= 0.4 THEN distance_m ELSE 0 END) / greatest(sum(distance_m), 1) * 30) END AS able,
  sum(CASE WHEN surveyed THEN 0 WHEN slope IS NULL OR safety IS NULL OR surface IS NULL OR roughness IS NULL OR lit IS NULL THEN distance_m ELSE 0 END) AS unknown_m FROM r GROUP BY request),
fr AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND name IS NOT DISTINCT FROM lag(name) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh
  FROM r WINDOW w AS (PARTITION BY request ORDER BY pos)),
st AS (SELECT *, sum(fresh) OVER (PARTITION BY request ORDER BY pos) AS step FROM fr),
gr AS (SELECT request, step, bool_or(surveyed) AS surveyed, first(kind) AS kind, first(name) AS name, sum(CASE WHEN stairs THEN riser_count ELSE 0 END) AS riser_count,
  arg_min(a, pos) AS a, arg_max(b, pos) AS b FROM st GROUP BY request, step),
hd AS (SELECT gr.*, {HEADING} AS heading FROM gr JOIN g_nodes m ON m.id = gr.a JOIN g_nodes n ON n.id = gr.b),
ins AS (SELECT request, count(*) AS steps, string_agg(CASE WHEN surveyed THEN concat('Follow the surveyed path ', heading, ' along ', coalesce(name, 'the path'))
  ELSE {INSTRUCTION_SQL} END, '; ' ORDER BY step) AS instructions FROM hd GROUP BY request),
hz AS (SELECT r.request, string_agg(CAST(z.id AS VARCHAR), ',' ORDER BY z.id) AS hazards FROM r JOIN g_hazards z ON z.edge_id = r.id AND z.active GROUP BY r.request),
dr AS (SELECT r.request, string_agg(concat(CASE WHEN r.id % 3 = 2 THEN concat({MIDDLE}, ',') ELSE '' END, {B}), ',' ORDER BY pos) AS rest FROM r JOIN g_nodes m ON m.id = r.a JOIN g_nodes n ON n.id = r.b GROUP BY r.request)
SELECT CAST(ans.request AS INT) AS request, CASE WHEN ans.surveyed THEN 'verified' ELSE 'route' END AS outcome, ans.nodes[1] AS start_node, ans.nodes[-1] AS end_node,
CAST(len(ans.path) AS INT) AS segments, round(CASE WHEN len(ans.path) > 0 THEN ans.cost END, 6) AS cost, round(d, 6) AS distance_m, round(verified_m, 6) AS verified_m, round(safe, 6) AS safety_score,
round(able, 6) AS accessibility_score, round(unknown_m, 6) AS unknown_m, CAST(coalesce(steps, 0) AS INT) AS steps, coalesce(instructions, '') AS instructions, coalesce(hazards, '') AS hazards,
concat_ws(',', {A}, rest) AS line FROM ans LEFT JOIN su ON su.request = ans.request LEFT JOIN ins ON ins.request = ans.request LEFT JOIN hz ON hz.request = ans.request
LEFT JOIN dr ON dr.request = ans.request JOIN g_nodes m ON m.id = ans.nodes[1]""")
def route_answers(g: Graph) -> DataFrame:
    """The document of every request with a way, its verified path before any search, laid out flat."""
    asked = stage(g.asked, "asked")
    found = stage(answers.answers(g.edges, g.hazards, g.doors, asked), "answers")
    # Only edges of answers are drawn.
    met = stage(g.edges.join(found.select(F.explode("path").alias("id")).distinct(), "id", "left_semi"), "met")
    told = answers.documents(found, asked, drawn_edges(g, met), g.hazards, g.nodes)
    part = lambda x: F.round(x * 100000, 0).cast("long").cast("string")
    listed = lambda c, f, by: F.array_join(F.transform(c, f), by)
    rounded = ("cost", "distance_m", "verified_m", "safety_score", "accessibility_score", "unknown_m")
    return told.select(
        F.col("search").cast("int").alias("request"), "outcome", "start_node", "end_node", F.size("edges").alias("segments"),
        *[close(f"stats.{c}").alias(c) for c in rounded], F.size("steps").alias("steps"),
        listed("steps", lambda x: x["instruction"], "; ").alias("instructions"),
        listed("hazards", lambda x: x["id"].cast("string"), ",").alias("hazards"),
        listed("line", lambda p: F.concat_ws(" ", part(p[0]), part(p[1])), ",").alias("line"),
    )


PRIOR_SQL = f"prior AS ({ANSWERS_SQL} SELECT request, path AS gone FROM ans)"
AGAIN_SQL = ROUTES_SQL.removeprefix("WITH RECURSIVE ").replace(
    "FROM d JOIN arcs a ON a.src = d.node AND",
    "FROM d LEFT JOIN prior ON prior.request = d.request JOIN arcs a ON a.src = d.node AND NOT coalesce(list_contains(prior.gone, a.edge), FALSE) AND",
)


def _joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "-")


@query(f"""WITH RECURSIVE {PRIOR_SQL}, {AGAIN_SQL}, {VERIFIED},
first AS (SELECT ver.request, min(ver.edge) AS edge FROM ver JOIN prior ON prior.request = ver.request WHERE NOT list_contains(prior.gone, ver.edge) GROUP BY ver.request)
SELECT CAST(prior.request AS INT) AS request, array_to_string(prior.gone, '-') AS before,
CASE WHEN first.edge IS NOT NULL THEN 'verified' WHEN best.path IS NOT NULL THEN 'route' ELSE 'none' END AS outcome,
array_to_string(CASE WHEN first.edge IS NOT NULL THEN [first.edge] ELSE best.path END, '-') AS path
FROM prior LEFT JOIN best ON best.request = prior.request LEFT JOIN first ON first.request = prior.request""")
def routes_recalculated(g: Graph) -> DataFrame:
    """Every answered request asked once more, without any edge of its first answer."""
    asked, ways = stage(g.asked, "asked"), routing.network(g.edges, g.hazards)
    before = stage(answers.answers(g.edges, g.hazards, g.doors, asked, ways=ways), "answers")
    after = stage(answers.recalculated(g.edges, g.hazards, g.doors, asked, before, ways=ways), "again")
    discard(ways)
    outcome = F.when(F.col("surveyed"), "verified").when(F.col("surveyed").isNull(), "none").otherwise("route")
    rows = before.select("search", _joined("path").alias("before")).join(after.select("search", "surveyed", _joined("path").alias("path")), "search", "left")
    return rows.select(F.col("search").cast("int").alias("request"), "before", outcome.alias("outcome"), "path")


@query("SELECT id, title, CASE WHEN severity >= 3 THEN 'high' WHEN severity = 2 THEN 'medium' ELSE 'low' END AS severity FROM g_hazards WHERE active")
def hazard_cards(g: Graph) -> DataFrame:
    """Active hazards as they are shown."""
    return g.hazards.where("active").select("id", "title", shown.severity_name(F.col("severity")).alias("severity"))


@query(f"""SELECT submission, CASE WHEN status IN ('pending', 'rejected', 'published') THEN status ELSE 'approved' END AS status,
CAST(CASE job {" ".join(f"WHEN '{k}' THEN {v}" for k, v in shown.PROGRESS.items())} ELSE 0 END AS INT) AS progress,
CASE WHEN job = 'none' THEN NULL WHEN job = 'succeeded' THEN 'complete' WHEN job IN ('published', 'queued') THEN job ELSE 'running' END AS job FROM ({fold_sql()})""")
def submission_cards(g: Graph) -> DataFrame:
    """Submissions and their jobs as they are shown; without a job, none."""
    job = F.nullif("job", F.lit("none"))
    states = lifecycle.fold(g.reviews).withColumn("job", job)
    status = F.when(F.col("job").isNotNull(), shown.job_status(F.col("job")))
    return states.select("submission", shown.submission_status(F.col("status")).alias("status"), shown.job_progress(F.col("job")).alias("progress"), status.alias("job"))
