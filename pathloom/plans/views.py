"""The graph as typed views over relational tables.

One deterministic text, valid in Spark SQL and in DuckDB, adapts the star-schema tables:
customers are nodes, orders are edges, suppliers are places with doors, error events are
hazards, and events are position fixes.  Unmeasured attributes stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = """
SELECT c_custkey AS id, c_name AS name,
       CAST(39.32 AS DOUBLE) + CAST(floor(c_custkey / 40) AS BIGINT) * CAST(0.0005 AS DOUBLE) AS latitude,
       CAST(-76.63 AS DOUBLE) + (c_custkey % 40) * CAST(0.0005 AS DOUBLE) AS longitude
FROM {customer}
"""

EDGES = """
SELECT o_orderkey AS id, o_custkey AS from_node, (o_custkey * 7 + o_orderkey) % n AS to_node,
       o_totalprice / CAST(1000 AS DOUBLE) AS distance_m,
       CASE o_orderkey % 7 WHEN 1 THEN 'paved' WHEN 2 THEN 'brick' WHEN 3 THEN 'grass' WHEN 4 THEN 'gravel'
            WHEN 5 THEN 'dirt' WHEN 6 THEN 'cobble' END AS surface,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS roughness,
       CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 31 - 15 AS DOUBLE) / CAST(100 AS DOUBLE) END AS slope,
       CASE WHEN o_orderkey % 4 <> 0 THEN CAST(50 + o_orderkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE) END AS safety,
       CASE o_orderkey % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS lit,
       o_orderkey % 13 = 0 AS stairs, o_orderkey % 11 = 0 AS curb,
       CASE o_orderkey % 9 WHEN 1 THEN 'FullyCompliant' WHEN 2 THEN 'PartiallyCompliant' WHEN 3 THEN 'NonCompliant'
            WHEN 4 THEN 'Other' END AS grade,
       CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey % 8 AS INT) ELSE 0 END AS riser_count,
       CASE WHEN o_orderkey % 17 = 0 THEN 'shortcut' WHEN o_orderkey % 13 = 0 THEN 'stairs'
            WHEN o_orderkey % 19 = 0 THEN 'ramp' WHEN o_orderkey % 23 = 0 THEN 'indoor' ELSE 'paved' END AS kind,
       CASE o_orderkey % 4 WHEN 0 THEN 'Sidewalk' WHEN 1 THEN 'Crosswalk' WHEN 2 THEN 'North Bridge' END AS name,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('Lawn ', CAST(o_orderkey % 5 AS VARCHAR(8))) END AS space,
       CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 100 END AS from_place,
       CASE WHEN o_orderkey % 16 = 0 THEN (o_orderkey + 37) % 100 END AS to_place,
       o_orderkey % 10 < 3 AS verified,
       CAST(o_orderkey % 20 AS DOUBLE) / CAST(20 AS DOUBLE) AS confidence,
       o_orderkey % 29 = 0 AS closed, o_orderkey % 5 <> 1 AS bidirectional,
       CASE o_orderkey % 25 WHEN 0 THEN 'admin' WHEN 1 THEN 'submission' ELSE 'seed' END AS source,
       o_orderkey % 31 <> 0 AS published
FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {customer}) sizes
"""

PLACES = """
SELECT s_suppkey AS id, s_name AS name,
       CASE WHEN s_suppkey % 3 = 0 THEN concat('Hall ', CAST(s_suppkey % 17 AS VARCHAR(8))) END AS alias,
       CASE s_suppkey % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'garage' WHEN 2 THEN 'lawn' ELSE 'library' END AS category,
       s_acctbal > 5000 AS accessible
FROM {supplier}
"""

DOORS = """
SELECT s_suppkey * 3 + d AS id, s_suppkey AS place_id, (s_suppkey * 13 + d * 101) % n AS node_id,
       concat('Door ', CAST(d AS VARCHAR(8))) AS label,
       CASE d WHEN 2 THEN 'lift' ELSE 'entrance' END AS kind,
       (s_suppkey + d) % 3 = 0 AS step_free, CAST((s_suppkey * 7 + d * 5) % 60 AS DOUBLE) AS snap_m
FROM {supplier} CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2) three
CROSS JOIN (SELECT count(*) AS n FROM {customer}) sizes
WHERE s_suppkey % 7 <> 6 AND d <= s_suppkey % 3
"""

HAZARDS = """
SELECT event_id AS id, concat('Hazard ', CAST(event_id AS VARCHAR(20))) AS title,
       CASE WHEN event_id % 5 <> 0 THEN event_id * 11 % m END AS edge_id,
       CAST(1 + event_id % 3 AS INT) AS severity, event_id % 6 <> 0 AS active,
       CASE event_id % 4 WHEN 0 THEN 'always' WHEN 1 THEN 'day' WHEN 2 THEN 'NIGHT' END AS active_when,
       CAST(39.32 AS DOUBLE) + (event_id % 97) * CAST(0.0002 AS DOUBLE) AS latitude,
       CAST(-76.63 AS DOUBLE) + (event_id % 89) * CAST(0.0002 AS DOUBLE) AS longitude
FROM {events} CROSS JOIN (SELECT count(*) AS m FROM {orders}) sizes
WHERE event_type = 'error'
"""

FIXES = """
SELECT event_id AS id, user_id, ts,
       CAST(39.32 AS DOUBLE) + (event_id * 7 % 113) * CAST(0.00017 AS DOUBLE) AS latitude,
       CAST(-76.63 AS DOUBLE) + (event_id * 5 % 107) * CAST(0.00019 AS DOUBLE) AS longitude
FROM {events}
"""

#: A request for each nation: places by number, all modes, day and night.
REQUESTS = """
SELECT n_nationkey AS request, CAST(n_nationkey * 3 AS BIGINT) % 100 AS start_place,
       CAST(n_nationkey * 7 + 41 AS BIGINT) % 100 AS end_place,
       CASE n_nationkey % 4 WHEN 0 THEN 'walking' WHEN 1 THEN 'wheelchair' WHEN 2 THEN 'scooter' ELSE 'bicycle' END AS mode,
       n_nationkey % 2 = 1 AS night, n_nationkey % 3 <> 0 AS smarter
FROM {nation}
"""

#: The requests, and one for each open path of the survey between two places, every second one against its direction.
ASKED = f"""
{REQUESTS} UNION ALL
SELECT 100 + id AS request, CASE WHEN id % 800 = 0 THEN to_place ELSE from_place END AS start_place,
       CASE WHEN id % 800 = 0 THEN from_place ELSE to_place END AS end_place,
       CASE CAST(floor(id / 400) AS BIGINT) % 4 WHEN 0 THEN 'bicycle' WHEN 1 THEN 'walking' WHEN 2 THEN 'wheelchair' ELSE 'scooter' END AS mode,
       CAST(floor(id / 400) AS BIGINT) % 3 = 1 AS night, id % 5 <> 0 AS smarter
FROM ({EDGES}) paths WHERE source = 'admin' AND published AND NOT closed AND to_place IS NOT NULL
"""

#: Review events of submissions, in order of seq.
REVIEWS = """
SELECT l_orderkey AS submission, l_linenumber AS seq,
       CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'approve' WHEN 1 THEN 'dispatch' WHEN 2 THEN 'inspect'
            WHEN 3 THEN 'succeed' WHEN 4 THEN 'publish' ELSE 'reject' END AS action,
       l_shipdate AS reviewed_at
FROM {lineitem}
"""

VIEWS = {
    "g_nodes": NODES, "g_edges": EDGES, "g_places": PLACES, "g_doors": DOORS,
    "g_hazards": HAZARDS, "g_fixes": FIXES, "g_requests": REQUESTS, "g_asked": ASKED, "g_reviews": REVIEWS,
}
BASE = ("customer", "orders", "supplier", "nation", "events", "lineitem")


class Graph:
    """The views over the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        text = VIEWS[f"g_{name}"]
        used = {b: self.table(b) for b in BASE if "{" + b + "}" in text}
        return self.spark.sql(text, **used)


def with_views(sql: str) -> str:
    """DuckDB text: the views that ``sql`` names, then ``sql`` (which may begin with its own WITH)."""
    named = [v for v in VIEWS if v in sql]
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(**{b: b for b in BASE})})" for v in named)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[4:]}"
    return f"WITH {ctes} {body}"
