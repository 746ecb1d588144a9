"""Answers with verified paths, drawn lines, documents and recalculation on a small graph."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom.operators import answers, routing

#: id, from, to, kind, source, verified, from_place, to_place, distance, bidirectional, closed, geometry
EDGES = [
    (1, 1, 2, "paved", "seed", True, None, None, 100.0, True, False, None),
    (2, 2, 3, "paved", "seed", False, None, None, 100.0, True, False, "[[39.1, -76.9], [39.15, -76.95], [39.2, -76.8]]"),
    (3, 1, 3, "stairs", "admin", True, 10, 30, 500.0, True, False, "[[39.0, -76.5], [39.2, -76.7]]"),
    (4, 3, 1, "paved", "admin", True, 30, 10, 900.0, True, True, None),
]


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame(
        [
            (i, a, b, d, "paved", 0.1, 0.02, None if i == 3 else 0.9, True, kind == "stairs", False, "FullyCompliant", 7 if kind == "stairs" else 0, kind, f"Way {i}", None, fp, tp, v, 0.9, closed, two, source, True, geometry)
            for i, a, b, kind, source, v, fp, tp, d, two, closed, geometry in EDGES
        ],
        "id long, from_node long, to_node long, distance_m double, surface string, roughness double, slope double, safety double, lit boolean, stairs boolean, curb boolean, grade string, riser_count int, kind string, name string, space string, from_place long, to_place long, verified boolean, confidence double, closed boolean, bidirectional boolean, source string, published boolean, geometry string",
    )
    nodes = spark.createDataFrame([(1, 39.0, -76.5), (2, 39.1, -76.9), (3, 39.2, -76.8)], "id long, latitude double, longitude double")
    doors = spark.createDataFrame([(1, 10, 1, True), (2, 20, 2, True), (3, 30, 3, True)], "id long, place_id long, node_id long, step_free boolean")
    hazards = spark.createDataFrame(
        [(7, "ice", 3, 2, True, "night", 39.0, -76.5), (8, "old", 3, 3, False, "always", 39.0, -76.5)],
        "id long, title string, edge_id long, severity int, active boolean, active_when string, latitude double, longitude double",
    )
    asked = [(0, 10, 30, "wheelchair"), (1, 30, 10, "walking"), (2, 10, 20, "walking"), (3, 20, 30, "bicycle"), (4, 20, 20, "walking")]
    requests = spark.createDataFrame([(*r, False, False) for r in asked], "request long, start_place long, end_place long, mode string, night boolean, smarter boolean")
    return edges, hazards, doors, requests, nodes


def test_verified_paths_go_first_in_their_direction(graph):
    edges, hazards, doors, requests, _ = graph
    got = {r.search: r for r in answers.answers(edges, hazards, doors, requests).collect()}
    assert got[0].surveyed and got[0].path == [3] and got[0].nodes == [1, 3] and got[0].node == 3 and got[0].cost == pytest.approx(500 / 1.05)
    assert got[1].surveyed and got[1].path == [3] and got[1].nodes == [3, 1]
    assert not got[2].surveyed and got[2].path == [1] and got[3].path == [2]
    assert got[4].path == [] and got[4].nodes == [2]


def test_avoided_verified_path_is_searched_for(spark, graph):
    edges, hazards, doors, requests, _ = graph
    avoid = spark.createDataFrame([(0, 3)], "search long, edge long")
    got = {r.search: r for r in answers.answers(edges, hazards, doors, requests, avoid).collect()}
    assert not got[0].surveyed and got[0].path == [1, 2] and got[1].surveyed


def test_recalculation_leaves_the_former_answer(spark, graph):
    edges, hazards, doors, requests, _ = graph
    before = answers.answers(edges, hazards, doors, requests)
    got = {r.search: r.path for r in answers.recalculated(edges, hazards, doors, requests, before).collect()}
    # Request 2 has only the way by the stairs and back left, request 3 may not take them by bicycle.
    assert got == {0: [1, 2], 1: [2, 1], 2: [3, 2], 4: []}
    avoid = spark.createDataFrame([(0, 2)], "search long, edge long")
    assert 0 not in {r.search for r in answers.recalculated(edges, hazards, doors, requests, before, avoid).collect()}


def test_documents(spark, graph):
    edges, hazards, doors, requests, nodes = graph
    avoid = spark.createDataFrame([(1, 3)], "search long, edge long")
    found = answers.answers(edges, hazards, doors, requests, avoid)
    told = {r.search: json.loads(r.document) for r in answers.as_json(answers.documents(found, requests, edges, hazards, nodes)).collect()}
    first = told[0]
    assert first["outcome"] == "verified" and first["mode"] == "wheelchair" and first["edges"] == [3] and [h["id"] for h in first["hazards"]] == [7]
    assert first["stats"]["safety_score"] == 92 and first["stats"]["accessibility_score"] == 100 and first["stats"]["stairs_count"] == 1 and first["stats"]["verified_percent"] == 100
    assert [s["instruction"] for s in first["steps"]] == ["Follow the surveyed path west along Way 3"] and first["steps"][0]["risers"] == 7
    assert first["line"] == [[-76.5, 39.0], [-76.7, 39.2]]
    # Backwards along the drawing of edge 2, its joint with edge 1 once.
    assert told[1]["line"] == [[-76.8, 39.2], [-76.95, 39.15], [-76.9, 39.1], [-76.5, 39.0]] and told[1]["stats"]["verified_percent"] == 50
    assert [s["edge_id"] for s in told[1]["steps"]] == [2, 1] and told[1]["hazards"] == []
    assert told[4]["line"] == [[-76.9, 39.1]] and told[4]["steps"] == [] and "stats" not in told[4]


def test_many_requests_for_a_pair_of_places_meet_few_paths(spark, graph, monkeypatch):
    """Requests of one pair of places look at as many of its paths as they avoid, and one more; the paths are found once."""
    edges, hazards, doors, *_ = graph
    k = F.col("n.id")
    same = edges.where("id = 3").drop("id").crossJoin(spark.range(10, 310).alias("n")).select(k.alias("id"), *[c for c in edges.columns if c != "id"])
    asked = spark.range(400).select(F.col("id").alias("request"), F.when(F.col("id") % 2 == 0, 10).otherwise(30).alias("start_place"), F.when(F.col("id") % 2 == 0, 30).otherwise(10).alias("end_place"))
    avoid = spark.createDataFrame([(0, 10), (0, 11), (1, 10), (2, 12), *[(4, e) for e in range(10, 310)]], "search long, edge long")
    written, plain = [], answers.stage
    monkeypatch.setattr(answers, "stage", lambda df, label: written.append((out := plain(df, label)).count()) or out)
    got = {r.search: (r.edge, r.backwards) for r in answers.first_verified(asked, doors, same, avoid).collect()}
    assert 4 not in got and len(got) == 399
    assert got[0] == (12, False) and got[1] == (11, True) and got[2] == (10, False) and got[3] == (10, True)
    assert sum(written) == 2 * 300 + 304
    pairs = routing.verified_routes(asked, doors, same)
    assert pairs.count() == pairs.distinct().count() == 400 * 300 and pairs.where("backwards").count() == 200 * 300


def test_verified_routes_shuffle_requests_and_not_their_rows(spark, graph):
    edges, _, doors, *_ = graph
    asked = spark.range(50).select(F.col("id").alias("request"), F.lit(10).alias("start_place"), F.lit(30).alias("end_place"))
    plan = routing.verified_routes(asked, doors, edges)._jdf.queryExecution().optimizedPlan().toString()
    # The rows come out of the lists after the last shuffle.
    assert plan.index("Generate inline") < plan.index("Join") and not plan.lstrip().startswith("Aggregate")


def test_arcs_are_written_once_for_all_profiles(graph, monkeypatch):
    """Modes and times of day read one table of arcs and price what they meet; former code wrote every arc for every profile."""
    edges, hazards, doors, requests, _ = graph
    written, plain = {}, routing.stage

    def counted(df, label):
        out = plain(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(routing, "stage", counted)
    found = {r.search: r.path for r in routing.routes(edges, hazards, doors, requests).collect()}
    # Three ways, each in both directions, and the closed one; wheelchairs have no stairs and nobody a closed way.
    assert found == {0: [1, 2], 1: [2, 1], 2: [1], 3: [2], 4: []}
    assert written["profiles"] == 3 and written["network"] == 8


def test_documents_read_all_edges_and_nodes_once(spark, graph, tmp_path):
    """The parts of a document come from the answers' own edges; former code read all edges anew for each part."""
    edges, hazards, doors, requests, nodes = graph
    edges.write.parquet(f"{tmp_path}/all_edges")
    nodes.write.parquet(f"{tmp_path}/all_nodes")
    edges, nodes = spark.read.parquet(f"{tmp_path}/all_edges"), spark.read.parquet(f"{tmp_path}/all_nodes")
    found = answers.stage(answers.answers(edges, hazards, doors, requests), "answers")
    told = answers.documents(found, requests, edges, hazards, nodes)
    assert told.count() == 5 and not [f for f in told.inputFiles() if "/all_edges/" in f or "/all_nodes/" in f]


def test_recalculation_searches_the_arcs_of_the_first_answers(spark, graph, monkeypatch):
    """Both searches read one written table of arcs; former code joined, priced and wrote all of them twice."""
    edges, hazards, doors, requests, _ = graph
    ways = routing.network(edges, hazards)
    before = spark.createDataFrame([(2, [1])], "search long, path array<long>")

    class Met(Exception):
        pass

    def met(arcs, *_):
        raise Met(arcs)

    monkeypatch.setattr(routing, "corridor", met)
    monkeypatch.setattr(routing, "network", None)
    with pytest.raises(Met) as told:
        answers.recalculated(edges, hazards, doors, requests, before, ways=ways)
    assert told.value.args[0] is ways
