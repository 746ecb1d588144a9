"""Costs, searches, steps and summaries on a small graph."""

import heapq
import math
import random
import sys

import pytest
from pyspark.sql import functions as F

from pathloom.functions import cost as C
from pathloom.operators import routing
from pathloom.operators.components import connected_components
from pathloom.operators.shortest_paths import cheapest_paths, cheapest_target, corridor

components_module = sys.modules[connected_components.__module__]

EDGE = (
    "id long, from_node long, to_node long, distance_m double, surface string, roughness double, slope double, safety double, "
    "lit boolean, stairs boolean, curb boolean, grade string, riser_count int, kind string, name string, space string, "
    "verified boolean, confidence double, closed boolean, bidirectional boolean, source string, published boolean"
)


def edge(id, a, b, d, **more):
    base = dict(
        surface=None, roughness=None, slope=None, safety=None, lit=None, stairs=False, curb=False, grade=None, riser_count=0,
        kind="paved", name=None, space=None, verified=False, confidence=0.7, closed=False, bidirectional=True, source="seed",
        published=True,
    ) | more
    return (id, a, b, float(d), *base.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def cost_of(spark, mode, night=False, severity=0, **more):
    row = frame(spark, [edge(1, 1, 2, 100, **more)])
    got = row.select(C.blocked(F.lit(mode)).alias("b"), C.edge_cost(F.lit(mode), F.lit(night), F.lit(severity)).alias("c")).first()
    return math.inf if got.b else got.c


@pytest.mark.parametrize("mode,speed", C.SPEED.items())
def test_unmeasured_edge_costs_its_time(spark, mode, speed):
    assert cost_of(spark, mode) == 100 / speed
    assert cost_of(spark, mode, night=True) == 100 / speed


@pytest.mark.parametrize(
    "mode,more,factor",
    [
        ("walking", {"surface": "grass"}, 1.25),
        ("walking", {"surface": "cobble"}, 1.4),
        ("wheelchair", {"roughness": 0.4}, 2.0),
        ("walking", {"slope": -0.3}, 1.0),
        ("wheelchair", {"slope": 0.05}, 1.4),
        ("walking", {"safety": 0.5}, 1.4),
        ("wheelchair", {"grade": "NonCompliant"}, 8.0),
        ("wheelchair", {"grade": "Other"}, 1.0),
        ("walking", {"verified": True}, 0.96),
        ("walking", {"verified": True, "source": "admin"}, 0.82),
        ("walking", {"confidence": 0.2}, 1.04),
    ],
)
def test_factors(spark, mode, more, factor):
    assert cost_of(spark, mode, **more) == pytest.approx(100 / C.SPEED[mode] * factor, rel=1e-12)


def test_night_and_hazards(spark):
    assert cost_of(spark, "walking", night=True, lit=False) == pytest.approx(100 / 1.35 * 1.7)
    assert cost_of(spark, "walking", night=True, lit=None) == 100 / 1.35
    assert cost_of(spark, "walking", severity=2) == pytest.approx(100 / 1.35 * 1.3)


@pytest.mark.parametrize(
    "mode,more,gated",
    [
        ("walking", {"closed": True}, True), ("walking", {"published": False}, True), ("walking", {"stairs": True}, False),
        ("wheelchair", {"stairs": True}, True), ("wheelchair", {"curb": True}, True), ("wheelchair", {"slope": -0.11}, True),
        ("wheelchair", {"slope": None}, False), ("bicycle", {"stairs": True}, True), ("scooter", {"surface": "dirt"}, True),
        ("scooter", {"surface": None}, False),
    ],
)
def test_gates(spark, mode, more, gated):
    assert (cost_of(spark, mode, **more) == math.inf) == gated


def dijkstra(arcs, sources):
    best = dict.fromkeys(sources, 0.0)
    queue = [(0.0, s) for s in sources]
    while queue:
        c, u = heapq.heappop(queue)
        if c > best[u]:
            continue
        for a, b, w in arcs:
            if a == u and c + w < best.get(b, math.inf):
                best[b] = c + w
                heapq.heappush(queue, (c + w, b))
    return best


def test_cheapest_paths_match_dijkstra(spark):
    arcs = [(k, (k * 7 + j * 11) % 40, 1.0 + (k * 13 + j * 5) % 17) for k in range(40) for j in range(3)]
    table = spark.createDataFrame([("p", a, b, i, w) for i, (a, b, w) in enumerate(arcs)], "profile string, src int, dst int, edge long, cost double")
    starts = spark.createDataFrame([(0, "p", 3), (0, "p", 9), (1, "p", 20)], "search int, profile string, node int")
    got = cheapest_paths(table, starts, with_path=True).collect()
    for search, sources in ((0, [3, 9]), (1, [20])):
        assert {r.node: r.cost for r in got if r.search == search} == dijkstra(arcs, sources)
    for r in got:
        assert sum(arcs[e][2] for e in r.path) == pytest.approx(r.cost)
        assert all(arcs[x][1] == arcs[y][0] for x, y in zip(r.path, r.path[1:], strict=False))
    ends = spark.createDataFrame([(0, 30), (0, 31), (1, 5)], "search int, node int")
    first = {r.search: r.cost for r in cheapest_target(cheapest_paths(table, starts, ends), ends).collect()}
    assert first[0] == min(dijkstra(arcs, [3, 9])[n] for n in (30, 31))


def ties(n=40, seed=8):
    """Arcs of few lengths, some of nought, so that many ways cost the same."""
    r = random.Random(seed)
    return [("p", r.randrange(n), r.randrange(n), k, r.choice([0.0, 1.0, 1.0, 2.0])) for k in range(6 * n)]


def test_ways_are_those_of_a_search_in_order(spark):
    """Of equal ways that through the node settled first, by the smallest edge; whatever the order of rows, with arcs that cost nothing."""
    arcs = ties()
    avoid = [(1, k) for k in range(0, 240, 3)]
    starts = spark.createDataFrame([(0, "p", 0), (1, "p", 0)], "search int, profile string, node long")
    shut = spark.createDataFrame(avoid, "search int, edge long")
    got = []
    for parts in (1, 5):
        table = spark.createDataFrame(random.Random(parts).sample(arcs, len(arcs)), "profile string, src long, dst long, edge long, cost double").repartition(parts)
        rows = cheapest_paths(table, starts, avoid=shut, with_path=True).collect()
        got.append(sorted((r.search, r.node, r.cost, tuple(r.path)) for r in rows))
    assert got[0] == got[1]
    for search in (0, 1):
        banned = {k for s, k in avoid if s == search}
        cost, queue = {}, [(0.0, 0)]
        while queue:
            c, node = heapq.heappop(queue)
            if node not in cost:
                cost[node] = c
                for _, src, dst, edge, step in arcs:
                    if src == node and edge not in banned:
                        heapq.heappush(queue, (c + step, dst))
        found = {node: (c, path) for s, node, c, path in got[0] if s == search}
        assert {n: c for n, (c, _) in found.items()} == cost
        by_edge = {edge: (src, dst, step) for _, src, dst, edge, step in arcs}
        for node, (c, path) in found.items():
            assert not banned & set(path) and sum(by_edge[e][2] for e in path) == c
            at = node
            for edge in reversed(path):
                src, dst, step = by_edge[edge]
                assert dst == at
                tight = [(cost[s], s, e) for _, s, d, e, w in arcs if d == at and e not in banned and s in cost and cost[s] + w == cost[at] and cost[s] < cost[at]]
                assert not tight or (cost[src], src, edge) == min(tight)
                at = src
            assert at == 0


def test_searches_without_targets_are_not_run(spark):
    table = spark.createDataFrame(ties(), "profile string, src long, dst long, edge long, cost double")
    starts = spark.createDataFrame([(0, "p", 0), (1, "p", 0)], "search int, profile string, node long")
    ends = spark.createDataFrame([(1, 5)], "search int, node long")
    assert {r.search for r in cheapest_paths(table, starts, ends).collect()} == {1}


def test_start_is_end(spark):
    arcs = spark.createDataFrame([("p", 1, 2, 1, 5.0)], "profile string, src int, dst int, edge long, cost double")
    start = spark.createDataFrame([(0, "p", 1)], "search int, profile string, node int")
    end = spark.createDataFrame([(0, 1)], "search int, node int")
    row = cheapest_target(cheapest_paths(arcs, start, end, with_path=True), end).first()
    assert row.cost == 0 and row.path == []


def test_one_way_and_shortcuts(spark):
    edges = frame(spark, [edge(1, 1, 2, 10, bidirectional=False), edge(2, 2, 3, 10, kind="shortcut"), edge(3, 3, 4, 10, closed=True)])
    assert routing.arcs(edges).count() == 5
    asked = spark.createDataFrame([("walking", False, True), ("wheelchair", False, True)], "mode string, night boolean, smarter boolean")
    no_hazards = spark.createDataFrame([], "id long, edge_id long, severity int, active boolean, active_when string")
    priced = routing.priced_edges(edges, no_hazards, routing.profiles(asked)).select("id", "mode").collect()
    assert sorted((r.id, r.mode) for r in priced) == [(1, "walking"), (1, "wheelchair"), (2, "walking")]


def test_step_free_doors_are_a_preference(spark):
    doors = spark.createDataFrame(
        [(1, 1, 10, "a", "entrance", False, 0.0), (2, 1, 11, "b", "lift", True, 0.0), (3, 2, 12, "c", "entrance", False, 0.0)],
        "id long, place_id long, node_id long, label string, kind string, step_free boolean, snap_m double",
    )
    asked = spark.createDataFrame(
        [(0, 1, "wheelchair", False, True), (1, 2, "wheelchair", False, True), (2, 1, "walking", False, True)],
        "request int, start_place long, mode string, night boolean, smarter boolean",
    )
    got = sorted((r.search, r.node) for r in routing.terminals(asked, doors, "start_place").collect())
    assert got == [(0, 11), (1, 12), (2, 10), (2, 11)]


def test_steps_merge_runs_and_null_names(spark):
    names = ["a", "a", None, None, "a", "a"]
    kinds = ["paved", "paved", "paved", "paved", "paved", "stairs"]
    rows = [edge(i, i, i + 1, 10, name=n, kind=k, stairs=k == "stairs", riser_count=3) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]
    df = frame(spark, rows).withColumns({"search": F.lit(0), "pos": F.col("id")})
    got = [(r.step, r.segments, r.name, r.risers) for r in routing.steps(df).orderBy("step").collect()]
    assert got == [(1, 2, "a", 0), (2, 2, None, 0), (3, 1, "a", 0), (4, 1, "a", 3)]


def test_summary_discloses_unknowns(spark):
    rows = [edge(1, 1, 2, 30, safety=0.5, lit=False), edge(2, 2, 3, 10, slope=-0.2, safety=0.9, surface="paved", roughness=0.5, lit=True, verified=True)]
    df = frame(spark, rows).withColumns({"search": F.lit(0), "total": F.lit(1.0)})
    s = routing.summary(df).first()
    assert (s.distance_m, s.unknown_m, s.unlit_m, s.rough_m, s.verified_percent) == (40, 30, 30, 10, 25)
    assert s.safety_score == pytest.approx((0.5 * 30 + 0.9 * 10) / 40 * 100)
    assert s.accessibility_score == pytest.approx(100 - 10 / 40 * 30) and s.max_abs_slope == 0.2


@pytest.mark.parametrize("kind,most", [("chain", 8), ("star", 4), ("cliques", 4)])
def test_contraction_writes_few_rows(spark, monkeypatch, kind, most):
    """Edges and groups of all rounds, as a multiple of the edges in both directions."""
    if kind == "chain":
        pairs, want = [(k, k + 1) for k in range(3000)], {0}
    elif kind == "star":
        pairs, want = [(2999, k) for k in range(2999)], {0}
    else:
        pairs, want = [(c * 20 + a, c * 20 + b) for c in range(20) for a in range(20) for b in range(a)], {c * 20 for c in range(20)}
    written, plain = [], components_module.stage
    monkeypatch.setattr(components_module, "stage", lambda df, label: written.append((out := plain(df, label)).count()) or out)
    got = connected_components(spark.createDataFrame(random.Random(1).sample(pairs, len(pairs)), "src long, dst long")).collect()
    assert {r.component for r in got} == want and len(got) == len({n for p in pairs for n in p})
    assert all(r.component == (0 if len(want) == 1 else r.node // 20 * 20) for r in got)
    assert sum(written) < most * 2 * len(pairs)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1)] + [(100 + k, 101 + k) for k in range(40)], "src int, dst int")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got[5] == 2 and got[9] == 8 and got[7] == 7 and got[140] == 100 and 1 not in got


def test_instruction(spark):
    row = spark.range(1).select(
        routing.instruction(F.lit("paved"), F.lit("Sidewalk"), F.lit("north"), F.lit(0)).alias("a"),
        routing.instruction(F.lit("stairs"), F.lit(None).cast("string"), F.lit("south"), F.lit(4)).alias("b"),
        routing.instruction(F.lit("paved"), F.lit(None).cast("string"), F.lit("west"), F.lit(0)).alias("c"),
        routing.direction(F.lit(0.0), F.lit(0.0)).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("Head north along the sidewalk", "Take the steps south (4 steps)", "Head west", "south")


def test_corridor_holds_all_cheapest_ways_and_few_nodes(spark):
    """Searches among the arcs of the corridor are those among all arcs, ties and avoided edges included; a closed end stops the search at once."""
    r = random.Random(3)
    arcs = ties() + [("p", 100 + k, 100 + r.randrange(2000), 1000 + 20 * k + j, r.choice([1.0, 2.0, 3.0, 5.0])) for k in range(2000) for j in range(4)]
    table = spark.createDataFrame(arcs, "profile string, src long, dst long, edge long, cost double")
    starts = spark.createDataFrame([(0, "p", 0), (1, "p", 3), (2, "p", 100), (2, "p", 101), (3, "p", 100), (4, "p", 7)], "search int, profile string, node long")
    ends = spark.createDataFrame([(0, 30), (0, 31), (1, 5), (2, 1500), (3, 30), (4, 7)], "search int, node long")
    avoid = spark.createDataFrame([(s, k) for s in (0, 1, 2) for k in range(s, 9000, 3)], "search int, edge long")
    lean, served = corridor(table, starts, ends, avoid)
    assert {r.search for r in served.collect()} == {0, 1, 2, 4}
    whole = cheapest_target(cheapest_paths(table, starts, ends, avoid, with_path=True), ends)
    some = cheapest_target(cheapest_paths(lean, starts, ends, avoid, with_path=True), ends)
    rows = lambda df: sorted((r.search, r.node, r.cost, tuple(r.path)) for r in df.collect())
    assert rows(some) == rows(whole) and len(rows(some)) == 4
    # Of 2,000 nodes that search 2 might come by, its balls settle a part.
    assert lean.where("src >= 100").select("src").distinct().count() < 1000


def test_price_is_worked_out_once_for_both_directions(spark):
    edges = frame(spark, [edge(1, 1, 2, 10), edge(2, 2, 3, 10, bidirectional=False), edge(3, 3, 4, 10, bidirectional=None)])
    ways = routing.arcs(edges)
    assert sorted((r.id, r.src, r.dst, r.reversed) for r in ways.collect()) == [(1, 1, 2, False), (1, 2, 1, True), (2, 2, 3, False), (3, 3, 4, False)]
    assert "Union" not in ways._jdf.queryExecution().optimizedPlan().toString()
