"""Geometry, text, rules, edits and live positions on small inputs."""

import math
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import geo, rules, text
from pathloom.functions.text import STOPWORDS
from pathloom.operators import etl, lifecycle, places, text_index
from pathloom.operators.nearest import nearest
from pathloom.streaming import live

nearest_module = sys.modules[nearest.__module__]

SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
RING = "array<struct<x:double,y:double>>"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ring(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_polygon(spark):
    r = one(
        spark,
        inside=geo.in_ring(F.lit(1.0), F.lit(1.0), ring(SQUARE)),
        outside=geo.in_ring(F.lit(3.0), F.lit(1.0), ring(SQUARE)),
        area=geo.signed_area(ring([*SQUARE, SQUARE[0]])),
        centre=geo.centroid(ring([*SQUARE, SQUARE[0]])),
        single=geo.line_length(ring([(1, 1)])),
    )
    assert r.inside and not r.outside and r.area == 4 and r.single == 0
    assert r.centre.x == pytest.approx(0.8)


def test_nearest_on_line_takes_the_first_of_equals(spark):
    r = one(spark, n=geo.nearest_on_line(F.lit(1.0), F.lit(1.0), ring([(0, 0), (2, 0), (0, 0)])))
    assert r.n.k == 0 and r.n.x == pytest.approx(1.0) and r.n.y == 0


def test_haversine_and_turn(spark):
    r = one(spark, d=geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), t=geo.turn(F.lit(350.0), F.lit(10.0)))
    assert r.d == pytest.approx(math.pi / 180 * geo.EARTH_M) and r.t == 20


def test_lambert_origin(spark):
    foot = 1200 / 3937
    r = one(spark, p=geo.lambert_inverse(F.lit(400000 / foot), F.lit(0.0)))
    assert r.p.lng == pytest.approx(-77.0) and r.p.lat == pytest.approx(37 + 2 / 3, abs=1e-9)


@pytest.mark.parametrize(
    "value,expected",
    [("39.3,-76.6", (39.3, -76.6)), ("-76.6, 39.3", (39.3, -76.6)), ("120,10", (10, 120)), ("nowhere", None), ("39.3, -76.6, 12", (39.3, -76.6))],
)
def test_parse_gps(spark, value, expected):
    got = one(spark, p=text.parse_gps(F.lit(value))).p
    assert (got and (got.latitude, got.longitude)) == expected


def test_keys_and_labels(spark):
    r = one(
        spark,
        k=text.node_key(F.lit(-76.62088), F.lit(39.3265)),
        w=text.worded_key(F.lit(39.32), F.lit(-76.62)),
        s=text.slug(F.lit(" The Hall (North) ")),
        a=text.distance_label(F.lit(1234.0)),
        b=text.distance_label(F.lit(12.5)),
        n=text.accessibility(F.lit("Non-Compliant")),
    )
    assert (r.k, r.w, r.s, r.a, r.b, r.n) == ("n-7662088_3932650", "n39p32_m76p62", "the-hall-north", "1.2 km", "13 m", "NonCompliant")


def test_rules(spark):
    line = F.array(F.array(F.lit(91.0), F.lit(0.0)))
    r = one(spark, v=rules.violations(rules.geometry_rules(line)), n=rules.violations({"x": F.lit(None).cast("boolean")}))
    assert r.v == ["two_points", "latitude"] and r.n == ["x"]
    r = one(spark, p=rules.image_kind(F.unhex(F.lit("89504E470D0A1A0A00"))), q=rules.image_kind(F.unhex(F.lit("FFD8FFE0"))), z=rules.image_kind(F.unhex(F.lit("00"))))
    assert (r.p, r.q, r.z) == ("png", "jpeg", None)


def test_nearest_far_and_tied(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 0.0, 0.0005)], "id long, latitude double, longitude double")
    targets = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.0, 0.001), (9, 0.0, 0.0)], "target long, t_lat double, t_lng double")
    got = {r.id: r.target for r in nearest(points, targets).collect()}
    assert got[1] == 7 and got[3] in (7, 8) and got[2] in (7, 8, 9)
    assert nearest(points.limit(0), targets).count() == 0


@pytest.mark.parametrize("kind", ["outliers", "crowded", "line", "one"])
def test_nearest_looks_at_few_pairs(spark, monkeypatch, kind):
    """Against all pairs; far points, crowded cells, equal positions, and how many cells and targets are looked at."""
    rng = np.random.default_rng(3)
    spots = rng.normal([39.3, -76.6], 0.05, (3000, 2))
    points = rng.normal([39.3, -76.6], 0.06, (400, 2))
    if kind == "outliers":
        points[:150] += rng.uniform(-30, 30, (150, 2))
    if kind == "crowded":
        spots[:2000] = [39.3, -76.6] + rng.normal(0, 2e-5, (2000, 2))
        points[:200] = [39.3, -76.6] + rng.normal(0, 3e-5, (200, 2))
        spots[2000:2300], points[200:250] = spots[0], spots[0]
    if kind == "line":
        spots[:, 1] = -76.6
    if kind == "one":
        spots, points = spots[:1], points[:50]
    targets = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(spots)] + [(9999, None, 1.0)], "target long, t_lat double, t_lng double")
    asked = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(points)] + [(9999, None, 1.0)], "id long, latitude double, longitude double")
    looked, plain = [], nearest_module.stage
    monkeypatch.setattr(nearest_module, "stage", lambda df, label: looked.append((label, plain(df, label))) or looked[-1][1])
    got = {r.id: (r.target, r.metres) for r in nearest(asked, targets).collect()}
    d = np.hypot((points[:, None, 0] - spots[None, :, 0]) * 110540.0, (points[:, None, 1] - spots[None, :, 1]) * 111320.0 * 0.7735)
    assert len(got) == len(points)
    for k, row in enumerate(d):
        assert got[k][1] == pytest.approx(row.min(), rel=1e-9) and row[got[k][0]] <= row.min() * (1 + 1e-9)
        assert kind != "crowded" or not 200 <= k < 250 or got[k][0] == 0
    pairs = sum(t.count() for label, t in looked if label == "pairs")
    assert pairs < 60 * len(points)
    near = {r.id for r in nearest(asked, targets, most=400.0).collect()}
    assert near == {k for k, row in enumerate(d) if row.min() <= 400}


def test_place_tiers(spark):
    table = spark.createDataFrame(
        [("a1", "Malone Hall", None), ("b1", "San Martin Garage", "parking"), ("c1", "North Garage", None)], "id string, name string, alias string"
    )
    asked = spark.createDataFrame([(0, "malone hall"), (1, "malone"), (2, "the garage"), (3, "xyzzy"), (4, "PARKING"), (5, "the garage san")], "query int, value string")
    got = {r["query"]: r for r in places.answers(places.find_places(asked, table)).collect()}
    assert got[0].place_id == "a1" and got[1].place_id == "a1" and got[4].place_id == "b1" and got[5].place_id == "b1"
    assert got[2].place_id is None and got[2].candidates == ["North Garage", "San Martin Garage"] and 3 not in got


@pytest.mark.parametrize(
    "actions,expected",
    [
        ("approve dispatch inspect succeed publish", ("published", "succeeded", 0)),
        ("approve reject dispatch inspect succeed", ("verified", "succeeded", 0)),
        ("publish approve approve", ("approved", "queued", 2)),
        ("approve dispatch inspect fail", ("rejected", "failed", 0)),
    ],
)
def test_fold(spark, actions, expected):
    log = spark.createDataFrame([(1, k, a) for k, a in enumerate(actions.split())], "submission long, seq int, action string")
    r = lifecycle.fold(log).first()
    assert (r.status, r.job, r.refused) == expected


def test_latest_and_evidence(spark):
    log = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "k int, seq int, deleted boolean")
    assert [r.k for r in lifecycle.latest(log, "k", ["seq"]).collect()] == [2]
    assert one(spark, e=lifecycle.evidence(F.array(F.lit("a"), F.lit("b"), F.lit("a")))).e == ["b"]


def test_segments_skip_equal_ends_and_turn(spark):
    rows = spark.createDataFrame(
        [(1, [(0.0, 0.0), (0.0, 0.0), (0.001, 0.0)], 1), (2, [(0.0, 0.0), (0.001, 0.0)], 3)], f"id long, line {RING}, direction int"
    )
    got = {r.edge: (r.from_node, r.to_node) for r in etl.segments(rows).collect()}
    assert got == {"e-1-1": ("n0_0", "n100_0"), "e-2-0": ("n100_0", "n0_0")}


def test_shortcut_avoids_buildings(spark):
    d = 0.0005
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, d, 0.0), (3, 0.0, d)], "id long, x double, y double")
    lawn = spark.createDataFrame([(0, [(0.0, 0.0), (d, 0.0), (d, d), (0.0, d)])], f"zone int, ring {RING}")
    block = spark.createDataFrame([(9, [(d * 0.4, d * 0.4), (d * 0.6, d * 0.4), (d * 0.6, d * 0.6), (d * 0.4, d * 0.6)])], f"zone int, ring {RING}")
    free = etl.shortcuts(nodes, lawn, block.limit(0), share=0.0).collect()
    assert {(r.from_node, r.to_node) for r in free} == {(1, 2), (1, 3), (2, 3)}
    kept = etl.shortcuts(nodes, lawn, block, share=0.0).collect()
    assert {(r.from_node, r.to_node) for r in kept} == {(1, 2), (1, 3)}


def test_shortcut_is_looked_at_two_metres_apart_or_more(spark):
    # 17 m make eight parts; the lawn holds the first seven of nine points, where nine parts would give eight of ten.
    up = 17.0 / 110540.0
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, up)], "id long, x double, y double")
    w, top = 0.00005, up * 0.83
    lawn = spark.createDataFrame([(0, [(-w, -w), (w, -w), (w, top), (-w, top)])], f"zone int, ring {RING}")
    assert etl.shortcuts(nodes, lawn, lawn.limit(0), share=0.79).count() == 0
    assert [(r.from_node, r.to_node) for r in etl.shortcuts(nodes, lawn, lawn.limit(0), share=0.77).collect()] == [(1, 2)]


def test_doors_go_to_buildings(spark):
    d = 0.0001
    buildings = spark.createDataFrame([(1, "Gilman Hall", [(0.0, 0.0), (d, 0.0), (d, d), (0.0, d)]), (2, "Brody", [(3 * d, 0.0), (4 * d, 0.0), (4 * d, d), (3 * d, d)])], f"zone int, title string, ring {RING}")
    doors = spark.createDataFrame([(1, d / 2, -d / 20, "Gilman Hall west"), (2, 3.5 * d, d / 2, "unnamed"), (3, 7 * d, d / 2, "Brody door"), (4, 1.0, 1.0, "far")], "id long, x double, y double, name string")
    got = {r.id: (r.zone, r.tier) for r in etl.door_buildings(doors, buildings).collect()}
    assert got[1] == (1, 1) and got[2] == (2, 4) and got.get(3) == (2, 1) and 4 not in got


def test_left_route_stream_matches_batch(spark, tmp_path):
    rows = [(k, 1 + k % 2, f"2024-01-01 00:00:{k:02d}", k % 5 in (1, 2)) for k in range(30)]
    flags = spark.createDataFrame(rows, "id long, user_id long, ts string, off boolean").withColumn("ts", F.to_timestamp("ts"))
    for n, low in enumerate((0, 10, 20)):
        flags.where((F.col("id") >= low) & (F.col("id") < low + 10)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(flags.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.left_route_stream(stream).writeStream.format("memory").queryName("left").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r.id for r in spark.table("left").collect()} == {r.id for r in live.left_route(flags).collect()}


def test_hazards_on_a_path_and_its_deletion(spark):
    paths = spark.createDataFrame([("p", [(0.0, 0.0), (0.001, 0.0)])], f"edge_id string, line {RING}")
    asked = spark.createDataFrame([(1, "p", 0.0005, 0.0001, False), (2, "p", 0.0005, 0.001, False), (3, "p", 0.0005, 0.001, True)], "id int, edge_id string, x double, y double, update boolean")
    got = {r.id: (r.refused, round(r.y, 6)) for r in lifecycle.placed_hazards(asked, paths).collect()}
    assert got == {1: (False, 0.0), 2: (True, 0.001), 3: (False, 0.001)}
    kept, left = lifecycle.without_path(paths.select(F.col("edge_id").alias("id")), asked, spark.createDataFrame([("p",)], "id string"))
    assert kept.count() == 0 and left.count() == 0


def test_large_and_small_zones_meet_the_same_points(spark):
    zones = spark.createDataFrame([(1, [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)]), (2, [(0.0, 0.0), (0.001, 0.0), (0.0, 0.001)])], f"zone int, ring {RING}")
    points = spark.createDataFrame([(1, 0.0001, 0.0001), (2, 20.0, -30.0), (3, 60.0, 0.0)], "id int, x double, y double")
    assert sorted((r.id, r.zone) for r in etl.containing(points, zones).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_typed_values_meet_places_through_lists(spark):
    """Wildcards, backslashes, parts of one letter, repeated and blank values, against a plain LIKE of every pair."""
    r = random.Random(6)
    names = [" ".join(r.choice(["Malone", "Hall", "Ann_x", "100%", "B\\c", "çé", "a", "North"]) for _ in range(r.randint(1, 3))) for _ in range(60)]
    rows = [(k, None if k == 9 else n, r.choice([None, "", "MH", "a_b"])) for k, n in enumerate(names)]
    values = ["malone hall", "%", "_", "", "a", "ha", "ann_x", "100%", "b\\c", "%nor%hall", "ÇÉ", "7", "the malone centre", "zz", "m_", "north malone", None, "malone hall"]
    table = spark.createDataFrame(rows, "id int, name string, alias string")
    asked = spark.createDataFrame(list(enumerate(values)), "query int, value string")

    def like(text, pattern):
        parts = {"%": ".*", "_": "."}
        return text is not None and re.fullmatch("".join(parts.get(c) or re.escape(c) for c in pattern.lower()), text.lower(), re.S) is not None

    def tier(value, row):
        words = [w for w in re.split("[^A-Za-z0-9]+", value.lower()) if len(w) > 2 and w not in STOPWORDS]
        if str(row[0]) == value or like(row[1], value) or like(row[2], value):
            return 1
        if like(row[1], f"%{value}%") or like(row[2], f"%{value}%"):
            return 2
        return 3 if words and row[1] and all(w in row[1].lower() for w in words) else None

    want = []
    for q, value in enumerate(values):
        tiers = {row[0]: tier(value, row) for row in rows if value is not None}
        best = min((t for t in tiers.values() if t), default=None)
        want += [(q, t, i) for i, t in tiers.items() if t == best and best]
    got = [(x.query, x.tier, x.id) for x in places.find_places(asked, table).collect()]
    assert sorted(got) == sorted(want)


def test_searches_look_at_few_places(spark):
    """Ten thousand values against a hundred thousand places whose names have most of their letters in common."""
    table = spark.range(100_000).select("id", F.format_string("Faculty Building %06d North", F.col("id")).alias("name"), F.lit(None).cast("string").alias("alias"))
    asked = spark.range(10_000).select(F.col("id").alias("query"), F.format_string("building %06d", F.col("id") * 7).alias("value"))
    among = places.place_index(table)
    searches = asked.select("value", F.lit("name").alias("field"), F.array("value").alias("parts"))
    looked, right = text_index.candidates(searches, among).agg(F.count("id"), F.count_if(F.contains("text", "value"))).first()
    assert right == 10_000 and looked < 3 * 10_000
    among.discard()


def test_drawn_lines_beyond_the_region_are_turned(spark):
    """North of 41 degrees only the edge's own ends show which number is the latitude."""
    rows = [(1, "[[45.0,-76.5],[45.1,-76.6]]"), (2, "[[-76.5,45.0],[-76.6,45.1]]"), (3, "[[39.0,-76.5],[39.1,-76.6]]")]
    line = geo.edge_line(F.col("geometry"), F.lit(False), F.lit(-76.5), F.lit(45.0), F.lit(-76.6), F.lit(45.1))
    got = {r.id: r.line for r in spark.createDataFrame(rows, "id int, geometry string").select("id", line.alias("line")).collect()}
    assert got[1] == got[2] == [[-76.5, 45.0], [-76.6, 45.1]] and got[3] == [[-76.5, 39.0], [-76.6, 39.1]]


def test_pairs_within_come_out_of_lists_and_are_not_shuffled(spark, monkeypatch):
    """Many points and targets of the same place: positions are measured once, and every pair is told."""
    monkeypatch.setattr(nearest_module, "LISTED", 7)
    points = spark.range(300).select("id", (F.lit(39.32) + (F.col("id") % 3) * 0.0002).alias("latitude"), F.lit(-76.63).alias("longitude"))
    targets = spark.range(200).select(F.col("id").alias("hazard"), (F.lit(39.32) + (F.col("id") % 2) * 0.0002).alias("t_lat"), F.lit(-76.63).alias("t_lng"))
    rows = nearest_module.within(points, targets, 30.0, degrees=0.001, digits=4)
    got = rows.select("id", "hazard", "metres").collect()
    want = {(p, t) for p in range(300) for t in range(200) if abs(p % 3 - t % 2) <= 1}
    assert len(got) == len(want) and {(r.id, r.hazard) for r in got} == want and {r.metres for r in got} == {0.0, 22.108}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join")


@pytest.fixture
def as_at_size(spark):
    """Sixteen parts, and no join that is broadcast because its test is small."""
    asked = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("full", "listed"), [(1 << 20, 256), (5, 3)])
def test_pairs_within_are_each_told_once(spark, monkeypatch, as_at_size, full, listed):
    """Across the edges of cells, from cells dealt to several tasks, equal rows and missing positions too, against every pair."""
    monkeypatch.setattr(nearest_module, "FULL", full)
    monkeypatch.setattr(nearest_module, "LISTED", listed)
    r = random.Random(4)
    place = lambda: (39.32 + r.randrange(12) * 0.00025, -76.63 + r.choice([0, 0, r.randrange(12)]) * 0.00025)
    points = [(k, *place()) for k in range(150)] + [(7, 39.32, -76.63)] * 3 + [(900, None, -76.63)]
    targets = [(k, *place()) for k in range(90)] + [(5, 39.32, -76.63)] * 2 + [(901, 39.32, None)]
    near = nearest_module.within(
        spark.createDataFrame(points, "id long, latitude double, longitude double"), spark.createDataFrame(targets, "hazard long, t_lat double, t_lng double"), 45.0, degrees=0.001, digits=4
    )
    metres = lambda a, b: math.hypot((b[2] - a[2]) * 111320.0 * 0.7735, (b[1] - a[1]) * 110540.0)
    want = [(a[0], b[0], round(metres(a, b), 4)) for a in points for b in targets if None not in a + b and metres(a, b) <= 45]
    assert sorted((x.id, x.hazard, x.metres) for x in near.collect()) == sorted(want) and len(want) > 1000


def test_pairs_of_a_crowded_place_are_dealt_and_small_on_disk(spark, as_at_size, tmp_path):
    """One position with many points, and many targets around it: several tasks tell the pairs, whose files take little."""
    points = spark.createDataFrame([(k, 39.3201, -76.6299) for k in range(400)], "id long, latitude double, longitude double")
    targets = spark.range(4500).select(
        (F.col("id") * 7919 % 1000003).alias("hazard"), (F.lit(39.32) + F.col("id") % 3 * 0.0001).alias("t_lat"), (F.lit(-76.63) + F.floor(F.col("id") / 3) % 3 * 0.0001).alias("t_lng")
    )
    rows = nearest_module.within(points, targets, 45.0, degrees=0.001, digits=4).select("id", "hazard", "metres")
    told = [x["count"] for x in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(told) == 400 * 4500 and len(told) >= 6 and max(told) <= 400 * 4500 * 0.4
    rows.write.parquet(f"{tmp_path}/pairs")
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 400 * 4500 * 0.7


def test_fixes_meet_their_route_as_one_row(spark):
    fixes = spark.createDataFrame([(1, 1, 5, 0, 39.32, -76.63), (2, 1, 6, 0, 39.33, -76.63), (3, 1, 7, 1, 39.32, -76.63)], "id long, user_id long, ts long, route long, latitude double, longitude double")
    vertices = spark.createDataFrame([(0, 39.3201 + k * 1e-6, -76.63) for k in range(50)] * 2, "route long, latitude double, longitude double")
    flags = live.off_route_flags(fixes, vertices, 60.0)
    assert {r.id: r.off for r in flags.collect()} == {1: False, 2: True, 3: True}
    # One join: no list of pairs is made that would have to be brought back to its fixes.
    assert flags._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
