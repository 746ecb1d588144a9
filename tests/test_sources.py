"""Sources and sinks."""

import json
import sqlite3
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pathloom.sources import geojson, tiles
from pathloom.sources import paged as paged_module
from pathloom.sources.paged import PagedSource, split_service

TABLE = [{"oid": k, "name": f"n{k}", "kind": ["a", "b", None, "it's"][k % 4], "size": k / 2, "spare": 1} for k in range(40) if k % 7]


def fake_service(url, query):
    """A service over ``TABLE`` that cuts pages after four rows (ten at ``silent``), says so unless it is ``silent``, and loses its end at ``short``."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (oid, name, kind, size, spare)")
    con.executemany("INSERT INTO t VALUES (:oid, :name, :kind, :size, 1)", TABLE)
    con.row_factory = sqlite3.Row
    where = f"({query['where']})".replace("DATE '", "'")
    if "returnCountOnly" in query:
        return {"count": con.execute(f"SELECT count(*) FROM t WHERE {where}").fetchone()[0]}
    if "returnIdRange" in query:
        return dict(con.execute(f"SELECT min(oid) AS min, max(oid) AS max FROM t WHERE {where}").fetchone())
    if "fromId" in query:
        where += f" AND {query['idColumn']} >= {query['fromId']} AND {query['idColumn']} < {query['toId']}"
    rows = [dict(r) for r in con.execute(f"SELECT {query['outFields']} FROM t WHERE {where} ORDER BY oid")]
    if "fromId" not in query:
        rows = rows[query["resultOffset"] :][: query["resultRecordCount"]]
    if url == "short":
        rows = rows if query.get("resultOffset", 0) < 8 else []
    most = 10 if url == "silent" else 4
    answer = {"features": [{"attributes": r} for r in rows[:most]]}
    return answer | ({"exceededTransferLimit": True} if len(rows) > most and url != "silent" else {})


def paged(spark, url="x", **options):
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").schema("oid int, name string, kind string, size double").options(
        **{"url": url, "transport": "tests.test_sources:fake_service", "pageSize": "6", "partitionRows": "15"} | options
    ).load()


@pytest.mark.parametrize("by", [{}, {"idColumn": "oid"}])
def test_paged(spark, by):
    assert sorted(r.oid for r in paged(spark, **by).collect()) == [r["oid"] for r in TABLE]
    assert [r.name for r in paged(spark, **by).select("name").where("oid = 8").collect()] == ["n8"]
    assert paged(spark, **by).where("oid > 5000").count() == 0
    assert split_service("http://h/rest/Layer/3") == ("http://h/rest/Layer", "3")


def test_short_pages_are_no_silent_loss(spark):
    """By ids a page that is cut without a word, by offsets one that is empty before the end."""
    for url, more in (("silent", {"idColumn": "oid", "pageSize": "50", "partitionRows": "100"}), ("short", {})):
        with pytest.raises(Exception, match="the service"):
            paged(spark, url, **more).collect()


@pytest.mark.parametrize(
    "text",
    ["kind = 'a'", "kind <> 'a'", "NOT (kind <=> 'a')", "kind IN ('a', 'it''s')", "kind NOT IN ('a')", "kind IS NULL", "kind IS NOT NULL AND size >= 3.5", "size < 2", "kind > 'a'", "oid = 3 OR oid = 4", "size = double('nan')"],
)
def test_filters_mean_the_same_at_the_service(spark, text):
    plain = spark.createDataFrame([(r["oid"], r["name"], r["kind"], r["size"]) for r in TABLE], "oid int, name string, kind string, size double")
    assert sorted(map(str, paged(spark).where(text).collect())) == sorted(map(str, plain.where(text).collect()))


def test_wider_condition(spark):
    """A condition that no row meets gives way to a wider one; filters do not set that off."""
    assert paged(spark, where="kind = 'none' AND size > 1", orWhere="size > 10").count() == sum(r["size"] > 10 for r in TABLE)
    assert paged(spark, where="kind = 'a'", orWhere="1=1").where("oid = 2").count() == 0


def test_literals():
    assert [paged_module.literal(v) for v in ("it's", 3, 2.5, Decimal("1.10"), date(2024, 2, 29))] == ["'it''s'", "3", "2.5", "1.10", "DATE '2024-02-29'"]
    assert [paged_module.literal(v) for v in (True, None, float("nan"), float("inf"), datetime(2024, 1, 1))] == [None] * 5


def test_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"layer": "p"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]]}, "properties": {"layer": "q"}},
    ]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = geojson.read_features(spark, f"file://{tmp_path}/f.json")
    got = {r.type: r.parts for r in df.select("type", geojson.parts(F.col("type"), F.col("coordinates")).alias("parts")).collect()}
    assert got["Point"][0][0].x == 1 and len(got["MultiPolygon"]) == 2 and got["MultiPolygon"][1][0].y == 5
    geojson.write_layers(df.withColumn("layer", F.col("properties.layer")), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/index").count() == 2


def test_seed(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"items": [{"id": "a", "n": 1, "odd": 5}, {"id": "b"}]}))
    rows = geojson.read_seed(spark, f"file://{tmp_path}/s.json", "id string, n int", "items").collect()
    assert [(r.id, r.n) for r in rows] == [("a", 1), ("b", None)]
    once = spark.createDataFrame([(1,)], "x int")
    geojson.load_once(once, f"file://{tmp_path}/t")
    geojson.load_once(once.union(once), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 1
    assert geojson.merged(once, once.withColumn("y", F.lit(2))).where("y IS NULL").count() == 1


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def message(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def test_tiles(spark):
    zig = lambda n: varint((n << 1) ^ (n >> 63))
    geometry = varint(9) + zig(2) + zig(3) + varint(18) + zig(5) + zig(0) + zig(0) + zig(-4) + varint(15)
    feature = message(2, varint(0) + varint(0)) + varint(3 << 3) + varint(3) + message(4, geometry)
    layer = message(1, b"grass") + message(2, feature) + message(3, b"class") + message(4, message(1, b"lawn")) + varint(5 << 3) + varint(512)
    table = spark.createDataFrame([(6, 1, 2, bytearray(message(3, layer))), (6, 1, 3, None)], "z int, x int, y int, content binary")
    row = tiles.features(table).withColumn("g", tiles.geometry_kind(F.col("kind"), F.col("parts"))).collect()
    assert len(row) == 1 and row[0].layer == "grass" and row[0].extent == 512 and row[0].properties == {"class": "lawn"} and row[0].g == "Polygon"
    assert [(p.x, p.y) for p in row[0].parts[0]] == [(2, 3), (7, 3), (7, -1), (2, 3)]
    assert tiles.grid(spark, 6, 0, 2, 5, 6).count() == 6


def test_broken_tiles_are_read_as_far_as_they_go(spark):
    good = message(3, message(1, b"ok") + message(2, message(4, varint(9) + varint(2) + varint(2)) + varint(3 << 3) + varint(1)))
    odd_tags = message(3, message(1, b"odd") + message(2, message(2, varint(0) + varint(9) + varint(0))) + message(3, b"k"))
    bad_text = message(3, message(1, b"\xff") + message(2, b""))
    for data, names in ((good + b"\x1a\xff", ["ok"]), (odd_tags, ["odd"]), (bad_text, ["\ufffd"]), (b"\xff" * 40, []), (b"\x0f", []), (good[:3], [])):
        assert [f[0] for f in tiles.decode(data)] == names
    value = lambda n, v: tiles._shown(v if n is None else varint(n << 3) + varint(v))
    assert (value(4, (1 << 64) - 1), value(5, 7), value(6, 3), value(7, 1), tiles._shown(message(1, b"x")), tiles._shown(b"")) == ("-1", "7", "-2", "true", "x", None)


def test_tile_positions_and_distinct_shapes(spark):
    rows = spark.createDataFrame([(6, 1, 2, "l", "Point", 512, [[(0, 0)]]), (6, 2, 2, "l", "Point", 512, [[(-512, 0)]])], "z int, x int, y int, layer string, kind string, extent int, parts array<array<struct<x:int,y:int>>>")
    c = F.col
    placed = rows.withColumn("positions", tiles.positions(c("parts"), c("z"), c("x"), c("y"), c("extent"), origin=(1_400_000.0, 700_000.0), tile_ft=64_000.0))
    assert len({str(r.positions) for r in placed.collect()}) == 1
    one = tiles.distinct_shapes(placed).collect()
    assert len(one) == 1 and one[0].x == 1 and 38 < one[0].positions[0][0].lat < 41


def test_catalogue_and_csv(spark, tmp_path):
    layers = spark.createDataFrame([(0, None, "All", True), (1, 0, "Inner", True), (2, 1, "Doors", False), (3, None, "Paths", False)], "id int, parent int, title string, group boolean")
    found = geojson.catalogue(layers)
    assert {r.id: r.path for r in found.collect()} == {2: ["All", "Inner", "Doors"], 3: ["Paths"]}
    geojson.write_csv(found.select("id"), f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 2
