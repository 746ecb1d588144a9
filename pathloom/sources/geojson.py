"""GeoJSON and seed files as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "array<double>"
LINE = "array<array<double>>"
POLYGON = "array<array<array<double>>>"
MULTI_POLYGON = "array<array<array<array<double>>>>"
#: How deep the coordinates of each type nest.
NESTING = {
    "Point": POINT, "MultiPoint": LINE, "LineString": LINE, "MultiLineString": POLYGON, "Polygon": POLYGON,
    "MultiPolygon": MULTI_POLYGON,
}


def read_features(spark: SparkSession, path: str, properties: str = "map<string,string>") -> DataFrame:
    """type, coordinates (as JSON text, since its nesting differs) and properties of each feature."""
    schema = T.StructType(
        [T.StructField("features", T.ArrayType(T.StructType([
            T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
            T.StructField("properties", T._parse_datatype_string(properties)),
        ])))]
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.geometry.type", "f.geometry.coordinates", "f.properties")


def parts(kind: Column, coordinates: Column) -> Column:
    """All lines, or outer rings, of a geometry as arrays of (x, y); holes are ignored."""
    line = lambda points: F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    parsed = lambda t: F.from_json(coordinates, NESTING[t])
    return (
        F.when(kind == "Point", F.array(line(F.array(parsed("Point")))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(line(parsed("LineString"))))
        .when(kind == "MultiLineString", F.transform(parsed("MultiLineString"), line))
        .when(kind == "Polygon", F.array(line(F.get(parsed("Polygon"), F.lit(0)))))
        .when(kind == "MultiPolygon", F.transform(parsed("MultiPolygon"), lambda r: line(F.get(r, F.lit(0)))))
    )


def read_seed(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Rows of a JSON seed file; fields outside the schema are dropped, absent ones are null."""
    if key is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    rows = spark.read.schema(f"`{key}` array<struct<{_fields(schema)}>>").option("multiLine", True).json(path)
    return rows.select(F.inline(key))


def _fields(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


def write_layers(rows: DataFrame, path: str, layer: str = "layer") -> None:
    """A folder for each layer, and an index of counts by geometry type."""
    rows.write.mode("overwrite").partitionBy(layer).json(f"{path}/layers")
    rows.groupBy(layer).pivot("type").count().na.fill(0).write.mode("overwrite").json(f"{path}/index")


def load_once(rows: DataFrame, path: str) -> None:
    """Writes rows where the table does not exist yet."""
    rows.write.mode("ignore").parquet(path)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, with null for the columns that one lacks."""
    return old.unionByName(new, allowMissingColumns=True)


def dictionary(fields: DataFrame) -> DataFrame:
    """One row for each coded value of a field catalogue (name, type, domain array of (code, name))."""
    return fields.select("name", "type", F.explode_outer("domain").alias("d")).select(
        "name", "type", "d.code", F.concat_ws("=", "d.code", "d.name").alias("label")
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def catalogue(layers: DataFrame) -> DataFrame:
    """The layers (id, parent, title, group) of a service that hold features, with the titles of the groups above them.

    Each step climbs one level for all layers; a service nests a few levels deep.
    """
    up = layers.select(F.col("id").alias("above"), F.col("parent").alias("next"), F.col("title").alias("name"))
    rows = layers.where("NOT group").select("id", F.col("parent").alias("above"), F.array("title").alias("path"))
    while rows.where(F.col("above").isNotNull()).limit(1).count():
        rows = rows.join(up, "above", "left").select(
            "id", F.col("next").alias("above"), F.when(F.col("name").isNotNull(), F.concat(F.array("name"), "path")).otherwise(F.col("path")).alias("path")
        )
    return rows.select("id", "path")
