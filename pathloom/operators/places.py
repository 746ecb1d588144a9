"""Finding places by what people type, and doors for places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import OFFLINE_STOPWORDS, parse_gps, plain, signal_words
from pathloom.operators.text_index import Index, candidates, index


def _pattern(typed: Column) -> Column:
    """What was typed as a LIKE pattern without case: its own wildcards are in force, a backslash is none."""
    return F.replace(F.lower(typed), F.lit("\\"), F.lit("\\\\"))


def _like(text: Column, pattern: Column) -> Column:
    return F.call_function("like", F.lower(text), pattern)


def _best(hits: DataFrame) -> DataFrame:
    """The hits of each query's first tier."""
    first = hits.groupBy("query").agg(F.min("tier").alias("tier"))
    return hits.join(first, ["query", "tier"])


def contains_any(title: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(F.lower(title), p))


def door_card() -> Column:
    """Label, kind and step_free of a door; null for a bare node."""
    return F.when(F.col("kind") != "node", F.struct("label", "kind", "step_free"))


def _searches(asked: DataFrame, parts: Column, *fields: str) -> DataFrame:
    return asked.select("*", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"), parts.alias("parts"))


def resolve(queries: DataFrame, places: DataFrame) -> DataFrame:
    """query, tier, hits and place_id, by normalised text: equal name, equal alias, part of a name, all words of it in a name.

    An equal name or alias takes its first place; else only a single hit is an answer.  Blank values have none.
    """
    asked = queries.select("query", plain(F.col("value")).alias("q")).where("q <> ''")
    texts = index(places, "id", name=plain(F.col("name")), alias=plain(F.col("alias")))
    distinct = asked.select("q").distinct()
    alike = distinct.join(texts.texts.withColumnRenamed("text", "q"), "q").select("q", F.when(F.col("field") == "name", 1).otherwise(2).alias("tier"), "id")
    part = candidates(_searches(distinct, F.array("q"), "name"), texts).where(F.contains("text", "q")).select("q", F.lit(3).alias("tier"), "id")
    words = F.filter(F.split("q", " "), lambda w: ~w.isin(*OFFLINE_STOPWORDS))
    every = candidates(_searches(distinct.withColumn("words", words).where(F.size("words") > 0), F.col("words"), "name"), texts)
    every = every.where(F.forall("words", lambda w: F.contains(F.col("text"), w))).select("q", F.lit(4).alias("tier"), "id")
    hits = alike.unionByName(part).unionByName(every).groupBy("q", "id").agg(F.min("tier").alias("tier"))
    found = _best(asked.join(hits, "q"))
    got = found.groupBy("query", "tier").agg(F.count(F.lit(1)).alias("hits"), F.min("id").alias("first"))
    return got.select("query", "tier", "hits", F.when((F.col("hits") == 1) | (F.col("tier") <= 2), F.col("first")).alias("place_id"))


def find_places(queries: DataFrame, places: DataFrame, among: Index | None = None) -> DataFrame:
    """Candidates of each query (query, value) in its best tier: exact, contained, all words.

    among: the index of the places' lower-cased names and aliases, if the caller keeps one.
    """
    asked = queries.where(F.col("value").isNotNull())
    typed = asked.select("value").distinct().withColumns({"like": _pattern(F.col("value")), "words": signal_words(F.col("value"))})
    texts = among or place_index(places)
    literals = F.filter(F.split(F.lower("value"), "[%_]+"), lambda p: p != "")
    alike = candidates(_searches(typed.drop("words"), literals, "name", "alias"), texts)
    inside = F.concat(F.lit("%"), "like", F.lit("%"))
    alike = alike.withColumn("tier", F.when(_like(F.col("text"), F.col("like")), 1).when(_like(F.col("text"), inside), 2))
    every = candidates(_searches(typed.where(F.size("words") > 0).drop("like"), F.col("words"), "name"), texts)
    every = every.withColumn("tier", F.when(F.forall("words", lambda w: F.contains(F.col("text"), w)), 3))
    same = typed.select("value").join(places.select(F.col("id").cast("string").alias("value"), "id"), "value").withColumn("tier", F.lit(1))
    hits = reduce(DataFrame.unionByName, [h.where(F.col("tier").isNotNull()).select("value", "id", "tier") for h in (alike, every, same)])
    hits = hits.groupBy("value", "id").agg(F.min("tier").alias("tier"))
    return _best(asked.join(hits, "value")).join(places.select("id", "name"), "id").select("query", "tier", "id", "name")


def place_index(places: DataFrame) -> Index:
    return index(places, "id", name=F.lower("name"), alias=F.lower("alias"))


def answers(found: DataFrame) -> DataFrame:
    """One row for each query with a hit: an exact tier takes its first place, one hit is the answer, more are candidates."""
    got = found.groupBy("query").agg(
        F.min("tier").alias("tier"),
        F.count(F.lit(1)).alias("hits"),
        F.min("id").alias("first"),
        F.slice(F.array_sort(F.collect_list("name")), 1, 12).alias("names"),
    )
    one = (F.col("hits") == 1) | (F.col("tier") == 1)
    return got.select(
        "query",
        "tier",
        "hits",
        F.when(one, F.col("first")).alias("place_id"),
        F.when(one, F.array().cast("array<string>")).otherwise(F.col("names")).alias("candidates"),
    )


def first_doors(doors: DataFrame) -> DataFrame:
    """The door at which a place attaches: the first that is step-free, else the first."""
    order = Window.partitionBy("place_id").orderBy(F.desc("step_free"), "id")
    return doors.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def snap(values: DataFrame, nodes: DataFrame, places: DataFrame, doors: DataFrame, nearest) -> DataFrame:
    """Nodes at which each value (query, value) starts: a node id, a position, or a place's doors, in this order."""
    as_node = values.join(nodes.select(F.col("id").cast("string").alias("value"), F.col("id").alias("node")), "value")
    as_node = as_node.select("query", "node", F.lit(0.0).alias("snap_m"), F.lit("node").alias("kind"))
    rest = values.join(as_node.select("query"), "query", "left_anti")
    spots = rest.withColumn("gps", parse_gps(F.col("value"))).where(F.col("gps").isNotNull())
    spots = spots.select(F.col("query").alias("id"), "gps.latitude", "gps.longitude")
    targets = nodes.select(F.col("id").alias("target"), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lng"))
    as_spot = nearest(spots, targets).select(
        F.col("id").alias("query"), F.col("target").alias("node"), F.col("metres").alias("snap_m"), F.lit("node").alias("kind")
    )
    rest = rest.join(spots.select(F.col("id").alias("query")), "query", "left_anti")
    found = answers(find_places(rest, places)).where(F.col("place_id").isNotNull())
    as_place = found.join(doors, "place_id").select("query", F.col("node_id").alias("node"), "snap_m", "kind")
    return as_node.unionByName(as_spot).unionByName(as_place)
