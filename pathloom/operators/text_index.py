"""Substring search by posting lists, for many searches against many texts at once.

A text is listed under each of its runs of one to four letters.  A search knows
literal parts that a text must have, so it needs texts that stand in the lists of all their
runs; of these it takes the rarest few lists and counts in how many of them a text stands.  Only texts in all of them
are looked at.  Lists that many texts stand in, such as those of a word that all names share, are read
only by searches that have nothing rarer, whose results are then as many.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.plans.staging import discard, stage

#: Letters in the longest run that is listed, and lists that a search reads.
LONGEST, RAREST = 4, 2


class Index(NamedTuple):
    """texts: field, id, text.  lists: field, gram, id, each once.  sizes: field, gram, texts."""

    texts: DataFrame
    lists: DataFrame
    sizes: DataFrame

    def discard(self) -> None:
        discard(self.lists, self.sizes)


def _runs(text: Column, length: int) -> Column:
    last = F.length(text) - (length - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(length)))).otherwise(
        F.array().cast("array<string>")
    )


def index(rows: DataFrame, id: str, **fields: Column) -> Index:
    """Lists of the texts that ``fields`` name; null texts stand in none.  Every text stands in the list of the empty run."""
    texts = reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("field"), F.col(id).alias("id"), text.alias("text")) for name, text in fields.items()])
    texts = texts.where(F.col("text").isNotNull())
    runs = F.concat(F.array(F.lit("")), *[_runs(F.col("text"), n) for n in range(1, LONGEST + 1)])
    lists = stage(texts.select("field", F.explode(F.array_distinct(runs)).alias("gram"), "id"), "lists")
    return Index(texts, lists, stage(lists.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("texts")), "list-sizes"))


def needed(parts: Column) -> Column:
    """The longest runs that a text with all these parts must have; the empty run if there are no parts."""
    runs = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) < LONGEST, F.array(p)).otherwise(_runs(p, LONGEST))))
    return F.when(F.size(runs) > 0, F.array_distinct(runs)).otherwise(F.array(F.lit("")))


def candidates(searches: DataFrame, among: Index) -> DataFrame:
    """The columns of ``searches`` with ``id`` and ``text`` of each text in all the lists that a search reads.

    searches: field, parts (literals that the text must have) and others, which must tell the searches apart.
    """
    keys = [c for c in searches.columns if c != "parts"]
    runs = searches.select(*keys, F.explode(needed(F.col("parts"))).alias("gram")).join(among.sizes, ["field", "gram"], "left")
    rare = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram"))).alias("runs"))
    # A run that no text has ends the search.
    rare = rare.where(F.col("runs")[0]["texts"] > 0).select(*keys, F.slice("runs", 1, RAREST).alias("runs"))
    met = rare.select(*keys, F.size("runs").alias("_lists"), F.explode(F.col("runs.gram")).alias("gram")).join(among.lists, ["field", "gram"])
    found = met.groupBy(*keys, "_lists", "id").agg(F.count(F.lit(1)).alias("_in")).where("_in = _lists").drop("_in", "_lists")
    return found.join(among.texts, ["field", "id"])
