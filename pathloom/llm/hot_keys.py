"""Joins of rows with totals of their keys, where one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many counts as hot; there are fewer hot keys than this, whatever the table.
SHARE = 4096


def with_totals(rows: DataFrame, totals: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the other columns of ``totals``, which has one row for each key (null is a key) and the key's number of rows.

    ``totals`` is best a written table.  Totals of hot keys are broadcast, so that their rows stay where they are; the
    rows of other keys, each a small part of the table, are shuffled.  Without rows there are none.
    """
    match = F.col(key).eqNullSafe(F.col("_key"))
    side = totals.withColumnRenamed(key, "_key").drop(count)
    if totals.limit(SHARE + 1).count() <= SHARE:
        return rows.join(F.broadcast(side), match).drop("_key")
    all_rows = totals.agg(F.sum(count)).first()[0]
    hot = F.broadcast(totals.where(F.col(count) > all_rows / SHARE).withColumnRenamed(key, "_key").drop(count))
    rest = rows.join(hot, match, "left_anti").join(side, match)
    return rows.join(hot, match).unionByName(rest).drop("_key")
