"""Edits as an event log: ordered folds and latest-wins tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geo import nearest_on_line

# What an action does to (submission status, job status); '*' leaves it, absent pairs are refused.
TRANSITIONS = {
    ("approve", "pending", "none"): ("approved", "queued"),
    ("reject", "pending", "*"): ("rejected", "*"),
    ("reject", "approved", "*"): ("rejected", "*"),
    ("dispatch", "*", "queued"): ("*", "dispatched"),
    ("inspect", "*", "dispatched"): ("*", "inspecting"),
    ("succeed", "*", "inspecting"): ("verified", "succeeded"),
    ("fail", "*", "inspecting"): ("rejected", "failed"),
    ("publish", "verified", "*"): ("published", "*"),
}


def _step(state: Column, action: Column) -> Column:
    status, job = state["status"], state["job"]
    out = F.struct(status.alias("status"), job.alias("job"), (state["refused"] + 1).alias("refused"))
    for (what, s, j), (new_s, new_j) in reversed(TRANSITIONS.items()):
        fits = action == what
        fits = fits & (status == s) if s != "*" else fits
        fits = fits & (job == j) if j != "*" else fits
        to = F.struct(
            (status if new_s == "*" else F.lit(new_s)).alias("status"),
            (job if new_j == "*" else F.lit(new_j)).alias("job"),
            state["refused"].alias("refused"),
        )
        out = F.when(fits, to).otherwise(out)
    return out


def fold(events: DataFrame, key: str = "submission", order: str = "seq", action: str = "action") -> DataFrame:
    """Status, job and number of refused actions of each submission after its events, in order.

    A submission has a handful of events by nature; they are sorted and folded in one row.
    """
    start = F.struct(F.lit("pending").alias("status"), F.lit("none").alias("job"), F.lit(0).alias("refused"))
    lists = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, action))).alias("log"))
    return lists.select(key, F.aggregate("log", start, lambda s, e: _step(s, e[action])).alias("s")).select(key, "s.*")


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a row with ``deleted`` true is a tombstone."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    rows = log.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return rows.where(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted") if "deleted" in log.columns else rows


def evidence(paths: Column) -> Column:
    """Distinct evidence in first-seen order, the last kept."""
    return F.slice(F.array_distinct(paths), -1, 1)


def without_path(paths: DataFrame, hazards: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (id) and hazards (edge_id) after some paths (id) are deleted: their hazards go with them."""
    return paths.join(deleted, "id", "left_anti"), hazards.join(deleted.select(F.col("id").alias("edge_id")), "edge_id", "left_anti").select(*hazards.columns)


def placed_hazards(asked: DataFrame, paths: DataFrame, metres: float = 40.0) -> DataFrame:
    """Hazards (id, edge_id, x, y, update) on a path's line (edge_id, line): new ones snap to it or are refused when too far; moved ones beyond keep their own point."""
    met = asked.join(paths, "edge_id", "left").withColumn("at", nearest_on_line(F.col("x"), F.col("y"), F.col("line")))
    close = F.coalesce(F.col("at.d") <= metres, F.lit(False))
    return met.select(
        "id",
        "edge_id",
        (~close & ~F.col("update")).alias("refused"),
        F.when(close, F.col("at.x")).otherwise(F.col("x")).alias("x"),
        F.when(close, F.col("at.y")).otherwise(F.col("y")).alias("y"),
    )
