"""Live positions: leaving the route, hazards nearby; in batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.functions import geo
from pathloom.operators.nearest import cell

OFF_ROUTE_M = 60.0


def off_route_flags(fixes: DataFrame, vertices: DataFrame, metres: float = OFF_ROUTE_M) -> DataFrame:
    """Whether each fix (id, user_id, ts, route, latitude, longitude) is farther than ``metres`` from
    every vertex (route, latitude, longitude) of its route.

    A fix meets the vertices of the cells around it as one list, so a long route costs no more, and a fix stays one row.
    """
    degrees = metres / 100000 * 1.5
    ring = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = vertices.select("route", F.col("latitude").alias("v_lat"), F.col("longitude").alias("v_lng")).distinct().select("*", F.explode(ring).alias("i"))
    near = near.select("*", F.explode(ring).alias("j"))
    near = near.select(
        "route", "v_lat", "v_lng", (cell(F.col("v_lat"), degrees) + F.col("i")).alias("cy"), (cell(F.col("v_lng"), degrees) + F.col("j")).alias("cx")
    )
    held = near.groupBy("route", "cy", "cx").agg(F.collect_list(F.struct("v_lat", "v_lng")).alias("held"))
    here = fixes.withColumns({"cy": cell(F.col("latitude"), degrees), "cx": cell(F.col("longitude"), degrees)})
    close = F.exists("held", lambda v: geo.haversine(F.col("latitude"), F.col("longitude"), v["v_lat"], v["v_lng"]) <= metres)
    return here.join(held, ["route", "cy", "cx"], "left").select("id", "user_id", "ts", (~F.coalesce(close, F.lit(False))).alias("off"))


def left_route(flags: DataFrame) -> DataFrame:
    """The fixes at which ``off`` turns true."""
    before = F.lag("off").over(Window.partitionBy("user_id").orderBy("ts", "id"))
    return flags.withColumn("before", before).where(F.col("off") & ~F.coalesce(F.col("before"), F.lit(False))).select("id", "user_id", "ts")


def _edges(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    off = state.get[0] if state.exists else False
    rows = pd.concat(list(frames)).sort_values(["ts", "id"])
    was = [off, *rows["off"].tolist()[:-1]]
    state.update((bool(rows["off"].iloc[-1]),))
    yield rows.loc[rows["off"] & ~pd.Series(was, index=rows.index), ["id", "user_id", "ts"]]


def left_route_stream(flags: DataFrame) -> DataFrame:
    """As ``left_route`` on a stream of flags; the state of a user is one boolean.

    Rows of one micro-batch are put in order; a late row of an earlier batch is taken when
    it comes.
    """
    return flags.groupBy("user_id").applyInPandasWithState(
        _edges, "id long, user_id long, ts timestamp", "off boolean", "append", GroupStateTimeout.NoTimeout
    )


def progress(share: F.Column, steps: F.Column) -> F.Column:
    """Index of the step at a share of the way."""
    return F.least(F.greatest(F.floor(share * steps), F.lit(0)), steps - 1)


def interpolate(a: F.Column, b: F.Column, share: F.Column) -> F.Column:
    return a + (b - a) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
