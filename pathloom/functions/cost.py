"""What an edge costs by mode, time of day and hazards: one column expression.

A null attribute was never measured; its factor is skipped, so unknown is neither good nor
bad.  The factors are multiplied in one fixed order, which keeps results bit-identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres a second, surface and grade factors by mode.
SPEED = {"walking": 1.35, "wheelchair": 1.05, "scooter": 3.8, "bicycle": 4.5}
SURFACE = {
    "walking": {"paved": 1.0, "brick": 1.08, "grass": 1.25, "gravel": 1.25, "dirt": 1.4},
    "wheelchair": {"paved": 1.0, "brick": 1.3, "grass": 3.0, "gravel": 2.2, "dirt": 3.0},
    "scooter": {"paved": 1.0, "brick": 1.45, "grass": 3.5, "gravel": 2.5, "dirt": 3.5},
    "bicycle": {"paved": 1.0, "brick": 1.2, "grass": 1.8, "gravel": 1.45, "dirt": 1.8},
}
GRADE = {
    "wheelchair": {"NonCompliant": 8.0, "PartiallyCompliant": 1.5},
    "scooter": {"NonCompliant": 4.0, "PartiallyCompliant": 1.3},
    "bicycle": {"NonCompliant": 1.5, "PartiallyCompliant": 1.1},
    "walking": {"NonCompliant": 1.0, "PartiallyCompliant": 1.0},
}
UNLISTED_SURFACE = 1.4
STEEP = 0.10


def _lookup(table: dict[str, dict[str, float]], mode: Column, key: Column) -> Column:
    pairs = [F.lit(x) for m, row in table.items() for k, v in row.items() for x in (f"{m}/{k}", v)]
    return F.create_map(*pairs)[F.concat(mode, F.lit("/"), key)]


def speed(mode: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SPEED.items() for x in pair])[mode]


def blocked(mode: Column) -> Column:
    """Hard gates.  A null never gates."""
    gates = (
        F.col("closed")
        | ~F.col("published")
        | ((mode == "wheelchair") & (F.col("stairs") | F.col("curb") | F.coalesce(F.abs("slope") > STEEP, F.lit(False))))
        | (mode.isin("scooter", "bicycle") & F.col("stairs"))
        | ((mode == "scooter") & F.coalesce(F.col("surface").isin("dirt", "gravel"), F.lit(False)))
    )
    return F.coalesce(gates, F.lit(False))


def edge_cost(mode: Column, night: Column, severity: Column) -> Column:
    """Seconds-like cost of an edge that is not blocked."""
    one = F.lit(1.0)
    factor = lambda x: F.coalesce(x, one)
    rough = F.when(mode.isin("wheelchair", "scooter"), 2.5).otherwise(0.8)
    climb = F.when(mode == "wheelchair", 8.0).otherwise(3.0)
    wary = F.when(night, 1.8).otherwise(0.8)
    surface = F.when(F.col("surface").isNotNull(), F.coalesce(_lookup(SURFACE, mode, F.col("surface")), F.lit(UNLISTED_SURFACE)))
    cost = F.col("distance_m") / speed(mode)
    cost = cost * factor(surface)
    cost = cost * factor(one + F.col("roughness") * rough)
    cost = cost * factor(one + F.when(F.col("slope").isNotNull(), F.greatest(F.lit(0.0), F.col("slope"))) * climb)
    cost = cost * factor(one + (one - F.col("safety")) * wary)
    cost = cost * F.when(night & F.col("lit").eqNullSafe(False), 1.7).otherwise(1.0)
    cost = cost * factor(_lookup(GRADE, mode, F.col("grade")))
    cost = cost * (one + severity * F.lit(0.15))
    trust = (
        F.when(F.col("verified") & (F.col("source") == "admin"), 0.82)
        .when(F.col("verified"), 0.96)
        .otherwise(one + F.greatest(F.lit(0.0), F.lit(0.7) - F.col("confidence")) * F.lit(0.08))
    )
    return cost * trust


def hazard_applies(active_when: Column, night: Column) -> Column:
    """Whether a hazard counts at this time; an absent or unknown time means always."""
    when = F.lower(F.coalesce(F.nullif(active_when, F.lit("")), F.lit("always")))
    return F.when(when == "night", night).when(when == "day", ~night).otherwise(True)


def usable(smarter: Column, mode: Column) -> Column:
    """Shortcuts are inferred, so only walkers who ask for them may use them."""
    return (F.col("kind") != "shortcut") | (smarter & (mode == "walking"))
