"""Declarative checks: each row gets the names of the rules that it breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition does not hold; unknown counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))


def geometry_rules(line: Column) -> dict[str, Column]:
    """Of an array of [latitude, longitude] pairs."""
    return {
        "two_points": F.size(line) >= 2,
        "pairs": F.forall(line, lambda p: F.size(p) == 2),
        "latitude": F.forall(line, lambda p: F.coalesce(F.get(p, F.lit(0)).between(-90, 90), F.lit(False))),
        "longitude": F.forall(line, lambda p: F.coalesce(F.get(p, F.lit(1)).between(-180, 180), F.lit(False))),
    }


def image_kind(content: Column) -> Column:
    """png, jpeg or webp by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )
