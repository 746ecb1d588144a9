"""Labels of documents, and the folds that training must not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that are broadcast to meet their texts; beyond it the texts are shuffled.
BROADCAST_ROWS = 1 << 20


def fold(id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    text = (F.col(id) if isinstance(id, str) else id).cast("string")
    return F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(parts))


def one_label(labels: DataFrame, id: str, label: str) -> DataFrame:
    """One 0/1 label for each id: the majority of its non-null labels, 1 at a tie."""
    rows = labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("double").alias("y")).dropna()
    return rows.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def with_label(docs: DataFrame, labels: DataFrame, id: str = "id") -> DataFrame:
    """The rows of ``docs`` that have a label in ``labels`` (id, y)."""
    small = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(labels) if small else labels, id)
