"""What a reader is shown for stored values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Percent done of a job, by status; any other status has none done.
PROGRESS = {"queued": 10, "dispatched": 35, "inspecting": 65, "succeeded": 100, "failed": 100}


def severity_name(severity: Column) -> Column:
    """Unknown severity reads as low."""
    return F.when(severity >= 3, "high").when(severity == 2, "medium").otherwise("low")


def submission_status(status: Column) -> Column:
    """Any status between the named ones, and an unknown one, reads as approved."""
    return F.when(status.isin("pending", "rejected", "published"), status).otherwise("approved")


def job_progress(job: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])[job], F.lit(0))


def job_status(job: Column) -> Column:
    return F.when(job == "succeeded", "complete").when(job.isin("published", "queued"), job).otherwise("running")
