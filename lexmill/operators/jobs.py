"""A table of jobs: what runs next, and what a run makes of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Priorities from first to last.
PRIORITIES = ("HIGH", "NORMAL", "LOW")
MOST_ATTEMPTS = 3


def priority_rank(priority: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRIORITIES)), priority)


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The n queued jobs that run next: by priority, then first come first served."""
    return jobs.where("status = 'queued'").orderBy(priority_rank(F.col("priority")), "sequence").limit(n)


def after_run(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """jobs (job_id, status, attempts, ...) after outcomes (job_id, success): a failed job is queued again until it was tried three times."""
    done = jobs.join(outcomes, "job_id", "left")
    tried = F.col("success").isNotNull()
    attempts = F.col("attempts") + F.when(tried, 1).otherwise(0)
    status = F.when(~tried, F.col("status")).when(F.col("success"), "completed").when(attempts < MOST_ATTEMPTS, "queued").otherwise("failed")
    return done.withColumns({"status": status, "attempts": attempts}).drop("success")


def cancelled(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Queued jobs among ids are cancelled; running and finished ones are not."""
    marked = jobs.join(ids.select("job_id").distinct().withColumn("_c", F.lit(True)), "job_id", "left")
    return marked.withColumn("status", F.when(F.col("_c") & (F.col("status") == "queued"), "cancelled").otherwise(F.col("status"))).drop("_c")
