"""Accounting over an event log: episodes since a reset, circuits, reservations, and the state that the events leave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.order import preceding


def since_reset(events: DataFrame, groups: Sequence[str], order: str, reset: Column) -> DataFrame:
    """Events after the last reset of their group. The barrier is a grouped maximum, joined back."""
    barrier = events.groupBy(*groups).agg(F.coalesce(F.max(F.when(reset, F.col(order))), F.lit(0)).alias("_b"))
    return events.join(barrier, list(groups)).where(F.col(order) > F.col("_b")).drop("_b")


def episode(events: DataFrame, job: str, order: str, failed: Column, reset: Column) -> DataFrame:
    """(job, failures): failures since the job's last reset; jobs without any are 0."""
    marked = events.withColumn("_f", failed)
    count = since_reset(marked, [job], order, reset).groupBy(job).agg(F.count_if("_f").alias("failures"))
    return events.select(job).distinct().join(count, job, "left").withColumn("failures", F.coalesce("failures", F.lit(0)))


def circuits(events: DataFrame, groups: Sequence[str], job: str, order: str, failed: Column, reset: Column, least: int = 3) -> DataFrame:
    """(groups, jobs, is_open): different jobs that failed since the group's last reset."""
    marked = events.withColumn("_f", failed)
    count = since_reset(marked, groups, order, reset).where("_f").groupBy(*groups).agg(F.countDistinct(job).alias("jobs"))
    return events.select(*groups).distinct().join(count, list(groups), "left").select(*groups, F.coalesce("jobs", F.lit(0)).alias("jobs"), (F.coalesce("jobs", F.lit(0)) >= least).alias("is_open"))


def reservations(requests: DataFrame, platform: str, order: str, now: str, delay: str, blocked: str) -> DataFrame:
    """Requests with ``slot``: the time at which each may start when every one waits for those before it.

    The recurrence slot = max(now, next, blocked), next = slot + delay is a prefix maximum: with P the sum of the delays
    before a request, slot - P is the running maximum of max(now, blocked) - P.
    """
    with_sum = preceding(requests, [platform], order, F.col(delay).cast("double"), F.sum, "_p").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    ready = F.greatest(F.col(now), F.coalesce(F.col(blocked), F.col(now))) - F.col("_p")
    with_ready = preceding(with_sum.withColumn("_r", ready), [platform], order, F.col("_r"), F.max, "_m")
    return with_ready.withColumn("slot", F.greatest("_r", "_m") + F.col("_p")).drop("_p", "_r", "_m")


def latest_state(events: DataFrame, job: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The columns of the last event of every job."""
    return events.groupBy(job).agg(F.max_by(F.struct(*columns), order).alias("_l")).select(job, "_l.*")


def streaks(events: DataFrame, group: str, order: str, bad: Column) -> DataFrame:
    """(group, longest, current): the longest run of bad events and the run that is still going on."""
    # A run is named by the number of good events before it; a good event closes the run that stands before it.
    flagged = events.withColumn("_b", F.coalesce(bad, F.lit(False)))
    marked = preceding(flagged, [group], order, F.when(F.col("_b"), 0).otherwise(1), F.sum, "_g").withColumn("_g", F.coalesce("_g", F.lit(0)) + F.when(F.col("_b"), 0).otherwise(1))
    runs = marked.groupBy(group, "_g").agg(F.count_if("_b").alias("n"))
    return runs.groupBy(group).agg(F.max("n").alias("longest"), F.max_by("n", "_g").alias("current"))


def enqueue(queue: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't in the queue yet, one a key."""
    return incoming.dropDuplicates([key]).join(queue.select(key), key, "left_anti")


def progress(jobs: DataFrame, groups: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Counts of jobs by group and condition, in one pass."""
    return jobs.groupBy(*groups).agg(*[F.count_if(c).alias(n) for n, c in measures.items()])
