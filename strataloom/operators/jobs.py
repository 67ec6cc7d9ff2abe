"""The state of a queue's jobs as a fold over its append-only event log, and what follows from the state.

Events: (job, order, at, kind, coverage, delay): kinds are enqueued, claimed, finished, failed, deferred; ``at`` is in
seconds, ``coverage`` the share of its work that a finish reached, ``delay`` the seconds that a deferral or server asked
for. Nothing is updated in place: a state is a grouped aggregation of the log, so replays and late rows are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import scalars
from strataloom.operators import events as E

#: Seconds that a claim holds; seconds after which recovery of a job is overdue.
LEASE, OVERDUE = 600, 86_400


def fold(log: DataFrame) -> DataFrame:
    """(job, kind, at, coverage, delay, failures, deferrals, finishes, updated_at): the last event of every job and its counts.

    Failures and deferrals count since the job's last finish; a deferral is no failure. Repeated rows count once.
    """
    rows = log.select("job", "order", "at", "kind", "coverage", "delay").distinct()
    last = rows.groupBy("job").agg(F.max_by(F.struct("kind", "at", "coverage", "delay"), "order").alias("last"), F.count_if(F.col("kind") == "finished").alias("finishes"), F.max("at").alias("updated_at"))
    since = E.since_reset(rows, ["job"], "order", F.col("kind") == "finished")
    counts = since.groupBy("job").agg(F.count_if(F.col("kind") == "failed").alias("failures"), F.count_if(F.col("kind") == "deferred").alias("deferrals"))
    none = F.lit(0).cast("bigint")
    return last.join(counts, "job", "left").select("job", "last.*", F.coalesce("failures", none).alias("failures"), F.coalesce("deferrals", none).alias("deferrals"), "finishes", "updated_at")


def due_at() -> Column:
    """When a folded job may be tried again: after its backoff, its deferral, or the end of its lease; at once else."""
    kind, at = F.col("kind"), F.col("at")
    return F.when(kind == "failed", at + scalars.backoff_seconds(F.col("failures"), F.col("delay"))).when(kind == "deferred", at + F.coalesce("delay", F.lit(0.0))).when(kind == "claimed", at + F.lit(float(LEASE))).otherwise(at.cast("double"))


def status(now: Column) -> Column:
    """leased while a claim holds; after a finish done, unresolved or pending by what it covered; pending else."""
    kind, coverage = F.col("kind"), F.col("coverage")
    finish = F.when(coverage >= 1, "done").when(coverage > 0, "pending").otherwise("unresolved")
    return F.when(kind == "finished", finish).when((kind == "claimed") & (F.col("at") + LEASE > now), "leased").otherwise("pending")


def claimable(state: DataFrame, blocked: DataFrame, group: str, now: Column, k: int) -> DataFrame:
    """The next k jobs: pending, due, of no blocked group, the longest due first, then the smaller job."""
    free = state.where((status(now) == "pending") & (due_at() <= now)).withColumn("due_at", due_at())
    return free.join(blocked.select(group), group, "left_anti").orderBy("due_at", "job").limit(k)


def recovery(state: DataFrame, now: Column) -> DataFrame:
    """(job, due, pass, overdue): a job without a due time is due from its last change; before its first finish it is a first pass."""
    due = F.coalesce(F.nullif(due_at(), F.lit(0.0)), F.col("updated_at").cast("double"))
    return state.where(status(now) == "pending").select("job", due.alias("due"), F.when(F.col("finishes") == 0, "first").otherwise("refresh").alias("pass"), (now - due > OVERDUE).alias("overdue"))


def migrate(jobs: DataFrame, retired: str, successor: str) -> DataFrame:
    """Jobs (job, kind) with status: those of the retired kind excluded, each with one pending job of the successor; a second run adds none."""
    gone = jobs.where(F.col("kind") == retired).select("job").distinct()
    there = jobs.where(F.col("kind") == successor).select("job").distinct()
    new = gone.join(there, "job", "left_anti").select("job", F.lit(successor).alias("kind"), F.lit("pending").alias("status"))
    return jobs.distinct().withColumn("status", F.when(F.col("kind") == retired, "excluded").otherwise("kept")).unionByName(new)
