"""History of changing attributes by consecutive snapshot differencing.

Every distinct observation of a key is a snapshot of that key, numbered in order of time. Each snapshot is compared with
the following one by a null-safe full outer join on key and number: a key that is only in the later one was inserted, one
that is only in the earlier one was deleted after it, and one whose state differs changed. The union of these change
events, in order of time, is the history: ``lead`` gives each version its end. A deletion opens no version, it is the end
of the last one; when it took place is told by ``ends``.

Scale: the input is read once. A number is the place within the key's period (a day) plus the observations of the key's
earlier periods, so windows over many rows are per (key, period), and windows per key see one row a period. The join is
on (key, number), which spreads a key that holds a third of all rows over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import checkpoint_dir


def _offsets(rows: DataFrame, counted: Column) -> DataFrame:
    """(k, p, base): how many rows a key has in its earlier periods."""
    return rows.groupBy("k", "p").agg(counted.alias("size")).select(
        "k", "p", (F.sum("size").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("base")
    )


def snapshots(observations: DataFrame, key: str, state: str, at: str, period: Column | None = None) -> DataFrame:
    """(k, p, t, v, n): the distinct observations of each key, numbered from 1 in order of ``at``, then of the state's text."""
    rows = observations.select(F.col(key).alias("k"), F.col(state).alias("v"), F.col(at).alias("t")).dropna().withColumn("p", F.to_date("t") if period is None else period)
    rows = rows.repartition("k", "p").dropDuplicates(["k", "p", "t", "v"])
    placed = rows.withColumn("o", F.row_number().over(Window.partitionBy("k", "p").orderBy("t", "v")))
    return placed.join(_offsets(placed, F.count(F.lit(1))), ["k", "p"]).select("k", "p", "t", "v", (F.col("base") + F.col("o")).alias("n"))


def differences(numbered: DataFrame) -> DataFrame:
    """(k, p, t, v, event): what happened between consecutive snapshots of a key; t and v of a deletion are null."""
    earlier = numbered.select(F.col("k").alias("k1"), (F.col("n") + 1).alias("n1"), F.col("v").alias("old"))
    later = numbered.select(F.col("k").alias("k2"), F.col("n").alias("n2"), "p", "t", "v")
    both = earlier.join(later, F.col("k1").eqNullSafe(F.col("k2")) & F.col("n1").eqNullSafe(F.col("n2")), "full_outer")
    event = F.when(F.col("k1").isNull(), "inserted").when(F.col("k2").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("v")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("k1", "k2").alias("k"), "p", "t", "v", event.alias("event"))


def versions(observations: DataFrame, key: str, state: str, at: str, period: Column | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(key, state, valid_from, valid_to): the longest runs of one state, in order of ``at``.

    ``at`` is any orderable column. Rows with a null key, state or ``at`` are left out. Rows repeated exactly count
    once. Different states at the same moment are taken in the order of the state's text, so the result is the same on
    every run; a state that was superseded in its very moment is a version with valid_from = valid_to. ``ends`` (key,
    ``at``) has at most one row a key: the time of its deletion, which ends its last version; without it that valid_to is
    null. Other columns of the input are ignored. An empty input gives an empty history.
    """
    checkpoint_dir(observations.sparkSession)
    events = differences(snapshots(observations, key, state, at, period).checkpoint()).where("event != 'unchanged'").checkpoint()
    opened = events.where("event in ('inserted', 'changed')")
    # The end of a version: the next event of its period, else the first event of the key's next period with one, else the deletion.
    within = Window.partitionBy("k", "p").orderBy("t", "v")
    first = opened.groupBy("k", "p").agg(F.min("t").alias("t")).unionByName(events.where("event = 'deleted'").select("k", "p", "t"))
    following = first.select("k", "p", F.lead("t").over(Window.partitionBy("k").orderBy(F.col("p").asc_nulls_last())).alias("later"))
    ended = opened.withColumn("next", F.lead("t").over(within)).join(following, ["k", "p"])
    found = ended.select("k", "v", "t", F.coalesce("next", "later").alias("u"))
    if ends is not None:
        deleted = events.where("event = 'deleted'").select("k").join(ends.select(F.col(key).alias("k"), F.col(at).alias("gone")), "k")
        found = found.join(deleted, "k", "left").withColumn("u", F.coalesce("u", "gone"))
    return found.select(F.col("k").alias(key), F.col("v").alias(state), F.col("t").alias("valid_from"), F.col("u").alias("valid_to"))
