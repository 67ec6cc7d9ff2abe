"""Merge policies: current records from a log of observations, and the conflicts on the way.

Each policy is its own function: they disagree on purpose about nulls, ties and which value wins. ``key`` names the
columns of an entity, ``seq`` the arrival number (unique within a key) and ``ts`` the time of an observation. Results
are derived from the whole log by grouped aggregation (partial on the map side, so a key that holds a third of all
rows costs no single task its rows); conflicts, which depend on arrival order, take running maxima in blocks of that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.order import preceding


def filled(c: Column) -> Column:
    """Whether a value is neither null nor blank."""
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def first_value(value: str, *order: str | Column) -> Column:
    """Aggregate: the first filled value in the given order."""
    return F.min(F.when(filled(F.col(value)), F.struct(*order, F.col(value).alias("_v"))))["_v"]


def last_value(value: str, *order: str | Column) -> Column:
    """Aggregate: the last filled value in the given order."""
    return F.max(F.when(filled(F.col(value)), F.struct(*order, F.col(value).alias("_v"))))["_v"]


def priority_row(log: DataFrame, key: Sequence[str], seq: str, priority: str, fields: Sequence[str], refill: Sequence[str]) -> DataFrame:
    """The row of the highest priority wins whole, the later on ties; ``refill`` fields that it lacks come from the first later row that has one."""
    winner = log.groupBy(*key).agg(F.max_by(F.struct(*[f for f in dict.fromkeys([*fields, seq])]), F.struct(priority, seq)).alias("_w"))
    joined = log.join(winner, list(key))
    later = joined.where(F.col(seq) >= F.col(f"_w.{seq}")).groupBy(*key).agg(F.first("_w").alias("_w"), *[first_value(f, seq).alias(f"_r_{f}") for f in refill])
    return later.select(*key, *[F.coalesce(F.col(f"_r_{f}"), F.col(f"_w.{f}")).alias(f) if f in refill else F.col(f"_w.{f}").alias(f) for f in fields])


def first_wins(log: DataFrame, key: Sequence[str], seq: str, fields: Sequence[str]) -> DataFrame:
    """The first filled value of every field stays."""
    return log.groupBy(*key).agg(*[first_value(f, seq).alias(f) for f in fields])


def first_wins_conflicts(log: DataFrame, key: Sequence[str], seq: str, fields: Sequence[str]) -> DataFrame:
    """(key, seq, field, value_retained, value_alternative) of every later filled value that differs as text from the first."""
    kept = first_wins(log, key, seq, fields).select(*key, *[F.col(f).cast("string").alias(f"_k_{f}") for f in fields])
    entries = [F.struct(F.lit(f).alias("field"), F.col(f"_k_{f}").alias("value_retained"), F.col(f).cast("string").alias("value_alternative")) for f in fields]
    long = log.join(kept, list(key)).select(*key, seq, F.explode(F.array(*entries)).alias("e")).select(*key, seq, "e.*")
    return long.where(filled(F.col("value_alternative")) & (F.col("value_retained") != F.col("value_alternative")))


def mixed(log: DataFrame, key: Sequence[str], seq: str, first: Sequence[str], last: Sequence[str], greatest: Sequence[str], least: Sequence[str]) -> DataFrame:
    """Per column: the first or the last filled value, or the greatest or least value."""
    return log.groupBy(*key).agg(
        *[first_value(f, seq).alias(f) for f in first], *[last_value(f, seq).alias(f) for f in last], *[F.max(f).alias(f) for f in greatest], *[F.min(f).alias(f) for f in least]
    )


def newest_wins(log: DataFrame, key: Sequence[str], seq: str, ts: str, fields: Sequence[str]) -> DataFrame:
    """Field by field the filled value with the greatest time; of equal times the first arrival. Older values fill gaps; empty ones erase nothing."""
    order = [F.col(ts).alias("_t"), (-F.col(seq)).alias("_s")]
    return log.groupBy(*key).agg(*[last_value(f, *order).alias(f) for f in fields])


def newest_wins_conflicts(log: DataFrame, key: Sequence[str], seq: str, ts: str, field: str, canon: Column | None = None) -> DataFrame:
    """(key, seq, value_retained, value_alternative) of every value that arrives at the time of the current one and differs from it.

    The current value is the one at that moment, so the result depends on the order of arrival.
    """
    entry = F.struct(F.col(ts).alias("t"), (-F.col(seq)).alias("s"), F.col(field).cast("string").alias("v"), (F.col(field) if canon is None else canon).cast("string").alias("c"))
    seen = preceding(log.where(filled(F.col(field))).withColumn("_e", entry), key, seq, F.col("_e"), F.max, "_p")
    return seen.where((F.col("_p.t") == F.col("_e.t")) & (F.col("_p.c") != F.col("_e.c"))).select(*key, seq, F.col("_p.v").alias("value_retained"), F.col("_e.v").alias("value_alternative"))


def sticky_newest(log: DataFrame, key: Sequence[str], seq: str, ts: str, value: str, canon: Column) -> DataFrame:
    """(key, value, last_ts): the newest value, but in the spelling in which its run of equivalent values began."""
    records = preceding(log.where(filled(F.col(value))), key, seq, F.col(ts), F.max, "_m").where(f"_m is null or {ts} > _m").withColumn("_c", canon)
    # The greatest (number, value) before a row is the row just before it.
    marked = preceding(records, key, seq, F.struct(F.col(seq).alias("s"), F.col("_c").alias("c")), F.max, "_l").withColumn("_new", (~F.col("_c").eqNullSafe(F.col("_l.c"))).cast("int"))
    return marked.groupBy(*key).agg(F.max(F.when(F.col("_new") == 1, F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))["v"].alias(value), F.max(ts).alias("last_ts"))


def insert_or_ignore(log: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The first row of every key."""
    return _extreme(log, key, seq, first=True)


def insert_or_replace(log: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The last row of every key."""
    return _extreme(log, key, seq, first=False)


def _extreme(log: DataFrame, key: Sequence[str], seq: str, first: bool) -> DataFrame:
    row = F.struct(*[c for c in log.columns])
    picked = log.groupBy(*key).agg((F.min_by if first else F.max_by)(row, seq).alias("_r"))
    return picked.select("_r.*")


def seen_between(log: DataFrame, key: Sequence[str], ts: str, source: str, seq: str) -> DataFrame:
    """(key, first_observed, last_observed, source of the newest)."""
    return log.groupBy(*key).agg(F.min(ts).alias("first_observed"), F.max(ts).alias("last_observed"), F.max_by(source, F.struct(ts, seq)).alias(source))


def replay(known: DataFrame, incoming: DataFrame, key: str, content: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows that contradict): incoming rows whose key is unknown, and those whose key is known with other content.

    Merging the same log again adds nothing.
    """
    sign = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content])
    old = known.select(F.col(key).alias("_k"), sign.alias("_h")).distinct()
    joined = incoming.dropDuplicates([key]).withColumn("_n", sign).join(old, F.col(key) == F.col("_k"), "left")
    return joined.where("_k is null").select(*incoming.columns), joined.where("_k is not null and _h <> _n").select(*incoming.columns)


def with_precedence(layers: Sequence[DataFrame], ts: str) -> DataFrame:
    """Logs in rising precedence: every layer but the last gets times before all real ones (-n, ..., -1)."""
    n = len(layers) - 1
    out = layers[-1].withColumn(ts, F.col(ts).cast("double"))
    for i, layer in enumerate(layers[:-1]):
        out = out.unionByName(layer.withColumn(ts, F.lit(float(i - n))), allowMissingColumns=True)
    return out
