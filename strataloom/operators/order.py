"""Orders, limits and samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import checkpoint_dir


def numbered(frame: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Rows numbered from 0 in a total order without moving all rows to one task.

    The rows are sorted by range; each partition's size, one number a partition, gives the offset of the next. The sorted
    rows are written to the shared folder first: their numbers rest on one evaluation, whatever is lost or computed again.
    """
    checkpoint_dir(frame.sparkSession)
    placed = frame.sort(*order).select("*", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id() % (1 << 33)).alias(out)).checkpoint()
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(offset, "_p").withColumn(out, F.col(out) + F.col("_o")).drop("_p", "_o")


def circular(frame: DataFrame, order: Sequence[str | Column], offset: int, limit: int) -> DataFrame:
    """``limit`` rows from ``offset`` on, in order, going on from the start after the end."""
    n = frame.count()
    if not n:
        return frame.limit(0)
    start, most = offset % n, min(limit, n)
    placed = numbered(frame, order, "_i")
    return placed.where(F.pmod(F.col("_i") - start, F.lit(n)) < most).drop("_i")


def evenly(frame: DataFrame, order: Sequence[str | Column], most: int) -> DataFrame:
    """At most ``most`` rows at even distances, the first and last among them; halves round to even."""
    n = frame.count()
    if n <= most:
        return frame
    places = [round(i * (n - 1) / (most - 1)) for i in range(most)] if most > 1 else [0]
    return numbered(frame, order, "_i").where(F.col("_i").isin(places)).drop("_i")


def hash_sample(frame: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows drawn without replacement by the MD5 of seed and key, with the nominal probability that a row is drawn.

    The first row is always taken and the others compete, so the probability is (k - 1) / (n - 1).
    """
    n = frame.count()
    probability = 1.0 if n <= k else (k - 1) / max(1, n - 1)
    return frame.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k).withColumn("probability", F.lit(min(1.0, probability)))


def top_per_group(frame: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group and task before the exchange."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return frame.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def first_distinct(frame: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The first k different values in the order of their first appearance."""
    return frame.groupBy(value).agg(F.min(order).alias("first_at")).orderBy("first_at", value).limit(k)


def two_tiers(frame: DataFrame, urgent: Column, by_urgent: Sequence[Column], by_rest: Sequence[Column], k: int) -> DataFrame:
    """The first k rows: urgent ones first in their own order, then the others in theirs."""
    keys = [(~urgent).cast("int"), *[F.when(urgent, c) for c in by_urgent], *[F.when(~urgent, c) for c in by_rest]]
    return frame.orderBy(*keys).limit(k)


def slots(backlog: Column, base: Column, most: int = 20) -> Column:
    """Slots of the larger class for one of the smaller: the backlog's ratio, between 1 and ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(backlog / F.greatest(F.lit(1), base)))).cast("int")


#: Width, in units of the order, of the blocks that a running aggregate is taken in.
BLOCK = 1 << 16


def preceding(frame: DataFrame, keys: Sequence[str], order: str, value: Column, total: Callable[[Column], Column], out: str, block: int = BLOCK) -> DataFrame:
    """``frame`` with ``out``: ``total`` (sum or max) of ``value`` over the rows of the keys that stand before in ``order``, a number.

    Null for the first row of its keys; rows of equal ``order`` stand in no defined order. Two steps, so that one key may
    hold a third of all rows: within blocks of the order, and over the blocks' totals, one row a block. Null keys are a
    group of their own.
    """
    whole = Window.unboundedPreceding
    names = [f"_pre_k{i}" for i in range(len(keys))]
    # Keys by which both sides meet: a null is told apart from every text.
    keyed = frame.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for n, k in zip(names, keys, strict=True)}).withColumns({"_pre_b": F.floor(F.col(order) / block), "_pre_v": value})
    blocks = keyed.groupBy(*names, "_pre_b").agg(total(F.col("_pre_v")).alias("_pre_t"))
    before = blocks.withColumn("_pre_before", total(F.col("_pre_t")).over(Window.partitionBy(*names).orderBy("_pre_b").rowsBetween(whole, -1))).drop("_pre_t")
    local = keyed.withColumn("_pre_local", total(F.col("_pre_v")).over(Window.partitionBy(*names, "_pre_b").orderBy(order).rowsBetween(whole, -1)))
    both = F.coalesce(F.col("_pre_local") + F.col("_pre_before"), "_pre_local", "_pre_before") if total is F.sum else F.when(F.col("_pre_local").isNull() | (F.col("_pre_before") > F.col("_pre_local")), F.coalesce("_pre_before", "_pre_local")).otherwise(F.col("_pre_local"))
    return local.join(before, [*names, "_pre_b"]).withColumn(out, both).drop(*names, "_pre_b", "_pre_v", "_pre_local", "_pre_before")
