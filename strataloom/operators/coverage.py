"""Coverage and missingness matrices, duplicates, and counts of what the log holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.merge import filled


def require(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame, or an error that names the missing columns."""
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame


def matrix(frame: DataFrame, groups: Sequence[str], identity: str, rated: Sequence[str]) -> DataFrame:
    """For every group, null groups included: rows, different ids, rows whose id repeats in the group, and the share of filled values.

    Blank ids count in none of the id measures. Two levels of grouped aggregation instead of a window: first by id.
    """
    key = F.nullif(F.trim(F.coalesce(F.col(identity).cast("string"), F.lit(""))), F.lit(""))
    counted = [F.count_if(filled(F.col(c))).alias(f"_{c}") for c in rated]
    per_id = frame.groupBy(*groups, key.alias("_id")).agg(F.count(F.lit(1)).alias("_n"), *counted)
    repeated = F.sum(F.when(F.col("_id").isNotNull() & (F.col("_n") > 1), F.col("_n")).otherwise(0))
    total = F.sum("_n")
    return per_id.groupBy(*groups).agg(
        total.alias("raw_records"), F.count("_id").alias("unique_ids"), repeated.alias("duplicate_id_records"), *[(F.sum(f"_{c}") / total).alias(f"{c}_rate") for c in rated]
    )


def duplicates(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose filled key is on several rows."""
    usable = frame
    for k in keys:
        usable = usable.where(filled(F.col(k)))
    again = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return usable.join(again, list(keys), "left_semi")


def collapsed(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Different rows with their multiplicity."""
    return frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("multiplicity"))


def difference_of_counts(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """What each group has gained."""
    b, a = (f.groupBy(group).agg(F.count(F.lit(1)).alias(n)) for f, n in ((before, "before"), (after, "after")))
    joined = b.join(a, group, "full_outer").fillna(0, ["before", "after"])
    return joined.withColumn("gained", F.col("after") - F.col("before"))


def cardinalities(frames: dict[str, DataFrame]) -> DataFrame:
    """One row a table: name, rows."""
    rows = [f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, f in sorted(frames.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def gate(frame: DataFrame) -> DataFrame:
    """Whether all checks (check, passed) passed, and how many failed; no checks do not pass."""
    return frame.agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("passed"), F.count_if(~F.coalesce(F.col("passed"), F.lit(False))).alias("failed"))


def quarantined(frame: DataFrame, source: str, suspect: Column) -> DataFrame:
    """Sources all of whose rows are suspect, with their rows."""
    by = frame.groupBy(source).agg(F.bool_and(F.coalesce(suspect, F.lit(False))).alias("_all"), F.count(F.lit(1)).alias("rows"))
    return by.where("_all").drop("_all")
