"""Ordered children of an entity: endpoints, endings and dates derived from a chapter list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import scalars
from strataloom.operators.order import preceding

#: Share of the ordinals after which an ending title counts.
LATE = 0.60


def latest_per_ordinal(rows: DataFrame, work: str, ordinal: str, official: str, retrieved: str, tie: str) -> DataFrame:
    """One row for every ordinal of a work: official rows before others, then the latest retrieval. A row without a numeric ordinal is its own."""
    number = F.col(ordinal).try_cast("bigint")
    key = F.coalesce(number.cast("string"), F.concat(F.lit("row:"), F.col(tie).cast("string")))
    row = F.struct(*rows.columns)
    best = rows.withColumn("_k", key).groupBy(work, "_k").agg(F.max_by(row, F.struct(F.col(official), F.col(retrieved), F.col(tie))).alias("_r"))
    return best.select("_r.*")


def endpoints(rows: DataFrame, work: str, ordinal: str, columns: Sequence[str]) -> DataFrame:
    """For every work the columns of its first and last chapter by numeric ordinal (first_*, last_*)."""
    numbered = rows.withColumn("_n", F.col(ordinal).try_cast("bigint")).where("_n is not null")
    value = F.struct(*columns)
    return numbered.groupBy(work).agg(F.min_by(value, F.struct("_n", *columns)).alias("a"), F.max_by(value, F.struct("_n", *columns)).alias("b")).select(
        work, *[F.col(f"a.{c}").alias(f"first_{c}") for c in columns], *[F.col(f"b.{c}").alias(f"last_{c}") for c in columns]
    )


def late_endings(rows: DataFrame, work: str, ordinal: str, title: str, published: str, updated: str) -> DataFrame:
    """Ending titles in the last part of a work's ordinals, with the date of publication, or of the update where that is missing.

    The part is measured from the greatest numeric ordinal, which one grouped pass finds; no window over a work is needed.
    """
    numbered = rows.withColumn("_n", F.col(ordinal).try_cast("bigint")).where("_n is not null")
    most = numbered.groupBy(work).agg(F.max("_n").alias("_m"))
    late = numbered.join(most, work).withColumn("role", scalars.ending_role(F.col(title))).where((F.col("_n") >= F.col("_m") * LATE) & F.col("role").isNotNull())
    date = F.coalesce(F.nullif(F.col(published), F.lit("")), F.nullif(F.col(updated), F.lit("")))
    return late.select(work, F.col("_n").alias("ordinal"), "role", date.alias("value")).where("value is not null")


def windows(rows: DataFrame, work: str, position: str, title: str, volume: Column, status: DataFrame) -> DataFrame:
    """The span of a work's main text: (work, chapters, auxiliary, first, last, main_start, main_end, end_basis, ending_titles).

    ``position`` orders the chapters (unique within a work); ``status`` has (work, status). One ending title marks the
    end; several mark none. Without any, auxiliary chapters at the end, or a complete status, show where the main text
    ends. All are sums, minima and maxima of flags, so a work with a third of all rows is aggregated on the map side.
    """
    role = scalars.ending_role(F.col(title))
    main = ~scalars.is_auxiliary(F.col(title), volume)
    p = F.col(position)
    explicit = main & F.coalesce(role == "main_story_end_marker_update", F.lit(False))
    broader = main & F.coalesce(role.isin("all_text_end_marker_update", "ending_marker_update"), F.lit(False))
    flagged = rows.select(work, p.alias("p"), main.alias("m"), explicit.alias("x"), broader.alias("b"))
    one = flagged.groupBy(work).agg(
        F.count(F.lit(1)).alias("chapters"), F.count_if(~F.col("m")).alias("auxiliary"), F.min("p").alias("first"), F.max("p").alias("last"),
        F.min(F.when(F.col("m"), F.col("p"))).alias("main_start"), F.max(F.when(F.col("m"), F.col("p"))).alias("main_last"),
        F.count_if("x").alias("nx"), F.max(F.when(F.col("x"), F.col("p"))).alias("px"), F.count_if("b").alias("nb"), F.max(F.when(F.col("b"), F.col("p"))).alias("pb"),
    ).join(status, work, "left")
    markers = F.when(F.col("nx") > 0, F.col("nx")).otherwise(F.col("nb"))
    complete = scalars.is_complete(F.col("status"), scalars.COMPLETE_WINDOW)
    trailing = F.col("main_last") < F.col("last")
    end = F.when(markers == 1, F.coalesce(F.when(F.col("nx") > 0, F.col("px")), F.col("pb"))).when(markers > 1, None).when(trailing | complete, F.col("main_last"))
    basis = (
        F.when((markers == 1) & (F.col("nx") > 0), "explicit_main_text_title").when(markers == 1, "ending_title").when(markers > 1, "ambiguous_ending_titles")
        .when(trailing, "before_trailing_auxiliary_titles").when(F.col("main_start").isNotNull() & complete, "completed_status_last_non_auxiliary")
        .when(F.col("main_start").isNotNull(), "no_ending_marker_or_completed_status").otherwise("unresolved")
    )
    return one.select(work, "chapters", "auxiliary", "first", "last", "main_start", end.alias("main_end"), basis.alias("end_basis"), markers.alias("ending_titles"))


def islands(rows: DataFrame, key: str, position: str, flag: str) -> DataFrame:
    """(key, start, end, length) of every run of flagged rows in a row."""
    grouped = preceding(rows, [key], position, F.when(F.col(flag), 0).otherwise(1), F.sum, "_g").withColumn("_g", F.coalesce("_g", F.lit(0))).where(F.col(flag))
    return grouped.groupBy(key, "_g").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count(F.lit(1)).alias("length")).drop("_g")
