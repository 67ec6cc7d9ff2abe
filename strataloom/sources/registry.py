"""What the source registry says about each source: default zone, unit of bare counts, order of day and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.sources.tables import table


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per key of a source (its id and its kind): source_key, local_zone, bare_unit, month_first, priority.

    The notes are prose; a phrase that is not there leaves its field null. The table is fixed and small, so the
    planner broadcasts it by its measured size.
    """
    notes = F.lower(F.coalesce(F.col("notes"), F.lit("")))
    registry = table(spark, folder, "source_registry").withColumns(
        {
            "bare_unit": F.when(~notes.contains("bare count"), None)
            .when(notes.rlike("ten thousand|万字"), F.lit("wan"))
            .when(notes.rlike("thousands? of characters|千字(?!节)"), F.lit("thousand"))
            .when(notes.rlike("kilobytes?|kb|千字节"), F.lit("kilobyte"))
            .when(notes.rlike("bytes|字节"), F.lit("byte"))
            .when(notes.contains("characters"), F.lit("char")),
            "month_first": F.when(notes.contains("month before day"), True).when(notes.contains("day before month"), False),
        }
    )
    keys = F.explode(F.array_distinct(F.array("source_id", "source_kind"))).alias("source_key")
    return registry.select(keys, "local_zone", "bare_unit", "month_first", "priority").where("source_key is not null").dropDuplicates(["source_key"])
