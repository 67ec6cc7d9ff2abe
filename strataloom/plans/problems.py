"""The general training-data queries: each applies its operator to the whole of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import keep_filled, narrow, strip
from strataloom.operators import history, packed, timestamps, units
from strataloom.plans import problem_sql
from strataloom.sources.registry import profiles
from strataloom.sources.tables import table

def chapter_key() -> Column:
    """The record key of a chapter."""
    return F.concat_ws(":", "platform", "work_id", "chapter_key")



def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value that denotes a real date or time, normalised. Values that denote none give no row."""
    observations = table(spark, folder, "source_observation", "observation_id", "date_raw", "source_id").select(
        F.lit("source_observation").alias("table_name"), F.col("observation_id").alias("record_key"), F.lit("date_raw").alias("field_name"), F.col("date_raw").alias("raw"), F.col("source_id").alias("source_key")
    )
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in ("publication_date", "update_date")])).alias("f")
    chapters = table(spark, folder, "chapters", "platform", "work_id", "chapter_key", "publication_date", "update_date", "source_kind").select(
        F.lit("chapters").alias("table_name"), chapter_key().alias("record_key"), fields, F.col("source_kind").alias("source_key")
    ).select("table_name", "record_key", "f.field_name", "f.raw", "source_key")
    dates = table(spark, folder, "work_dates", "work_key", "catalog_pub_date").select(
        F.lit("work_dates").alias("table_name"), F.col("work_key").alias("record_key"), F.lit("catalog_pub_date").alias("field_name"), F.col("catalog_pub_date").alias("raw"), F.lit(None).cast("string").alias("source_key")
    )
    values = observations.unionByName(chapters).unionByName(dates).where("raw is not null")
    known = values.join(profiles(spark, folder), "source_key", "left").withColumn(
        "zone", F.when(F.col("table_name") == "work_dates", F.lit("Asia/Shanghai")).otherwise(F.col("local_zone"))
    )
    found = timestamps.normalise(known, "raw", "zone", "month_first")
    return keep_filled(found, "normal_time").select("table_name", "record_key", "field_name", "normal_time").distinct()


def status_codes(spark: SparkSession, folder: str, frame: DataFrame, column: str) -> DataFrame:
    """``frame`` with status_code: the vocabulary's code of the text without label, brackets, blanks and case."""
    bare = F.regexp_replace(F.lower(strip(narrow(F.col(column)))), r"^(?:状态|status) *: *|[\[\]【】()（）《》「」]", "")
    vocab = table(spark, folder, "status_vocab").select(F.lower(strip(narrow(F.col("status_text")))).alias("_status"), "status_code").dropDuplicates(["_status"])
    return frame.withColumn("_status", strip(bare)).join(vocab, "_status", "left").drop("_status")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every longest run of one status of a work, with the period in which it held."""
    seen = status_codes(spark, folder, table(spark, folder, "source_observation", "work_key", "status_raw", "observed_at"), "status_raw")
    states = seen.where("work_key is not null and status_code is not null and trim(observed_at) != ''").select(
        "work_key", "status_code", F.struct(F.try_to_timestamp("observed_at").alias("t"), F.col("observed_at").alias("s")).alias("at")
    )
    works = table(spark, folder, "works", "platform", "work_id", "last_seen_at").select(
        F.concat_ws(":", "platform", "work_id").alias("work_key"), F.struct(F.try_to_timestamp("last_seen_at").alias("t"), F.col("last_seen_at").alias("s")).alias("at")
    )
    last = works.where("at.t is not null").groupBy("work_key").agg(F.max("at").alias("at"))
    runs = history.versions(states.where("at.t is not null"), "work_key", "status_code", "at", F.to_date("t.t"), last)
    return runs.select("work_key", "status_code", F.col("valid_from.s").alias("valid_from"), F.coalesce("valid_to.s", F.lit("")).alias("valid_to"))


#: How much the logarithm of a work's length moves between observations; chapters of a work differ more (the default).
WORK_SPREAD = 0.25


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The readings of problem 1. A device is a work: its count in work_master, which comes first, and its observations in
    order of time; or a work's chapters in order of their number."""
    known = profiles(spark, folder)
    counts = [
        table(spark, folder, "work_master", "work_key", "word_count").select(
            F.lit("work_master").alias("table_name"), F.col("work_key").alias("record_key"), F.col("word_count").alias("text"), F.lit("work_master").alias("source"),
            F.concat(F.lit("w:"), "work_key").alias("series"), F.lit(-1).cast("bigint").alias("position"), F.lit("char").alias("stated"),
        ),
        table(spark, folder, "source_observation", "observation_id", "source_id", "work_key", "word_count", "observed_at").select(
            F.lit("source_observation").alias("table_name"), F.col("observation_id").alias("record_key"), F.col("word_count").alias("text"), F.col("source_id").alias("source"),
            F.concat(F.lit("w:"), "work_key").alias("series"), F.unix_micros(F.try_to_timestamp("observed_at")).alias("position"), F.lit(None).cast("string").alias("stated"),
        ),
        table(spark, folder, "chapters", "platform", "work_id", "chapter_key", "chapter_number", "word_count", "source_kind").select(
            F.lit("chapters").alias("table_name"), chapter_key().alias("record_key"), F.col("word_count").alias("text"), F.col("source_kind").alias("source"),
            F.concat_ws(":", F.lit("c"), "platform", "work_id").alias("series"), F.col("chapter_number").try_cast("bigint").alias("position"), F.lit(None).cast("string").alias("stated"),
        ),
    ]
    values = counts[0].unionByName(counts[1]).unionByName(counts[2]).where("text is not null")
    return values.distinct().join(known.select(F.col("source_key").alias("source"), "bare_unit"), "source", "left").select(
        F.struct("table_name", "record_key", "text").alias("row"), "series", "position", "text", "source", F.coalesce("stated", "bare_unit").alias("documented"),
        F.when(F.col("row.table_name") == "chapters", units.SPREAD).otherwise(WORK_SPREAD).alias("spread"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every stated length in characters, unless the text is already exactly that number."""
    found = units.convert(lengths(spark, folder))
    return found.where(F.col("row.text") != F.col("char_count").cast("string")).select("row.table_name", "row.record_key", "char_count").distinct()


PACKED = (("work_master", "work_key", "tags_raw"), ("external_bibliography", "external_key", "associated_names"), ("external_bibliography", "external_key", "authors"))


def packed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the packed fields: row (table_name, record_key), field, item_no, item_value."""
    parts = [
        table(spark, folder, name, key, field).select(
            F.struct(F.lit(name).alias("table_name"), F.col(key).alias("record_key")).alias("row"), F.lit(field).alias("field"), F.col(field).alias("text")
        )
        for name, key, field in PACKED
    ]
    return packed.split(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of a field that holds two or more."""
    several = packed_items(spark, folder).where("item_count >= 2")
    return several.select("row.table_name", "row.record_key", F.col("field").alias("field_name"), F.col("item_no").cast("int"), "item_value").distinct()


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p6_found": p6_found}
ORACLES = {"p1_found": problem_sql.P1, "p5_found": problem_sql.P5, "p6_found": problem_sql.P6}
