"""Queries of the language and model operators; each covers the whole of its tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm import linkage, mixing, mojibake, names, packing, problem_sql, subjects, survivorship, tokens
from strataloom.session import checkpoint_dir
from strataloom.sources.tables import table

#: Bytes of the patterns that are counted for the dictionaries of problem 4, over all texts: two Chinese characters.
PATTERN = 6


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every text read in a wrong encoding, with its original."""
    titles = table(spark, folder, "legacy_bibliography", "legacy_id", "title").select(
        F.struct(F.lit("legacy_bibliography").alias("table_name"), F.col("legacy_id").alias("record_key")).alias("row"), F.lit("title").alias("field"), F.col("title").alias("text")
    )
    records = table(spark, folder, "source_observation", "observation_id", "raw_record_json").select(
        F.struct(F.lit("source_observation").alias("table_name"), F.col("observation_id").alias("record_key")).alias("row"), F.lit("").alias("field"), F.col("raw_record_json").alias("text")
    )
    texts = mojibake.texts_of(titles, "text", json_column=False).unionByName(mojibake.texts_of(records, "text", json_column=True))
    model = mojibake.fit_all(texts, PATTERN, names.base_script(spark).simple)
    found = mojibake.restore(titles, model, json_column=False).unionByName(mojibake.restore(records, model, json_column=True))
    return found.select("row.table_name", "row.record_key", F.col("field").alias("field_name"), "restored_text").distinct()


DISPUTED = ("title", "author", "genre_raw", "declared_pub_year")
COMPLETE = ("title", "author", "genre_raw", "status_raw", "word_count")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The best value of every disputed field of a work, and the preferred observation of works that have a fit one."""
    sources = table(spark, folder, "source_registry", "source_id", "priority").dropDuplicates(["source_id"])
    seen = table(spark, folder, "source_observation", "observation_id", "source_id", "work_key", "author_id", "observed_at", "word_count", "status_raw", "title", "author", "genre_raw", "declared_pub_year")
    seen = seen.withColumn("declared_pub_year", F.col("declared_pub_year").cast("string")).join(sources, "source_id", "left").withColumn("at", F.try_to_timestamp("observed_at"))
    asked = table(spark, folder, "metadata_conflict", "work_key", "field").dropna().distinct()
    best = survivorship.survivors(seen, "work_key", DISPUTED, "at", "observation_id", "priority", {"author": "author_id"})
    values = best.join(asked.select(F.col("work_key").alias("group"), "field"), ["group", "field"]).select(F.col("group").alias("work_key"), F.col("field").alias("field_name"), F.col("value").alias("surviving_value"))
    preferred = survivorship.newest_trusted(seen, "work_key", "at", "observation_id", "priority", COMPLETE)
    return values.unionByName(preferred.select("work_key", F.lit("preferred_observation_id").alias("field_name"), F.col("observation_id").alias("surviving_value")))


#: Least confidence of a pair that p3_found returns.
SAME = 0.5


def linked_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(record, work, confidence) of every candidate pair of external records and works."""
    split = _pieces
    external = table(spark, folder, "external_bibliography", "external_key", "title", "associated_names", "authors", "source_platform", "start_year_reported")
    external = external.where("external_key is not null").dropDuplicates(["external_key"])
    records = external.select(
        F.col("external_key").alias("id"), F.concat(F.array("title"), split("associated_names")).alias("titles"), split("authors").alias("authors"),
        F.col("source_platform").alias("platform"), F.array(F.col("start_year_reported").cast("int")).alias("years"),
    )
    seen = table(spark, folder, "source_observation", "work_key", "title", "author", "declared_pub_year").withColumnRenamed("declared_pub_year", "year").withColumn("platform", F.lit(None).cast("string"))
    master = table(spark, folder, "work_master", "work_key", "title", "author", "platform_declared_pub_year", "platform").withColumnRenamed("platform_declared_pub_year", "year")
    known = master.select("work_key").distinct()
    every = master.unionByName(seen).where("work_key is not null").groupBy("work_key").agg(
        F.sort_array(F.collect_set("title")).alias("titles"), F.sort_array(F.collect_set("author")).alias("authors"), F.max("platform").alias("platform"), F.sort_array(F.collect_set(F.col("year").cast("int"))).alias("years")
    )
    works = every.join(known, "work_key", "left_semi").withColumnRenamed("work_key", "id")
    checkpoint_dir(spark)
    records = records.checkpoint()
    script = names.learn(spark, records.select(F.concat("titles", "authors").alias("names")))
    return linkage.link(records, works, script)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of an external record and a work that describes the same thing."""
    return linked_pairs(spark, folder).where(F.col("confidence") >= SAME).select(F.col("record").alias("external_key"), F.col("work").alias("work_key")).distinct()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(texts: pd.Series) -> pd.Series:
    return texts.map(names.pieces)



def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every subject area that a good part of a document deals with."""
    documents = table(spark, folder, "documents", "doc_id", "text")
    known = sorted(r.subject_code for r in table(spark, folder, "subject_area", "subject_code").dropna().distinct().collect())
    model, weight, fold = subjects.train(documents, table(spark, folder, "document_label", "doc_id", "subject_code"), known)
    return subjects.assign(documents, model, weight, fold).select("doc_id", "subject_code").distinct()


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by subject area; 0 for an area without any."""
    counted = p10_found(spark, folder).groupBy("subject_code").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "subject_area", "subject_code").join(counted, "subject_code", "left").select("subject_code", F.coalesce("n", F.lit(0)).alias("documents"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of each capacity: which, at which place, from which token, how many."""
    documents = table(spark, folder, "documents", "doc_id", "text")
    fold = subjects.folding(spark)
    weight = subjects.rarity(documents, "text", fold)
    capacities = [tuple(r) for r in table(spark, folder, "pack_spec", "spec_id", "capacity_tokens").collect()]
    checkpoint_dir(spark)
    return packing.pack(documents, capacities, weight, fold)


def p8_filling(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity: containers, items, tokens and the share of the containers' space that is used."""
    each = p8_packed(spark, folder).groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    total = each.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"))
    spec = table(spark, folder, "pack_spec", "spec_id", "capacity_tokens").dropna().dropDuplicates(["spec_id"])
    return total.join(spec, "spec_id").select("spec_id", "capacity_tokens", "containers", "items", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    checkpoint_dir(spark)
    sized = tokens.with_tokens(table(spark, folder, "documents", "doc_id", "source", "text"), "text").select("doc_id", "source", "tokens").checkpoint()
    targets = table(spark, folder, "mix_target", "source", "target_share", "max_repeats")
    return sized, mixing.mix(sized, mixing.plan(sized, [tuple(r) for r in targets.collect()])), targets


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture with their sizes and repeats."""
    return _mixture(spark, folder)[1]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    sized, mixed, targets = _mixture(spark, folder)
    return mixing.shares(sized, mixed, targets)


QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p7_found": p7_found,
    "p8_packed": p8_packed,
    "p8_filling": p8_filling,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}
ORACLES = {"p7_found": problem_sql.P7}
