"""Matching on exact keys with guards: unique matches, crosswalks, stubs, spines and zips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_match(left: DataFrame, right: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """``left`` with ``target`` where exactly one row of ``right`` agrees in all keys, and ``matches``, their number.

    Null and blank keys match nothing. The right side is aggregated first, so copies of a key never multiply rows.
    """
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
    found = right.where(usable).groupBy(*keys).agg(F.countDistinct(target).alias("matches"), F.min(target).alias(target))
    joined = left.join(found, list(keys), "left")
    return joined.withColumn("matches", F.coalesce("matches", F.lit(0))).withColumn(target, F.when(F.col("matches") == 1, F.col(target)))


def title_links(records: DataFrame, works: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(record, how, work): a record's link by its alternate names, with the strength of the evidence.

    records: (record, names array, authors array, platform, alias); works: (work, title, author, platform); all names
    normalised. crosswalk: (alias, work). One work must remain; then an author, the crosswalk or nothing confirms it.
    """
    names = records.select("record", "platform", F.explode(F.array_distinct("names")).alias("title")).where("title != ''")
    # Works are counted by title before they meet the records, on their platform and over all, so a title that fills both
    # tables gives one row a record. least and greatest tell whether several names of a record lead to one work.
    named = works.where("title != ''")
    own = named.groupBy("title", "platform").agg(F.min("work").alias("least"), F.max("work").alias("greatest"))
    every = named.groupBy("title").agg(F.min("work").alias("least"), F.max("work").alias("greatest"))
    hits = names.where("platform is not null").join(own, ["title", "platform"]).select("record", "least", "greatest").unionByName(names.where("platform is null").join(every, "title").select("record", "least", "greatest"))
    each = hits.groupBy("record").agg(F.min("least").alias("work"), F.max("greatest").alias("last")).withColumn("n", F.when(F.col("work") == F.col("last"), 1).otherwise(2)).drop("last")
    writer = works.select("work", "author").dropDuplicates(["work"])
    known = crosswalk.select("alias", F.col("work")).distinct().withColumn("_x", F.lit(True))
    one = records.join(each, "record", "left").join(writer, "work", "left").join(known, ["alias", "work"], "left")
    exact = F.coalesce(F.array_contains("authors", F.col("author")) & (F.col("author") != ""), F.lit(False))
    how = F.when(F.col("n").isNull(), "not_matched").when(F.col("n") > 1, "ambiguous_title").when(exact, "exact_title_author").when(F.col("_x"), "dual_title_crosswalk").otherwise("unique_title_only_candidate")
    return one.select("record", how.alias("how"), F.when(F.col("n") == 1, F.col("work")).alias("work"))


def crosswalk(rows: DataFrame, key: str, target: str) -> DataFrame:
    """Rows with ``status``: missing, duplicate (the key is on several rows) or ok."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    status = F.when(F.col(key).isNull() | F.col(target).isNull(), "missing").when(F.col("_n") > 1, "duplicate").otherwise("ok")
    return rows.join(counts, key, "left").withColumn("status", status).drop("_n")


def with_stubs(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents, and for every key that only children have, a row of nulls."""
    missing = children.where(F.col(key).isNotNull()).select(key).distinct().join(parents, key, "left_anti")
    return parents.withColumn("is_stub", F.lit(False)).unionByName(missing.withColumn("is_stub", F.lit(True)), allowMissingColumns=True)


def spine(first: int, last: int, groups: DataFrame, facts: DataFrame, on: str, group: str, fill: str) -> DataFrame:
    """Every group crossed with every number from first to last, with the facts where there are any, else 0."""
    grid = groups.select(group).distinct().withColumn(on, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(facts, [group, on], "left").withColumn(fill, F.coalesce(fill, F.lit(0)))


def zip_by_position(left: DataFrame, right: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Rows of two ordered lists side by side, place by place; null where a list is shorter. Columns get l_ and r_."""

    def placed(frame: DataFrame, prefix: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(order, *columns)).alias("place")
        return frame.select(key, place, *[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    return placed(left, "l").join(placed(right, "r"), [key, "place"], "full_outer")
