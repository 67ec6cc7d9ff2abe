"""Audits: preservation between snapshots, keys, references, rules. Each gives a table of (check, passed, n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.merge import filled


def _check(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), "n")


def union(checks: Sequence[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def lost_rows(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Different rows (or keys) that were there before and are not now; a lost copy of a row that remains is no loss."""
    names = list(columns or before.columns)
    return before.select(*names).subtract(after.select(*names))


def preservation(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """Tables, rows and identities lost between two snapshots. Tables with keys may change their other columns."""
    checks = []
    for name, old in sorted(before.items()):
        if name not in after:
            spark = old.sparkSession
            checks.append(spark.range(1).select(F.lit(f"table:{name}").alias("check"), F.lit(False).alias("passed"), F.lit(1).cast("bigint").alias("n")))
        else:
            checks.append(_check(f"rows:{name}", lost_rows(old, after[name], keys.get(name))))
    return union(checks)


def same_bag(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, rows) that only one side has, copies counted; and a row for differing schemas."""
    if [(f.name, f.dataType) for f in left.schema] != [(f.name, f.dataType) for f in right.schema]:
        return left.sparkSession.range(1).select(F.lit("schema").alias("side"), F.lit(1).cast("bigint").alias("rows"))
    parts = [a.exceptAll(b).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(side).alias("side"), "rows") for side, a, b in (("left", left, right), ("right", right, left))]
    return parts[0].unionByName(parts[1])


def unique(frame: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    return _check(f"unique:{name}", frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1"))


def refers(child: DataFrame, parent: DataFrame, name: str, key: str, parent_key: str) -> DataFrame:
    """Rows whose filled key has no parent."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return _check(f"reference:{name}", child.where(F.col(key).isNotNull()).join(known, key, "left_anti"))


def holds(frame: DataFrame, name: str, rule: Column) -> DataFrame:
    """Rows that break a rule; a null answer breaks it too."""
    return _check(f"rule:{name}", frame.where(~F.coalesce(rule, F.lit(False))))


def repeated_pages(pages: DataFrame, partition: str, page: str, ids: str) -> DataFrame:
    """Pages of a partition whose list of ids an earlier page already had. The same page seen again is none."""
    each = pages.groupBy(partition, F.sha2(F.to_json(F.col(ids)), 256).alias("_h")).agg(F.min(page).alias("first_page"))
    return pages.withColumn("_h", F.sha2(F.to_json(F.col(ids)), 256)).join(each, [partition, "_h"]).where(F.col(page) != F.col("first_page")).select(partition, page, "first_page").distinct()


def envelope(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``reason``: the name of the first rule they break, null for accepted ones."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        reason = F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(reason)
    return frame.withColumn("reason", reason)


def profile(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: rows, filled values, different values, least and greatest as text. One pass over the table."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(filled(F.col(c))).alias("filled"), F.countDistinct(c).alias("distinct"), F.min(F.col(c).cast("string")).alias("least"), F.max(F.col(c).cast("string")).alias("greatest")) for c in columns]
    return frame.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("e")).select("e.*")


def rules(frame: DataFrame, name: str, checks: dict[str, Column]) -> DataFrame:
    """Many rules over one table in one pass: (check, passed, n) for each; a null answer breaks a rule."""
    broken = [F.struct(F.lit(f"rule:{name}.{c}").alias("check"), F.count_if(~F.coalesce(r, F.lit(False))).alias("n")) for c, r in checks.items()]
    return frame.agg(F.array(*broken).alias("c")).select(F.explode("c").alias("c")).select("c.check", (F.col("c.n") == 0).alias("passed"), "c.n")
