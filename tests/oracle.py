"""Runs a query and its SQL side by side and compares columns, row counts and values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def plain(value: object) -> object:
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return str(value).removesuffix("+00:00")
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def compare(spark: SparkSession, query, sql: str, folder: str) -> str:
    """'' if both agree, else what differs."""
    frame = query(spark, folder)
    names = sorted(frame.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in frame.collect())
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = connection.sql(sql)
    if sorted(found.columns) != names:
        return f"columns {names} and {sorted(found.columns)}"
    order = [found.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only in Spark {list((ours - theirs).items())[:3]}; only in SQL {list((theirs - ours).items())[:3]}"
