"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    """A table by name, reduced to the given columns so that the scan reads no others."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame
