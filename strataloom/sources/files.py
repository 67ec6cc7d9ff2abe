"""File sources and sinks: CSV, JSON lines, JSON documents, foreign SQLite databases, manifests, snapshots."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors can reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, all columns text, quoted fields over several lines, fields of any length. Empty fields are null."""
    if encoding.upper() not in ("UTF-8", "UTF-16", "ISO-8859-1", "US-ASCII"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark knows the standard character sets only
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def sniff_encoding(sample: bytes) -> str:
    """UTF-8 if the bytes are valid in it (a cut last character is allowed), else GB18030."""
    for cut in range(4):
        try:
            sample[: len(sample) - cut].decode("utf-8-sig")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "GB18030"


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV files that are UTF-8 or GB18030, told apart file by file; columns are united by name."""
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.substring("content", 1, 65536).alias("head"))
    by: dict[str, list[str]] = {}
    for row in heads.collect():  # one row a file, at most 64 KB of each
        by.setdefault(sniff_encoding(bytes(row.head)), []).append(row.path)
    frames = [read_csv(spark, paths, encoding) for encoding, paths in sorted(by.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, malformed: str = "skip") -> DataFrame:
    """JSON lines; malformed ones are skipped, an error, or kept with their text in _corrupt_record."""
    mode = {"skip": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}[malformed]
    kept = T.StructType([*schema, T.StructField("_corrupt_record", T.StringType())]) if malformed == "keep" else schema
    return spark.read.schema(kept).option("mode", mode).json(path)


def read_json_document(spark: SparkSession, path: str, element: T.StructType, field: str | None = None, lines: bool = False) -> DataFrame:
    """Rows of JSON documents that are a list, an object with a list in ``field``, or an object of objects; a document is a file, or with ``lines`` a line."""
    text = spark.read.option("wholetext", not lines).text(path).select("value")
    value = F.get_json_object("value", f"$.{field}") if field else F.col("value")
    kind = element.simpleString()
    listed = F.from_json(value, f"array<{kind}>")
    mapped = F.map_values(F.from_json(value, f"map<string,{kind}>"))
    rows = F.when(F.ltrim(value).startswith("["), listed).otherwise(mapped)
    return text.select(F.explode(rows).alias("r")).select("r.*")


def sqlite_tables(path: str) -> list[str]:
    """The tables and views of an SQLite file, its own left out."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as connection:
        return sorted(r[0] for r in connection.execute("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%'"))


def read_sqlite(spark: SparkSession, path: str, table: str, slice_rows: int = 100_000) -> DataFrame:
    """A table of an SQLite file that all executors can reach, read-only, all columns text.

    The driver asks for the columns and the greatest row number only; each task reads one range of row numbers. Views and
    tables without row numbers are one range.
    """
    known = sqlite_tables(path)
    if table not in known:
        raise ValueError(f"no table {table!r}; there are {known}")
    quoted = '"' + table.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as connection:
        names = [d[0] for d in connection.execute(f"select * from {quoted} limit 0").description]
        try:
            low, high = connection.execute(f"select min(rowid), max(rowid) from {quoted}").fetchone()
        except sqlite3.OperationalError:
            low = high = None
    ranges = [(i, min(i + slice_rows - 1, high)) for i in range(low, high + 1, slice_rows)] if low is not None else [(None, None)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, last in zip(batch["first"], batch["last"], strict=True):
                where, bounds = ("", ()) if pd.isna(first) else (" where rowid between ? and ?", (int(first), int(last)))
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as connection:
                    cursor = connection.execute(f"select * from {quoted}{where}", bounds)
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame([[None if v is None else str(v) for v in r] for r in rows], columns=names, dtype=object)

    spots = spark.createDataFrame(ranges, "first long, last long").repartition(min(len(ranges), 1000))
    return spots.mapInPandas(work, schema)


def read_sqlite_folder(spark: SparkSession, folder: str, pattern: str = "*.sqlite") -> dict[str, DataFrame]:
    """Every table of the SQLite files under a folder, by name; files that are byte for byte copies of another are read once.

    Tables of one name are united by column names, with ``source_file``.
    """
    found = manifest(spark, folder, pattern)
    first = found.groupBy("sha256").agg(F.min("path").alias("path")).orderBy("path").collect()  # one row a file
    out: dict[str, DataFrame] = {}
    for row in first:
        path = str(local_path(row.path))
        for name in sqlite_tables(path):
            frame = read_sqlite(spark, path, name).withColumn("source_file", F.lit(Path(path).name))
            out[name] = out[name].unionByName(frame, allowMissingColumns=True) if name in out else frame
    return out


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def new_files(found: DataFrame, ingested: DataFrame, kind: Column) -> DataFrame:
    """Files whose content isn't ingested yet, one a content, with their kind; files of no kind are left out."""
    fresh = found.join(ingested.select("sha256").distinct(), "sha256", "left_anti")
    first = fresh.groupBy("sha256").agg(F.min_by(F.struct(*fresh.columns), "path").alias("r")).select("r.*")
    return first.withColumn("kind", kind).where("kind is not null")


def verified(found: DataFrame, log: DataFrame) -> DataFrame:
    """Files with ``is_verified``: their hash is that of the last good retrieval (file, status, error, seq, sha256) of their name."""
    good = log.where("status = 200 and error is null").groupBy("file").agg(F.max_by("sha256", "seq").alias("expected"))
    return found.join(good, found["name"] == good["file"], "left").withColumn("is_verified", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False))).drop("file")


#: The byte-order mark that spreadsheet programs tell UTF-8 by.
MARK = "\ufeff"


def write_csv(frame: DataFrame, path: str, order: Sequence[Column | str] = (), mode: str = "errorifexists", mark: bool = False) -> None:
    """CSV with a header. With an order the files hold consecutive ranges of it, with ``mark`` each starts with a byte-order mark."""
    if mark:
        frame = frame.withColumnRenamed(frame.columns[0], MARK + frame.columns[0])
        order = [MARK + c if MARK + str(c) == frame.columns[0] else c for c in order]
    (frame.sort(*order) if order else frame).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_lines(frame: DataFrame, path: str, order: Sequence[Column | str] = (), partition: str | None = None) -> None:
    writer = (frame.sort(*order) if order else frame).write.mode("errorifexists").option("ignoreNullFields", False)
    (writer.partitionBy(partition) if partition else writer).json(path)


def views(tables: dict[str, DataFrame]) -> None:
    """Session views of the tables, for SQL."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def _refuse_inputs(tables: dict[str, DataFrame], folder: str) -> None:
    """An output folder must not hold, or lie in, what the tables are read from."""
    target = folder.removeprefix("file://").removeprefix("file:").rstrip("/") + "/"
    for name, frame in tables.items():
        for file in frame.inputFiles():
            source = file.removeprefix("file://").removeprefix("file:")
            if source.startswith(target) and "/_versions/" not in source:
                raise ValueError(f"{folder} holds the input of {name}")


def write_snapshot(tables: dict[str, DataFrame], folder: str, compression: str = "snappy", kind: str = "parquet", apart: bool = True) -> str:
    """All tables under a version folder, then the pointer to it: a reader sees whole snapshots only. Returns the version.

    ``kind`` is parquet or json, ``compression`` a codec of that format (gzip for both). With ``apart`` a folder that
    the tables themselves are read from is refused; without it, a new version may be made from an older one.
    """
    if apart:
        _refuse_inputs(tables, folder)
    version = uuid.uuid4().hex
    for name, frame in tables.items():
        frame.write.mode("errorifexists").option("compression", compression).option("ignoreNullFields", False).format(kind).save(f"{folder}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    schemas = {name: frame.schema.json() for name, frame in tables.items()}
    pointer = spark.createDataFrame([(version, kind, schemas)], "version string, kind string, schemas map<string,string>")
    pointer.coalesce(1).withColumn("written_at", F.current_timestamp()).write.mode("append").json(f"{folder}/_versions")
    return version


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest snapshot."""
    newest = spark.read.schema("version string, kind string, schemas map<string,string>, written_at timestamp").json(f"{folder}/_versions").orderBy(F.desc("written_at")).first()
    read = spark.read.format(newest.kind)
    return {name: read.schema(T.StructType.fromJson(json.loads(schema))).load(f"{folder}/{newest.version}/{name}") for name, schema in sorted(newest.schemas.items())}


def schema_document(frames: dict[str, DataFrame]) -> str:
    """JSON of all schemas."""
    return "{" + ",".join(f'"{name}":{frame.schema.json()}' for name, frame in sorted(frames.items())) + "}"


def summary_document(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns, schema, content) of every table: content is a sum of row hashes, the same for the same rows in any order."""
    parts = [
        frame.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*frame.columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("content")).select(
            F.lit(name).alias("name"), "rows", F.lit(len(frame.columns)).alias("columns"), F.lit(frame.schema.json()).alias("schema"), "content"
        )
        for name, frame in sorted(frames.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def git_blob_hash(content: bytes) -> str:
    """The object id that git gives to a file of this content."""
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def local_path(uri: str) -> Path:
    return Path(uri.removeprefix("file://").removeprefix("file:"))
