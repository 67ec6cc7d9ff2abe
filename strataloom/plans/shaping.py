"""Queries of scans, sinks, projections, parsing and scalar functions, and of the streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import dates, scalars
from strataloom.functions.text import squeeze
from strataloom.operators import coverage, order
from strataloom.plans.evidence import LOG, log
from strataloom.sources import files
from strataloom.sources.tables import table
from strataloom.streaming import current

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: White space in the oracle's regular expressions.
_WS = r"[\s\x{00a0}\x{3000}\x{2000}-\x{200b}\x{feff}]"


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Registers a query, with the SQL that gives the same rows."""

    def add(function):  # noqa: ANN001, ANN202
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("s01_csv_round_trip", "SELECT work_key, platform, nullif(title, '') AS title, nullif(author, '') AS author, nullif(synopsis, '') AS synopsis FROM work_master")
def s1(spark: SparkSession, folder: str) -> DataFrame:
    """Written as CSV in ranges and read again, with quotes and line ends inside fields."""
    path = files.scratch(spark, "csv")
    works = table(spark, folder, "work_master", "work_key", "platform", "title", "author", "synopsis")
    files.write_csv(works, path, ["work_key"])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in works.columns])
    return files.read_csv(spark, path, schema=schema)


@query("s04_json_lines", "SELECT platform, work_id, title, status FROM works WHERE title IS NOT NULL")
def s4(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines with malformed ones among them, which are skipped."""
    path = files.scratch(spark, "jsonl")
    works = table(spark, folder, "works", "platform", "work_id", "title", "status").where("title is not null")
    lines = works.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.unionByName(lines.limit(3).select(F.lit("{broken").alias("value"))).write.text(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in works.columns])
    return files.read_json_lines(spark, path, schema).where("title is not null")


@query("s06_json_document", "SELECT platform, work_id FROM works WHERE work_id IS NOT NULL")
def s6(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a list of books each."""
    path = files.scratch(spark, "json")
    works = table(spark, folder, "works", "platform", "work_id").where("work_id is not null")
    # About a thousand books a document, however many there are.
    books = max(1, works.count() // 1000)
    per = works.groupBy(F.pmod(F.xxhash64("platform", "work_id"), F.lit(books)).alias("b")).agg(F.collect_list(F.struct("platform", "work_id")).alias("books"))
    per.select(F.to_json(F.struct("books")).alias("value")).write.text(path)
    return files.read_json_document(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in works.columns]), "books", lines=True)


@query("s16_snapshot", "SELECT 'dates' AS name, count(*) AS rows FROM work_dates UNION ALL SELECT 'works', count(*) FROM works")
def s16(spark: SparkSession, folder: str) -> DataFrame:
    """Counts read back from a published snapshot."""
    path = files.scratch(spark, "snapshot")
    files.write_snapshot({"works": table(spark, folder, "works"), "dates": table(spark, folder, "work_dates")}, path)
    return coverage.cardinalities(files.read_snapshot(spark, path))


@query("s14_ordered_sink", "SELECT platform, work_id, row_number() OVER (ORDER BY platform, CAST(work_id AS BIGINT)) - 1 AS place FROM (SELECT DISTINCT platform, work_id FROM works)")
def s14(spark: SparkSession, folder: str) -> DataFrame:
    works = table(spark, folder, "works", "platform", "work_id").distinct().withColumn("n", F.col("work_id").cast("decimal(38,0)"))
    return order.numbered(works, ["platform", "n"], "place").select("platform", "work_id", "place")


@query("pj01_canonical_record", "SELECT legacy_id AS record_id, 'legacy_list' AS origin, title, author, TRY_CAST(json_extract_string(raw_record_json, '$.t') AS VARCHAR) AS raw_title FROM legacy_bibliography")
def p1(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "legacy_bibliography", "legacy_id", "title", "author", "raw_record_json").select(
        F.col("legacy_id").alias("record_id"), F.lit("legacy_list").alias("origin"), "title", "author", F.get_json_object("raw_record_json", "$.t").alias("raw_title")
    )


@query("pj02_first_filled", f"SELECT work_key, coalesce(CASE WHEN trim(regexp_replace(title, '{_WS}', ' ', 'g')) <> '' THEN title END, CASE WHEN trim(regexp_replace(author, '{_WS}', ' ', 'g')) <> '' THEN author END, work_key) AS label FROM work_master")
def p2(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "work_master", "work_key", "title", "author").select("work_key", scalars.first_filled(F.col("title"), F.col("author"), F.col("work_key")).alias("label"))


@query("pj03_digit_ids", "SELECT word_count, coalesce(regexp_matches(word_count, '^[0-9]+$'), false) AS digits, coalesce(regexp_matches(word_count, '^[1-9][0-9]*$'), false) AS positive, coalesce(regexp_matches(word_count, '^[0-9]'), false) AS starts FROM work_master")
def p3(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("word_count")
    return table(spark, folder, "work_master", "word_count").select(c, scalars.digits_only(c).alias("digits"), scalars.digits_only(c, positive=True).alias("positive"), scalars.starts_with_digit(c).alias("starts"))


@query("pj04_id_from_url", "SELECT work_key, nullif(regexp_extract(work_url, '^https?://[a-z.]*[.]books[.]example/book/([0-9]+)/?$', 1), '') AS id FROM work_master")
def p4(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "work_master", "work_key", "work_url").select("work_key", scalars.id_from_path(F.col("work_url"), "books.example", "/book/([0-9]+)/?").alias("id"))


@query("pj05_url_agreement", "SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(regexp_extract(work_url, '/book/([0-9]+)', 1) = platform_work_id, false)) AS agree FROM work_master")
def p5(spark: SparkSession, folder: str) -> DataFrame:
    same = scalars.id_from_path(F.col("work_url"), "books.example", "/book/([0-9]+)/?") == F.col("platform_work_id")
    return table(spark, folder, "work_master", "work_url", "platform_work_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(same, F.lit(False))).alias("agree"))


@query("pj06_allow_list", "SELECT work_key FROM work_master WHERE genre_raw IS NULL OR genre_raw LIKE '%-%'")
def p6(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "work_master", "work_key", "genre_raw").where(F.col("genre_raw").isNull() | F.col("genre_raw").contains("-")).select("work_key")


@query("pj08_range_clean", "SELECT legacy_id, CASE WHEN source_reported_year BETWEEN 1990 AND 2026 THEN source_reported_year END AS year, CASE WHEN source_reported_month BETWEEN 1 AND 12 THEN source_reported_month END AS month FROM legacy_bibliography")
def p8(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "legacy_bibliography", "legacy_id", "source_reported_year", "source_reported_month").select("legacy_id", scalars.in_range(F.col("source_reported_year"), 1990, 2026).alias("year"), scalars.in_range(F.col("source_reported_month"), 1, 12).alias("month"))


@query("pj10_split_composite", "SELECT work_key, CASE WHEN len(string_split(genre_raw, '-')) <= 4 THEN string_split(genre_raw, '-')[1] END AS kind, CASE WHEN len(string_split(genre_raw, '-')) <= 4 THEN string_split(genre_raw, '-')[2] END AS line, CASE WHEN len(string_split(genre_raw, '-')) <= 4 THEN string_split(genre_raw, '-')[3] END AS era, CASE WHEN len(string_split(genre_raw, '-')) <= 4 THEN string_split(genre_raw, '-')[4] END AS theme FROM work_master")
def p10(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "work_master", "work_key", "genre_raw").select("work_key", *scalars.split_composite(F.col("genre_raw"), ["kind", "line", "era", "theme"]))


@query("pj11_between_markers", "SELECT doc_id, CASE WHEN contains(text, '简介：') THEN trim(split_part(substr(text, instr(text, '简介：') + 3), '。', 1)) END AS intro FROM documents WHERE text IS NOT NULL")
def p11(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", scalars.between_markers(F.col("text"), "简介：", "。").alias("intro"))


@query("pj23_quarantine", "SELECT source_id, count(*) AS rows FROM source_observation WHERE source_id IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(starts_with(raw_record_json, '{\"code\"'), false))")
def p23(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_observation", "source_id", "raw_record_json").where("source_id is not null")
    return coverage.quarantined(rows, "source_id", F.col("raw_record_json").startswith('{"code"'))


@query("pj25_unpivot", "SELECT work_key, 'title' AS field, title AS value FROM works_ UNION ALL SELECT work_key, 'author', author FROM works_".replace("works_", "(SELECT * FROM work_master WHERE title IS NOT NULL AND author IS NOT NULL)"))
def p25(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "work_master", "work_key", "title", "author").dropna().unpivot(["work_key"], ["title", "author"], "field", "value")


@query("pj28_missing_flag", f"SELECT work_key, nullif(trim(regexp_replace(title, '{_WS}+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(title, '{_WS}+', ' ', 'g')), '') IS NULL AS title_missing FROM work_master")
def p28(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "work_master", "work_key", "title").select("work_key", squeeze(F.col("title")).alias("title"), squeeze(F.col("title")).isNull().alias("title_missing"))


_PLAIN = f"replace(trim(regexp_replace(word_count, '{_WS}+', ' ', 'g')), ',', '')"
_TIMES = "CASE regexp_extract(p, '(万|亿)', 1) WHEN '万' THEN 10000 WHEN '亿' THEN 100000000 ELSE 1 END"


@query("f02_display_number", f"""WITH w AS (SELECT word_count, {_PLAIN} AS p, trim(regexp_replace(word_count, '{_WS}+', ' ', 'g')) AS q FROM work_master), n AS (SELECT *, TRY_CAST(regexp_extract(p, '^([0-9]+(?:\\.[0-9]+)?)', 1) AS DECIMAL(24,8)) * {_TIMES} AS v FROM w)
SELECT word_count, CASE WHEN regexp_matches(p, '^[0-9]+(\\.[0-9]+)?(万|亿)?(字|周)?$') THEN floor(v)::BIGINT END AS shown, CASE WHEN regexp_matches(q, '^[0-9]+(\\.[0-9]+)?(万|亿)?字$') AND v = floor(v) THEN v::BIGINT END AS exact,
TRY_CAST(CASE WHEN regexp_matches(regexp_replace(p, '字$', ''), '^[+-]?[0-9]+$') THEN regexp_replace(p, '字$', '') END AS BIGINT) AS whole FROM n""")  # fmt: skip
def f2(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("word_count")
    return table(spark, folder, "work_master", "word_count").select(c, scalars.display_number(c).alias("shown"), scalars.display_number(c, exact=True).alias("exact"), scalars.plain_integer(c).alias("whole"))


@query("f05_years_and_dates", """SELECT date_raw, TRY_CAST(nullif(regexp_extract(date_raw, '((?:19|20)[0-9]{2})', 1), '') AS INTEGER) AS year, regexp_matches(date_raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$') AND TRY_CAST(date_raw AS TIMESTAMP) IS NOT NULL AS full
FROM (SELECT DISTINCT date_raw FROM source_observation WHERE date_raw IS NOT NULL)""")  # fmt: skip
def f5(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("date_raw")
    return table(spark, folder, "source_observation", "date_raw").where("date_raw is not null").distinct().select(c, dates.year_of(c).alias("year"), dates.is_timestamp(c).alias("full"))


_DAY, _TIME = "(?:19|20)[0-9]{2}[-/年][0-9]{1,2}[-/月][0-9]{1,2}", "[ T]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?"


@query("f06_date_value", f"""WITH d AS (SELECT DISTINCT date_raw, regexp_extract_all(regexp_extract(date_raw, '(?:^|[^0-9])({_DAY}日?(?:{_TIME})?)', 1), '[0-9]+') AS n FROM source_observation WHERE date_raw IS NOT NULL),
v AS (SELECT date_raw, len(n) AS k, printf('%s-%02d-%02d', n[1], n[2]::INTEGER, n[3]::INTEGER) AS day, printf('%02d:%02d:%02d', n[4]::INTEGER, n[5]::INTEGER, coalesce(n[6], '0')::INTEGER) AS clock FROM d)
SELECT date_raw, CASE WHEN k >= 4 AND TRY_CAST(day || ' ' || clock AS TIMESTAMP) IS NOT NULL THEN day || ' ' || clock WHEN k = 3 AND TRY_CAST(day AS DATE) IS NOT NULL THEN day END AS value FROM v""")  # fmt: skip
def f6(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("date_raw")
    return table(spark, folder, "source_observation", "date_raw").where("date_raw is not null").distinct().select(c, dates.date_value(c).alias("value"))


@query("f07_first_date", "SELECT DISTINCT date_raw, CASE WHEN g.y <> '' THEN g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') END AS value FROM (SELECT date_raw, regexp_extract(date_raw, '((?:19|20)[0-9]{2})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})', ['y', 'm', 'd']) AS g FROM source_observation WHERE date_raw IS NOT NULL)")
def f7(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("date_raw")
    return table(spark, folder, "source_observation", "date_raw").where("date_raw is not null").distinct().select(c, dates.first_date(c).alias("value"))


@query("f08_labelled_date", "SELECT publication_date, CASE WHEN g.y <> '' AND TRY_CAST(g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') AS DATE) IS NOT NULL THEN g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') END AS value FROM (SELECT DISTINCT publication_date, regexp_extract(publication_date, '章节首发时间[ \t]*[：:][ \t]*((?:19|20)[0-9]{2})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})', ['y', 'm', 'd']) AS g FROM chapters WHERE publication_date LIKE '章节首发时间%')")
def f8(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("publication_date")
    rows = table(spark, folder, "chapters", "publication_date").where("publication_date like '章节首发时间%'").distinct()
    return rows.select(c, F.substring(dates.date_value(c, "章节首发时间"), 1, 10).alias("value"))


@query("f12_status_and_class", "SELECT status_raw, genre_raw, coalesce(lower(trim(status_raw)) IN ('完本', '已完成', '完结', 'completed', 'finished'), false) AS complete, CASE WHEN genre_raw IN ('评论', '诗歌', '随笔') THEN 'non_novel' WHEN genre_raw LIKE '%-%' THEN 'novel_like' ELSE 'unresolved' END AS sample_class FROM work_master")
def f12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "work_master", "status_raw", "genre_raw")
    return rows.select("status_raw", "genre_raw", scalars.is_complete(F.col("status_raw"), scalars.COMPLETE_REFRESH).alias("complete"), scalars.sample_class(F.col("genre_raw")).alias("sample_class"))


@query("f14_normal_name")
def f14(spark: SparkSession, folder: str) -> DataFrame:
    """Every title under its normal name, with the number of spellings that share it."""
    titles = table(spark, folder, "legacy_bibliography", "title").dropna().distinct().withColumn("name", scalars.normal_name(F.col("title")))
    spellings = titles.groupBy("name").agg(F.count(F.lit(1)).alias("spellings"))
    return titles.join(spellings, "name").select("title", "name", "spellings")


@query("f15_url_parts", "SELECT work_url, regexp_extract(work_url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(work_url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM work_master WHERE work_url IS NOT NULL")
def f15(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("work_url")
    return table(spark, folder, "work_master", "work_url").where("work_url is not null").select(c, scalars.url_part(c, "HOST").alias("host"), scalars.url_part(c, "PATH").alias("path"))


@query("f16_scrubbed_url", "SELECT conflict_id, 'https://x.example/p?b=' || field AS url FROM metadata_conflict WHERE conflict_id IS NOT NULL AND field IS NOT NULL")
def f16(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "metadata_conflict", "conflict_id", "field").dropna()
    url = F.concat(F.lit("https://x.example/p?Token="), "conflict_id", F.lit("&b="), "field", F.lit("#f"))
    return rows.select("conflict_id", scalars.without_query_keys(url, "token|session|key").alias("url"))


@query("f17_canonical_json", "SELECT work_key, to_json(struct_pack(author := author, title := title))::VARCHAR AS j FROM work_master")
def f17(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "work_master", "work_key", "title", "author")
    return rows.select("work_key", scalars.canonical_json(title=F.col("title"), author=F.col("author")).alias("j"))


@query("f19_identity", "SELECT observation_id, sha256(source_id || chr(31) || row_locator) AS id FROM source_observation WHERE source_id IS NOT NULL AND row_locator IS NOT NULL")
def f19(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_observation", "observation_id", "source_id", "row_locator").dropna().select("observation_id", scalars.identity(F.col("source_id"), F.col("row_locator")).alias("id"))


@query("f20_literal_list", "SELECT platform, work_id, source, count(*) AS n FROM (SELECT platform, work_id, unnest(CAST(json_extract(seed_sources_json, '$[*]') AS VARCHAR[])) AS s FROM works), (SELECT 1), LATERAL (SELECT trim(s, '\"') AS source) GROUP BY 1, 2, 3")
def f20(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "works", "platform", "work_id", "seed_sources_json")
    return rows.select("platform", "work_id", F.explode(scalars.literal_list(F.col("seed_sources_json"))).alias("source")).groupBy("platform", "work_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("f21_iso_week", "SELECT week, count(*) AS n FROM (SELECT printf('%d-W%02d', isoyear(ts), weekofyear(ts)) AS week FROM events) GROUP BY 1")
def f21(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "ts").groupBy(dates.iso_week(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("f22_backoff", "WITH f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY 1) SELECT user_id, CASE WHEN c >= 5 THEN greatest(least(86400.0, 30 * pow(2.0, least(c - 1, 12))), 3600.0) ELSE least(86400.0, 30 * pow(2.0, least(c - 1, 12))) END::DOUBLE AS seconds FROM f")
def f22(spark: SparkSession, folder: str) -> DataFrame:
    count = table(spark, folder, "events", "user_id", "event_type").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("c"))
    return count.select("user_id", scalars.backoff_seconds(F.col("c"), F.lit(None)).alias("seconds"))


@query("f27_all_dates", "SELECT observation_id, array_to_string(list_slice(list_distinct_ordered, 1, 5), ',') AS found FROM (SELECT observation_id, [x for x, i in l if list_position(l, x) = i] AS list_distinct_ordered FROM (SELECT observation_id, regexp_extract_all(date_raw || ' ' || observed_at, '((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})', 1) AS l FROM source_observation WHERE date_raw IS NOT NULL AND observed_at IS NOT NULL))")
def f27(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_observation", "observation_id", "date_raw", "observed_at").dropna()
    return rows.select("observation_id", F.array_join(dates.all_dates(F.concat_ws(" ", "date_raw", "observed_at"), 5), ",").alias("found"))


@query("f28_decoded", "SELECT field, CASE field WHEN 'title' THEN 'name' WHEN 'author' THEN 'person' ELSE 'unknown' END AS kind, count(*) AS n FROM metadata_conflict GROUP BY 1, 2")
def f28(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "metadata_conflict", "field").groupBy("field", scalars.decode_code(F.col("field"), {"title": "name", "author": "person"}).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("t06_stream_newest", f"WITH {LOG} SELECT work_key, first(status_raw ORDER BY observed_at DESC, status_raw) AS status_raw, max(observed_at) AS observed_at FROM log WHERE observed_at IS NOT NULL AND trim(status_raw) <> '' GROUP BY 1")
def t6(spark: SparkSession, folder: str) -> DataFrame:
    """The newest status of every work, kept by a stream that reads the log file by file."""
    source, sink, mark = (files.scratch(spark, n) for n in ("in", "out", "mark"))
    rows = log(spark, folder).where("observed_at is not null").select("work_key", "status_raw", "observed_at")
    rows.repartition(4, "work_key").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    updates = current.newest_wins(stream, "work_key", "observed_at", "status_raw")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    updates.writeStream.foreachBatch(keep).option("checkpointLocation", mark).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).groupBy("work_key").agg(F.max_by(F.struct("status_raw", "observed_at"), F.struct("observed_at", "batch")).alias("r")).select("work_key", "r.*")


@query("t13_stream_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t13(spark: SparkSession, folder: str) -> DataFrame:
    """Events by window and kind, by a stream that stops when all is read; the last windows are closed by a later row."""
    source, sink, mark = (files.scratch(spark, n) for n in ("in", "out", "mark"))
    rows = table(spark, folder, "events", "ts", "event_type")
    rows.write.parquet(source)
    rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit("close").alias("event_type")).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    current.drain(current.windowed_counts(stream, "ts", "6 hours", "2 days", "event_type"), sink, mark)
    found = spark.read.parquet(sink).where("event_type <> 'close'")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
