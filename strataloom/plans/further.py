"""Further queries: date evidence, reconciliation, ordering and accounting forms that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import dates, scalars
from strataloom.operators import audit, chapters, coverage, events, match, merge, order
from strataloom.plans.evidence import _ROLE, LOG, log
from strataloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Registers a query, with the SQL that gives the same rows."""

    def add(function):  # noqa: ANN001, ANN202
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})?$"
_CANON = f"""CASE WHEN regexp_matches(v, '{_STAMP}') AND TRY_CAST(replace(substr(v, 1, 19), 'T', ' ') AS TIMESTAMP) IS NOT NULL THEN
 length(regexp_extract(v, '([.][0-9]{{1,6}})', 1))::VARCHAR || '|' || (epoch_us(TRY_CAST(replace(substr(v, 1, 19), 'T', ' ') || regexp_extract(v, '([.][0-9]{{1,6}})', 1) AS TIMESTAMP)) - (CASE WHEN right(v, 1) = 'Z' THEN 0
 WHEN regexp_matches(v, '[+-][0-9]{{2}}:[0-9]{{2}}$') THEN (CASE WHEN v[-6] = '-' THEN -1 ELSE 1 END) * (substr(v, length(v) - 4, 2)::BIGINT * 3600 + right(v, 2)::BIGINT * 60) ELSE 28800 END) * 1000000)::VARCHAR ELSE v END"""


@query("d05_same_moment", f"SELECT v AS value, {_CANON} AS moment FROM (SELECT DISTINCT date_raw AS v FROM source_observation WHERE date_raw IS NOT NULL)")
def d5(spark: SparkSession, folder: str) -> DataFrame:
    values = table(spark, folder, "source_observation", "date_raw").where("date_raw is not null").distinct()
    return values.select(F.col("date_raw").alias("value"), dates.same_moment_key(F.col("date_raw")).alias("moment"))


_DAY = "substr(observed_at, 1, 7)"


@query("d06_current_value", f"""WITH {LOG}, s AS (SELECT work_key, seq, {_DAY} AS m, date_raw AS v FROM log WHERE observed_at IS NOT NULL AND trim(date_raw) <> ''),
c AS (SELECT *, {_CANON} AS c, max(m) OVER (PARTITION BY work_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM s), r AS (SELECT * FROM c WHERE pm IS NULL OR m > pm),
n AS (SELECT *, c IS DISTINCT FROM lag(c) OVER (PARTITION BY work_key ORDER BY seq) AS fresh FROM r) SELECT work_key, arg_max(v, seq) FILTER (WHERE fresh) AS date_raw, max(m) AS last_ts FROM n GROUP BY 1""")  # fmt: skip
def d6(spark: SparkSession, folder: str) -> DataFrame:
    """The newest date of a work in the spelling in which its run of equivalent dates began; time is the month of sighting."""
    seen = log(spark, folder).where("observed_at is not null").withColumn("month", F.substring("observed_at", 1, 7))
    return merge.sticky_newest(seen, ["work_key"], "seq", "month", "date_raw", dates.same_moment_key(F.col("date_raw")))


@query("d06_conflicts", f"""WITH {LOG}, s AS (SELECT work_key, seq, {_DAY} AS m, date_raw AS v FROM log WHERE observed_at IS NOT NULL AND trim(date_raw) <> ''), c AS (SELECT *, {_CANON} AS c FROM s),
p AS (SELECT *, max(struct_pack(t := m, s := -seq, v := v, c := c)) OVER (PARTITION BY work_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c)
SELECT work_key, seq, prev.v AS value_retained, v AS value_alternative FROM p WHERE prev.t = m AND prev.c <> c""")  # fmt: skip
def d6c(spark: SparkSession, folder: str) -> DataFrame:
    seen = log(spark, folder).where("observed_at is not null").withColumn("month", F.substring("observed_at", 1, 7))
    return merge.newest_wins_conflicts(seen, ["work_key"], "seq", "month", "date_raw", dates.same_moment_key(F.col("date_raw")))


@query("d03_chapter_dates", """WITH r AS (SELECT platform || ':' || work_id AS work_key, TRY_CAST(chapter_number AS BIGINT) AS n, publication_date AS p, update_date AS u FROM chapters), f AS (SELECT work_key, min(n) AS a, max(n) AS b FROM r WHERE n IS NOT NULL GROUP BY 1)
SELECT work_key, 'first_chapter_publication' AS role, max(p) AS value FROM r JOIN f USING (work_key) WHERE n = a AND p IS NOT NULL GROUP BY 1 UNION ALL SELECT work_key, 'last_chapter_publication', max(p) FROM r JOIN f USING (work_key) WHERE n = b AND p IS NOT NULL GROUP BY 1
UNION ALL SELECT work_key, 'first_chapter_update', max(u) FROM r JOIN f USING (work_key) WHERE n = a AND u IS NOT NULL GROUP BY 1""")  # fmt: skip
def d3(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of the first and last chapters as evidence rows; several rows of a chapter give the greatest text."""
    rows = table(spark, folder, "chapters", "platform", "work_id", "chapter_number", "publication_date", "update_date")
    keyed = rows.select(F.concat_ws(":", "platform", "work_id").alias("work_key"), F.col("chapter_number").try_cast("bigint").alias("n"), "publication_date", "update_date").where("n is not null")
    ends = keyed.groupBy("work_key").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    at = keyed.join(ends, "work_key").where("n = a or n = b").groupBy("work_key").agg(
        F.max(F.when(F.col("n") == F.col("a"), F.col("publication_date"))).alias("first_chapter_publication"), F.max(F.when(F.col("n") == F.col("b"), F.col("publication_date"))).alias("last_chapter_publication"), F.max(F.when(F.col("n") == F.col("a"), F.col("update_date"))).alias("first_chapter_update")
    )
    return at.select("work_key", F.explode(dates.stack_roles({c: c for c in at.columns[1:]})).alias("e")).select("work_key", "e.*")


@query("d11_basis_map", """SELECT work_key, '{' || concat_ws(',', CASE WHEN first_chapter_publication_date IS NOT NULL THEN '"first":"chapter"' END, CASE WHEN catalog_pub_date IS NOT NULL THEN '"catalog":"page"' END) || '}' AS basis FROM work_dates""")
def d11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "work_dates", "work_key", "first_chapter_publication_date", "catalog_pub_date")
    basis = F.create_map(F.lit("first"), F.when(F.col("first_chapter_publication_date").isNotNull(), "chapter"), F.lit("catalog"), F.when(F.col("catalog_pub_date").isNotNull(), "page"))
    return rows.select("work_key", F.to_json(F.map_filter(basis, lambda _, v: v.isNotNull())).alias("basis"))


@query("d13_completion_candidates", f"""WITH r AS (SELECT DISTINCT platform || ':' || work_id AS work_key, TRY_CAST(chapter_number AS BIGINT) AS n, coalesce(trim(regexp_replace(chapter_title, '\\s+', ' ', 'g')), '') AS t FROM chapters WHERE TRY_CAST(chapter_number AS BIGINT) IS NOT NULL),
e AS (SELECT work_key, n, {_ROLE} AS role FROM r), l AS (SELECT work_key, max(n) AS n FROM r GROUP BY 1)
SELECT DISTINCT work_key, n AS ordinal, role FROM e WHERE role IS NOT NULL UNION SELECT l.work_key, l.n, 'completed_status_last_visible_chapter' FROM l JOIN work_master m USING (work_key) WHERE lower(trim(m.status_raw)) IN ('完本', '已完成', '完结', 'completed', 'finished')""")  # fmt: skip
def d13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chapters", "platform", "work_id", "chapter_number", "chapter_title").select(F.concat_ws(":", "platform", "work_id").alias("work_key"), F.col("chapter_number").try_cast("bigint").alias("ordinal"), "chapter_title").where("ordinal is not null")
    marked = rows.withColumn("role", scalars.ending_role(F.col("chapter_title"))).where("role is not null").select("work_key", "ordinal", "role")
    done = table(spark, folder, "work_master", "work_key", "status_raw").where(scalars.is_complete(F.col("status_raw"), scalars.COMPLETE_REFRESH))
    last = rows.groupBy("work_key").agg(F.max("ordinal").alias("ordinal")).join(done.select("work_key"), "work_key", "left_semi").withColumn("role", F.lit("completed_status_last_visible_chapter"))
    return marked.union(last).distinct()


@query("d16_never_promoted", "SELECT 'rule:unverified' AS \"check\", count(*) FILTER (WHERE first_pub_year_verified IS NOT NULL) = 0 AS passed, count(*) FILTER (WHERE first_pub_year_verified IS NOT NULL) AS n FROM work_master")
def d16(spark: SparkSession, folder: str) -> DataFrame:
    return audit.holds(table(spark, folder, "work_master", "first_pub_year_verified"), "unverified", F.col("first_pub_year_verified").isNull())


@query("j05_existence", "SELECT conflict_id FROM metadata_conflict c WHERE EXISTS (SELECT 1 FROM source_observation o WHERE o.observation_id = c.observation_id)")
def j5(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "metadata_conflict", "conflict_id", "observation_id").join(table(spark, folder, "source_observation", "observation_id"), "observation_id", "left_semi").select("conflict_id")


@query("j11_barrier", f"WITH {LOG}, b AS (SELECT work_key, coalesce(max(seq) FILTER (WHERE status_raw IN ('完结', '完本')), 0) AS b FROM log GROUP BY 1) SELECT l.work_key, l.observation_id FROM log l JOIN b USING (work_key) WHERE l.seq > b.b")
def j11(spark: SparkSession, folder: str) -> DataFrame:
    return events.since_reset(log(spark, folder), ["work_key"], "seq", F.col("status_raw").isin("完结", "完本")).select("work_key", "observation_id")


@query("j15_identity_lookup", "SELECT c.conflict_id, m.platform, m.platform_work_id FROM metadata_conflict c JOIN work_master m ON c.work_key = m.work_key")
def j15(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "metadata_conflict", "conflict_id", "work_key").join(table(spark, folder, "work_master", "work_key", "platform", "platform_work_id"), "work_key").drop("work_key")


@query("a09_having", "SELECT title, count(*) AS n FROM work_master WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a9(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "work_master", "title").where("title is not null").groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a13_batch_extent", f"WITH {LOG} SELECT source_id, count(DISTINCT work_key) AS works, min(observed_at) AS first, max(observed_at) AS last FROM log GROUP BY 1")
def a13(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).groupBy("source_id").agg(F.countDistinct("work_key").alias("works"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"))


@query("a15_gate", "SELECT (SELECT count(*) = count(DISTINCT work_key) FROM work_master) AND (SELECT count(*) = count(DISTINCT work_key) FROM work_dates) AS passed, 2 - (SELECT (count(*) = count(DISTINCT work_key))::BIGINT FROM work_master) - (SELECT (count(*) = count(DISTINCT work_key))::BIGINT FROM work_dates) AS failed")
def a15(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.gate(audit.union([audit.unique(table(spark, folder, n, "work_key"), n, ["work_key"]) for n in ("work_master", "work_dates")]))


@query("a18_annual_coverage", """WITH y AS (SELECT declared_pub_year AS year, count(*) AS observations, count(DISTINCT work_key) AS works, count(DISTINCT source_id) AS pages FROM source_observation WHERE declared_pub_year IS NOT NULL GROUP BY 1)
SELECT year, observations, works, pages, CASE WHEN pages = 1 THEN 'first_page_only' ELSE 'covered' END AS status FROM y""")  # fmt: skip
def a18(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_observation", "declared_pub_year", "work_key", "source_id").where("declared_pub_year is not null")
    per = rows.groupBy(F.col("declared_pub_year").alias("year")).agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("work_key").alias("works"), F.countDistinct("source_id").alias("pages"))
    return per.withColumn("status", F.when(F.col("pages") == 1, "first_page_only").otherwise("covered"))


@query("w03_partition_threshold", "WITH r AS (SELECT platform, work_id, chapter_key, TRY_CAST(chapter_number AS BIGINT) AS n FROM chapters), m AS (SELECT platform, work_id, max(n) AS m FROM r GROUP BY 1, 2) SELECT platform, work_id, count(DISTINCT chapter_key) AS late FROM r JOIN m USING (platform, work_id) WHERE n >= m * 0.6 GROUP BY 1, 2")
def w3(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters in the last part of their work. The partition's maximum comes from a grouped aggregate, so a hot work needs no window."""
    rows = table(spark, folder, "chapters", "platform", "work_id", "chapter_key", "chapter_number").withColumn("n", F.col("chapter_number").try_cast("bigint")).where("n is not null")
    most = rows.groupBy("platform", "work_id").agg(F.max("n").alias("m"))
    return rows.join(most, ["platform", "work_id"]).where(F.col("n") >= F.col("m") * chapters.LATE).groupBy("platform", "work_id").agg(F.countDistinct("chapter_key").alias("late"))


@query("w06_repeated_keys", "SELECT platform, work_id, chapter_key, count(*) AS n FROM chapters GROUP BY 1, 2, 3 HAVING count(*) > 1")
def w6(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["platform", "work_id", "chapter_key"]
    return coverage.collapsed(table(spark, folder, "chapters", *keys), keys).where("multiplicity > 1").withColumnRenamed("multiplicity", "n")


@query("o01_cast_order", "SELECT work_key, row_number() OVER (ORDER BY CAST(coalesce(nullif(platform_work_id, ''), '0') AS BIGINT), work_key) - 1 AS place FROM work_master")
def o1(spark: SparkSession, folder: str) -> DataFrame:
    works = table(spark, folder, "work_master", "work_key", "platform_work_id").withColumn("n", F.coalesce(F.nullif("platform_work_id", F.lit("")), F.lit("0")).cast("bigint"))
    return order.numbered(works, ["n", "work_key"], "place").select("work_key", "place")


@query("o02_nulls_last", "SELECT legacy_id, row_number() OVER (ORDER BY source_reported_year NULLS LAST, legacy_id) - 1 AS place FROM legacy_bibliography")
def o2(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "legacy_bibliography", "legacy_id", "source_reported_year")
    return order.numbered(rows, [F.asc_nulls_last("source_reported_year"), F.col("legacy_id")], "place").select("legacy_id", "place")


@query("o06_seeded_sample", "SELECT doc_id, CASE WHEN n <= 50 THEN 1.0::DOUBLE ELSE 49::DOUBLE / (n - 1) END AS probability FROM (SELECT doc_id, count(*) OVER () AS n FROM documents) ORDER BY md5('20250101:' || doc_id::VARCHAR), doc_id LIMIT 50")
def o6(spark: SparkSession, folder: str) -> DataFrame:
    """A drawn sample with the nominal probability of each draw."""
    return order.hash_sample(table(spark, folder, "documents", "doc_id"), "doc_id", 50, 20250101)


@query("o08_first_of_year", f"WITH {LOG} SELECT substr(observed_at, 1, 4) AS year, first(observation_id ORDER BY observed_at, observation_id) AS observation_id FROM log WHERE observed_at IS NOT NULL GROUP BY 1")
def o8(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).where("observed_at is not null").groupBy(F.substring("observed_at", 1, 4).alias("year")).agg(F.min_by("observation_id", F.struct("observed_at", "observation_id")).alias("observation_id"))


@query("o09_breadth_first", f"WITH {LOG}, p AS (SELECT DISTINCT source_id, seq // 100 AS page FROM log WHERE source_id IS NOT NULL) SELECT source_id, page, row_number() OVER (ORDER BY page, source_id) - 1 AS place FROM p")
def o9(spark: SparkSession, folder: str) -> DataFrame:
    pages = log(spark, folder).where("source_id is not null").select("source_id", F.floor(F.col("seq") / 100).alias("page")).distinct()
    return order.numbered(pages, ["page", "source_id"], "place")


@query("o10_bounded_output", "SELECT work_key, substr(synopsis, 1, 20) AS head, list_aggregate(list_slice(string_split(synopsis, '，'), -2, -1), 'string_agg', '，') AS tail FROM work_master WHERE synopsis IS NOT NULL")
def o10(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.split("synopsis", "，")
    return table(spark, folder, "work_master", "work_key", "synopsis").where("synopsis is not null").select("work_key", F.substring("synopsis", 1, 20).alias("head"), F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), 2), "，").alias("tail"))


@query("o13_capped_class", "SELECT source, doc_id FROM (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source, lang = 'zh' ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) WHERE k <= 4 OR lang <> 'zh'")
def o13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "source", "doc_id", "lang").dropna()
    return order.top_per_group(rows.where("lang = 'zh'"), ["source"], [F.col("doc_id")], 4).union(rows.where("lang <> 'zh'")).select("source", "doc_id")


@query("u02_union_distinct", "SELECT platform, work_id FROM works UNION SELECT platform, platform_work_id FROM work_master")
def u2(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "works", "platform", "work_id").union(table(spark, folder, "work_master", "platform", "platform_work_id")).distinct()


@query("u05_containment", "SELECT (SELECT count(*) FROM (SELECT work_key FROM work_dates EXCEPT SELECT work_key FROM work_master)) AS unknown, (SELECT count(*) FROM (SELECT work_key FROM work_master EXCEPT SELECT work_key FROM work_dates)) AS undated")
def u5(spark: SparkSession, folder: str) -> DataFrame:
    works, days = table(spark, folder, "work_master", "work_key"), table(spark, folder, "work_dates", "work_key")
    both = audit.lost_rows(days, works).select(F.lit(1).alias("u"), F.lit(0).alias("d")).unionByName(audit.lost_rows(works, days).select(F.lit(0).alias("u"), F.lit(1).alias("d")))
    return both.agg(F.coalesce(F.sum("u"), F.lit(0)).alias("unknown"), F.coalesce(F.sum("d"), F.lit(0)).alias("undated"))


@query("q09_page_validity", f"WITH {LOG}, p AS (SELECT source_id, seq // 50 AS page, count(*) AS n, count(DISTINCT observation_id) AS ids, count(*) FILTER (WHERE trim(title) <> '') AS titled FROM log GROUP BY 1, 2) SELECT source_id, page, n = ids AND titled = n AS valid FROM p")
def q9(spark: SparkSession, folder: str) -> DataFrame:
    per = log(spark, folder).groupBy("source_id", F.floor(F.col("seq") / 50).alias("page")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("observation_id").alias("ids"), F.count_if(merge.filled(F.col("title"))).alias("titled"))
    return per.select("source_id", "page", ((F.col("n") == F.col("ids")) & (F.col("titled") == F.col("n"))).alias("valid"))


@query("q12_health", f"""WITH {LOG}, j AS (SELECT work_key, count(*) AS tries, count(*) FILTER (WHERE trim(status_raw) <> '') AS good, max(observed_at) AS latest FROM log GROUP BY 1)
SELECT count(*) FILTER (WHERE good = 0) AS never_good, count(*) FILTER (WHERE tries >= 5) AS slow, count(*) FILTER (WHERE latest < '2024-06-01') AS overdue FROM j""")  # fmt: skip
def q12(spark: SparkSession, folder: str) -> DataFrame:
    jobs = log(spark, folder).groupBy("work_key").agg(F.count(F.lit(1)).alias("tries"), F.count_if(merge.filled(F.col("status_raw"))).alias("good"), F.max("observed_at").alias("latest"))
    return events.progress(jobs, [], {"never_good": F.col("good") == 0, "slow": F.col("tries") >= 5, "overdue": F.col("latest") < "2024-06-01"})


@query("q14_quality_note", "SELECT work_key, CASE WHEN catalog_pub_date IS NULL THEN 'no_date' WHEN regexp_matches(catalog_pub_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'iso' ELSE 'other' END AS note FROM work_dates")
def q14(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("catalog_pub_date")
    return table(spark, folder, "work_dates", "work_key", "catalog_pub_date").select("work_key", F.when(c.isNull(), "no_date").when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "iso").otherwise("other").alias("note"))


@query("t07_cool_down", "SELECT event_type, max(ts) AS blocked_until FROM events WHERE value > 50 GROUP BY 1")
def t7(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_type", "ts", "value").where("value > 50").groupBy("event_type").agg(F.max("ts").alias("blocked_until"))


@query("t11_follow_ups", "SELECT work_key, unnest(range(1, least(5, ceil(n / 2.0)::BIGINT) + 1)) AS page FROM (SELECT work_key, count(*) AS n FROM source_observation WHERE work_key IS NOT NULL GROUP BY 1)")
def t11(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that each list still asks for, from its number of rows."""
    counts = table(spark, folder, "source_observation", "work_key").where("work_key is not null").groupBy("work_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("work_key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(5), F.ceil(F.col("n") / 2)).cast("bigint"))).alias("page"))


@query("t15_requeued", "SELECT event_id FROM events WHERE event_type = 'error' AND props LIKE '%1%'")
def t15(spark: SparkSession, folder: str) -> DataFrame:
    """The failed jobs to be queued again, by kind and message."""
    return table(spark, folder, "events", "event_id", "event_type", "props").where("event_type = 'error' and props like '%1%'").select("event_id")


@query("x02_group_statistics", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd FROM documents GROUP BY 1")
def x2(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "source", "n_chars").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 6).alias("sd"))


@query("j13_two_snapshots", "SELECT platform, count(*) FILTER (WHERE in_master) AS in_master, count(*) FILTER (WHERE in_live) AS in_live FROM (SELECT coalesce(m.platform, w.platform) AS platform, m.platform IS NOT NULL AS in_master, w.platform IS NOT NULL AS in_live FROM work_master m FULL JOIN (SELECT DISTINCT platform, work_id FROM works) w ON m.platform = w.platform AND m.platform_work_id = w.work_id) GROUP BY 1")
def j13(spark: SparkSession, folder: str) -> DataFrame:
    master = table(spark, folder, "work_master", "platform", "platform_work_id").withColumnRenamed("platform_work_id", "work_id").withColumn("m", F.lit(True))
    live = table(spark, folder, "works", "platform", "work_id").distinct().withColumn("w", F.lit(True))
    return master.join(live, ["platform", "work_id"], "full_outer").groupBy("platform").agg(F.count_if("m").alias("in_master"), F.count_if("w").alias("in_live"))


@query("j09_orphans", "SELECT conflict_id FROM metadata_conflict WHERE work_key IS NOT NULL AND work_key NOT IN (SELECT work_key FROM work_dates WHERE work_key IS NOT NULL)")
def j9o(spark: SparkSession, folder: str) -> DataFrame:
    stubs = match.with_stubs(table(spark, folder, "work_dates", "work_key"), table(spark, folder, "metadata_conflict", "work_key"), "work_key").where("is_stub").select("work_key")
    return table(spark, folder, "metadata_conflict", "conflict_id", "work_key").join(stubs, "work_key", "left_semi").select("conflict_id")
