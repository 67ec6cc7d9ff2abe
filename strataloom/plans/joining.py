"""Queries of joins and matching, aggregation, windows, orders, set operations, audits and event accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import dates, scalars
from strataloom.operators import audit, coverage, events, match, order
from strataloom.plans.evidence import LOG, log
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


@query("j01_inner_join", "SELECT l_orderkey, l_linenumber, o_orderpriority, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def j1(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").where("l_returnflag = 'R'")
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("l_orderkey", "l_linenumber", "o_orderpriority", "l_quantity")


@query("j02_chain_join", """SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")  # fmt: skip
def j2(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    per_order = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders, customers = table(spark, folder, "orders", "o_orderkey", "o_custkey"), table(spark, folder, "customer", "c_custkey", "c_nationkey")
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("lines").alias("lines"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("j03_left_join", "SELECT m.work_key, w.last_seen_at FROM work_master m LEFT JOIN (SELECT platform || ':' || work_id AS work_key, max(last_seen_at) AS last_seen_at FROM works GROUP BY 1) w USING (work_key)")
def j3(spark: SparkSession, folder: str) -> DataFrame:
    live = table(spark, folder, "works", "platform", "work_id", "last_seen_at").groupBy(F.concat_ws(":", "platform", "work_id").alias("work_key")).agg(F.max("last_seen_at").alias("last_seen_at"))
    return table(spark, folder, "work_master", "work_key").join(live, "work_key", "left")


@query("j04_semi_anti", """SELECT m.work_key, EXISTS (SELECT 1 FROM source_observation o WHERE o.work_key = m.work_key AND o.source_id IN ('s01', 's02')) AS official,
NOT EXISTS (SELECT 1 FROM work_dates d WHERE d.work_key = m.work_key) AS undated FROM work_master m""")  # fmt: skip
def j4(spark: SparkSession, folder: str) -> DataFrame:
    works = table(spark, folder, "work_master", "work_key")
    seen = table(spark, folder, "source_observation", "work_key", "source_id").where("source_id in ('s01', 's02')").select("work_key").distinct()
    dated = table(spark, folder, "work_dates", "work_key").distinct()
    return works.join(seen.withColumn("official", F.lit(True)), "work_key", "left").join(dated.withColumn("dated", F.lit(True)), "work_key", "left").select("work_key", F.col("official").isNotNull().alias("official"), F.col("dated").isNull().alias("undated"))


@query("j06_unique_match", """WITH l AS (SELECT legacy_id, title, author FROM legacy_bibliography), m AS (SELECT title, author, count(DISTINCT work_key) AS n, min(work_key) AS w FROM work_master WHERE trim(title) <> '' AND trim(author) <> '' GROUP BY 1, 2)
SELECT legacy_id, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN w END AS work_key FROM l LEFT JOIN m USING (title, author)""")  # fmt: skip
def j6(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "legacy_bibliography", "legacy_id", "title", "author")
    return match.unique_match(records, table(spark, folder, "work_master", "work_key", "title", "author"), ["title", "author"], "work_key").select("legacy_id", "matches", "work_key")


#: Names are compared in lower case without anything but letters and figures, which both engines do alike.
_PLAIN = "lower(regexp_replace(coalesce({}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def _plain_name(c: str) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\p{L}\p{N}]+", ""))


@query("j07_title_links", f"""WITH r AS (SELECT external_key AS record, source_platform AS platform, start_year_reported AS alias, list_transform(string_split(coalesce(title, '') || ';' || coalesce(associated_names, ''), ';'), lambda x: {_PLAIN.format("x")}) AS names, list_transform(string_split(coalesce(authors, ''), ';'), lambda x: {_PLAIN.format("x")}) AS authors FROM external_bibliography),
w AS (SELECT work_key AS work, {_PLAIN.format("title")} AS title, {_PLAIN.format("author")} AS author, platform, platform_declared_pub_year AS year FROM work_master),
n AS (SELECT DISTINCT record, platform, title FROM (SELECT record, platform, unnest(names) AS title FROM r) WHERE title <> ''),
h AS (SELECT n.record, w.work FROM n JOIN w ON n.title = w.title AND (n.platform IS NULL OR n.platform = w.platform)),
e AS (SELECT record, count(DISTINCT work) AS n, min(work) AS work FROM h GROUP BY 1)
SELECT r.record, CASE WHEN e.n IS NULL THEN 'not_matched' WHEN e.n > 1 THEN 'ambiguous_title' WHEN w.author <> '' AND list_contains(authors, w.author) THEN 'exact_title_author' WHEN alias = w.year THEN 'dual_title_crosswalk' ELSE 'unique_title_only_candidate' END AS how, CASE WHEN e.n = 1 THEN e.work END AS work FROM r LEFT JOIN e USING (record) LEFT JOIN w ON e.work = w.work""")  # fmt: skip
def j7(spark: SparkSession, folder: str) -> DataFrame:
    """External records linked by any of their names, then confirmed by an author or by a crosswalk of years."""
    records = table(spark, folder, "external_bibliography", "external_key", "title", "associated_names", "authors", "source_platform", "start_year_reported")
    parts = lambda *columns: F.transform(F.split(F.concat_ws(";", *[F.coalesce(F.col(c), F.lit("")) for c in columns]), ";"), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")))
    shaped = records.select(F.col("external_key").alias("record"), parts("title", "associated_names").alias("names"), parts("authors").alias("authors"), F.col("source_platform").alias("platform"), F.col("start_year_reported").cast("string").alias("alias"))
    works = table(spark, folder, "work_master", "work_key", "title", "author", "platform", "platform_declared_pub_year")
    named = works.select(F.col("work_key").alias("work"), _plain_name("title").alias("title"), _plain_name("author").alias("author"), "platform")
    return match.title_links(shaped, named, works.select(F.col("platform_declared_pub_year").cast("string").alias("alias"), F.col("work_key").alias("work")))


@query("j08_crosswalk", """WITH c AS (SELECT author, author_id, count(*) OVER (PARTITION BY author) AS n FROM (SELECT DISTINCT author, author_id FROM work_master))
SELECT author, author_id, CASE WHEN author IS NULL OR author_id IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM c""")  # fmt: skip
def j8(spark: SparkSession, folder: str) -> DataFrame:
    return match.crosswalk(table(spark, folder, "work_master", "author", "author_id").distinct(), "author", "author_id")


@query("j09_stubs", """WITH p AS (SELECT work_key, catalog_pub_year FROM work_dates), c AS (SELECT DISTINCT work_key FROM source_observation WHERE work_key IS NOT NULL)
SELECT work_key, catalog_pub_year, false AS is_stub FROM p UNION ALL SELECT work_key, NULL, true FROM c WHERE work_key NOT IN (SELECT work_key FROM p WHERE work_key IS NOT NULL)""")  # fmt: skip
def j9(spark: SparkSession, folder: str) -> DataFrame:
    return match.with_stubs(table(spark, folder, "work_dates", "work_key", "catalog_pub_year"), table(spark, folder, "source_observation", "work_key"), "work_key")


@query("j10_latest_of_each", f"WITH {LOG} SELECT work_key, first(status_raw ORDER BY observed_at DESC, seq DESC) AS status_raw, max(observed_at) AS observed_at FROM log WHERE observed_at IS NOT NULL GROUP BY 1")
def j10(spark: SparkSession, folder: str) -> DataFrame:
    seen = log(spark, folder).where("observed_at is not null")
    return seen.groupBy("work_key").agg(F.max_by("status_raw", F.struct("observed_at", "seq")).alias("status_raw"), F.max("observed_at").alias("observed_at"))


@query("j12_sources_of_union", """SELECT work_key, count(DISTINCT s) AS sources FROM (SELECT work_key, source_id AS s FROM source_observation UNION SELECT work_key, 'master' FROM work_master UNION SELECT work_key, 'dates' FROM work_dates) WHERE work_key IS NOT NULL GROUP BY 1""")
def j12(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, "source_observation", "work_key", "source_id"), table(spark, folder, "work_master", "work_key").withColumn("source_id", F.lit("master")), table(spark, folder, "work_dates", "work_key").withColumn("source_id", F.lit("dates"))]
    every = parts[0].union(parts[1]).union(parts[2]).where("work_key is not null and source_id is not null").distinct()
    return every.groupBy("work_key").agg(F.count(F.lit(1)).alias("sources"))


@query("j14_zip_by_position", """WITH a AS (SELECT work_key, row_number() OVER (PARTITION BY work_key ORDER BY value_retained, field) AS place, field AS l_field FROM (SELECT DISTINCT work_key, field, value_retained FROM metadata_conflict)),
b AS (SELECT work_key, row_number() OVER (PARTITION BY work_key ORDER BY value_alternative, field) AS place, field AS r_field FROM (SELECT DISTINCT work_key, field, value_alternative FROM metadata_conflict))
SELECT coalesce(a.work_key, b.work_key) AS work_key, coalesce(a.place, b.place) AS place, l_field, r_field FROM (SELECT * FROM a WHERE work_key IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE work_key IS NOT NULL) b ON a.work_key = b.work_key AND a.place = b.place""")  # fmt: skip
def j14(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "metadata_conflict", "work_key", "field", "value_retained", "value_alternative").where("work_key is not null")
    left, right = rows.select("work_key", "field", "value_retained").distinct(), rows.select("work_key", "field", "value_alternative").distinct()
    return match.zip_by_position(left.withColumnRenamed("value_retained", "o"), right.withColumnRenamed("value_alternative", "o"), "work_key", "o", ["field"])


@query("j16_year_spine", """WITH g AS (SELECT DISTINCT platform FROM work_master), y AS (SELECT unnest(range(2005, 2026))::INTEGER AS year), f AS (SELECT platform, platform_declared_pub_year AS year, count(*) AS works FROM work_master GROUP BY 1, 2)
SELECT platform, year, coalesce(works, 0) AS works FROM g CROSS JOIN y LEFT JOIN f USING (platform, year)""")  # fmt: skip
def j16(spark: SparkSession, folder: str) -> DataFrame:
    works = table(spark, folder, "work_master", "platform", "platform_declared_pub_year").withColumnRenamed("platform_declared_pub_year", "year")
    return match.spine(2005, 2025, works, works.groupBy("platform", "year").agg(F.count(F.lit(1)).alias("works")), "year", "platform", "works")


_RATED = ("title", "author_id", "date_raw", "genre_raw", "status_raw")


@query("a06_coverage_matrix", """WITH o AS (SELECT o.*, r.platform, TRY_CAST(nullif(regexp_extract(date_raw, '((?:19|20)[0-9]{2})', 1), '') AS INTEGER) AS year, nullif(trim(coalesce(work_key, '')), '') AS id FROM source_observation o LEFT JOIN source_registry r ON o.source_id = r.source_id),
c AS (SELECT *, count(*) OVER (PARTITION BY platform, year, id) AS n FROM o) SELECT platform, year, count(*) AS raw_records, count(DISTINCT id) AS unique_ids, count(*) FILTER (WHERE id IS NOT NULL AND n > 1) AS duplicate_id_records, """ + ", ".join(f"avg((trim(coalesce({c}, '')) <> '')::INTEGER) AS {c}_rate" for c in _RATED) + " FROM c GROUP BY 1, 2")  # fmt: skip
def a6(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "source_registry", "source_id", "platform")
    rows = coverage.require(table(spark, folder, "source_observation"), ["work_key", *_RATED]).select("source_id", "work_key", *_RATED)
    return coverage.matrix(rows.withColumn("year", dates.year_of(F.col("date_raw"))).join(sources, "source_id", "left"), ["platform", "year"], "work_key", _RATED)


@query("q06_duplicate_rows", "SELECT observation_id, work_key, source_id FROM source_observation WHERE observation_id IN (SELECT observation_id FROM source_observation GROUP BY 1 HAVING count(*) > 1)")
def q6(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.duplicates(table(spark, folder, "source_observation", "observation_id", "work_key", "source_id"), ["observation_id"])


@query("a01_group_count", "SELECT source_id, date_type, count(*) AS n FROM source_observation GROUP BY 1, 2")
def a1(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_observation", "source_id", "date_type").groupBy("source_id", "date_type").agg(F.count(F.lit(1)).alias("n"))


@query("a02_collapsed", "SELECT work_key, field, value_alternative, count(*) AS multiplicity FROM metadata_conflict GROUP BY 1, 2, 3")
def a2(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.collapsed(table(spark, folder, "metadata_conflict"), ["work_key", "field", "value_alternative"])


@query("a03_conditional_sums", "SELECT platform, source_reported_year AS year, count(*) AS n, count(*) FILTER (WHERE trim(title) <> '') AS titles, count(*) FILTER (WHERE trim(author) <> '') AS authors FROM legacy_bibliography GROUP BY 1, 2")
def a3(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "legacy_bibliography", "platform", "source_reported_year", "title", "author")
    return rows.groupBy("platform", F.col("source_reported_year").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("title") != "").alias("titles"), F.count_if(F.trim("author") != "").alias("authors"))


@query("a04_mixed_distinct", "SELECT source_id, count(*) AS n, count(DISTINCT work_key) AS works, count(DISTINCT author_id) AS authors, max(observed_at) AS latest FROM source_observation GROUP BY 1")
def a4(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_observation", "source_id", "work_key", "author_id", "observed_at").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("work_key").alias("works"), F.countDistinct("author_id").alias("authors"), F.max("observed_at").alias("latest"))


@query("a05_wide_counts", "SELECT count(*) AS n, count(catalog_pub_date) AS catalog, count(first_chapter_publication_date) AS first_chapter, count(*) FILTER (WHERE catalog_pub_date IS NOT NULL OR first_chapter_publication_date IS NOT NULL) AS any_date, sum(chapter_time_conflict)::BIGINT AS conflicts FROM work_dates")
def a5(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("catalog_pub_date"), F.col("first_chapter_publication_date")
    return table(spark, folder, "work_dates").agg(F.count(F.lit(1)).alias("n"), F.count(a).alias("catalog"), F.count(b).alias("first_chapter"), F.count_if(a.isNotNull() | b.isNotNull()).alias("any_date"), F.sum("chapter_time_conflict").alias("conflicts"))


@query("a07_progress_matrix", f"""WITH {LOG}, j AS (SELECT work_key, source_id, count(*) AS tries, count(*) FILTER (WHERE trim(coalesce(status_raw, '')) <> '') AS good, max(observed_at) AS latest FROM log GROUP BY 1, 2)
SELECT source_id, count(*) AS jobs, count(*) FILTER (WHERE good > 0) AS succeeded, count(*) FILTER (WHERE good = 0) AS waiting, count(*) FILTER (WHERE good = 0 AND tries > 1) AS retried, count(*) FILTER (WHERE latest IS NULL) AS undated, min(latest) FILTER (WHERE good > 0) AS oldest FROM j GROUP BY 1""")  # fmt: skip
def a7(spark: SparkSession, folder: str) -> DataFrame:
    jobs = log(spark, folder).groupBy("work_key", "source_id").agg(F.count(F.lit(1)).alias("tries"), F.count_if(F.trim("status_raw") != "").alias("good"), F.max("observed_at").alias("latest"))
    good = F.col("good") > 0
    counts = events.progress(jobs, ["source_id"], {"jobs": F.lit(True), "succeeded": good, "waiting": ~good, "retried": ~good & (F.col("tries") > 1), "undated": F.col("latest").isNull()})
    return counts.join(jobs.groupBy("source_id").agg(F.min(F.when(good, F.col("latest"))).alias("oldest")), "source_id")


@query("a08_cardinalities", "SELECT 'chapters' AS name, count(*) AS rows FROM chapters UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'work_master', count(*) FROM work_master UNION ALL SELECT 'works', count(*) FROM works")
def a8(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.cardinalities({n: table(spark, folder, n) for n in ("chapters", "documents", "work_master", "works")})


@query("a10_best_candidate", f"""WITH {LOG} SELECT work_key, first(title ORDER BY rank DESC, length(title) DESC, seq) AS title FROM log WHERE trim(title) <> '' GROUP BY 1""")
def a10(spark: SparkSession, folder: str) -> DataFrame:
    rows = log(spark, folder).where("trim(title) <> ''")
    return rows.groupBy("work_key").agg(F.max_by("title", F.struct("rank", F.length("title"), -F.col("seq"))).alias("title"))


@query("a11_longest_variant", "WITH v AS (SELECT work_key, source_id, array_agg(DISTINCT title ORDER BY title) AS t FROM source_observation WHERE title IS NOT NULL AND work_key IS NOT NULL GROUP BY 1, 2), m AS (SELECT work_key, arg_max(t, struct_pack(n := len(t), s := source_id)) AS t FROM v GROUP BY 1) SELECT work_key, len(t)::INTEGER AS n, t[1] AS first, t[-1] AS last FROM m")
def a11(spark: SparkSession, folder: str) -> DataFrame:
    lists = table(spark, folder, "source_observation", "work_key", "source_id", "title").dropna().groupBy("work_key", "source_id").agg(F.sort_array(F.collect_set("title")).alias("t"))
    best = lists.groupBy("work_key").agg(F.max_by("t", F.struct(F.size("t"), "source_id")).alias("t"))
    return best.select("work_key", F.size("t").alias("n"), F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))


@query("a12_outcome_pivot", "SELECT source_id, count(*) FILTER (WHERE date_type = 'catalog_publication') AS catalog_publication, count(*) FILTER (WHERE date_type = 'last_update') AS last_update FROM source_observation GROUP BY 1")
def a12(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_observation", "source_id", "date_type").groupBy("source_id").pivot("date_type", ["catalog_publication", "last_update"]).count().fillna(0)


@query("a14_ordered_distinct", f"WITH {LOG}, f AS (SELECT work_key, source_id, min(seq) AS s FROM log WHERE source_id IS NOT NULL GROUP BY 1, 2) SELECT work_key, string_agg(source_id, '>' ORDER BY s) AS sources FROM f GROUP BY 1")
def a14(spark: SparkSession, folder: str) -> DataFrame:
    first = log(spark, folder).where("source_id is not null").groupBy("work_key", "source_id").agg(F.min("seq").alias("s"))
    return first.groupBy("work_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "source_id"))), lambda x: x["source_id"]), ">").alias("sources"))


@query("a16_gained", """WITH b AS (SELECT platform AS p, count(*) AS n FROM work_master GROUP BY 1), a AS (SELECT platform AS p, count(*) AS n FROM works GROUP BY 1)
SELECT coalesce(b.p, a.p) AS platform, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS gained FROM b FULL JOIN a ON b.p = a.p""")  # fmt: skip
def a16(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.difference_of_counts(table(spark, folder, "work_master", "platform"), table(spark, folder, "works", "platform"), "platform")


@query("a17_latest_unresolved", f"WITH {LOG}, l AS (SELECT work_key, first(status_raw ORDER BY observed_at DESC, seq DESC) AS s FROM log WHERE observed_at IS NOT NULL GROUP BY 1) SELECT count(*) AS works, count(*) FILTER (WHERE s IS NULL OR trim(s) IN ('', '未知', '--')) AS unresolved FROM l")
def a17(spark: SparkSession, folder: str) -> DataFrame:
    last = events.latest_state(log(spark, folder).where("observed_at is not null").withColumn("o", F.struct("observed_at", "seq")), "work_key", "o", ["status_raw"])
    return last.agg(F.count(F.lit(1)).alias("works"), F.count_if(F.col("status_raw").isNull() | F.trim("status_raw").isin("", "未知", "--")).alias("unresolved"))


@query("w01_latest_row", f"WITH {LOG} SELECT work_key, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY work_key ORDER BY observed_at DESC NULLS LAST, source_id, observation_id) AS n FROM log) WHERE n = 1")
def w1(spark: SparkSession, folder: str) -> DataFrame:
    rows = log(spark, folder)
    return order.top_per_group(rows, ["work_key"], [F.desc_nulls_last("observed_at"), F.col("source_id"), F.col("observation_id")], 1).select("work_key", "observation_id")


@query("w08_streaks", """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS b FROM events), g AS (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e),
r AS (SELECT user_id, g, count(*) FILTER (WHERE b) AS n FROM g GROUP BY 1, 2) SELECT user_id, max(n)::BIGINT AS longest, arg_max(n, g)::BIGINT AS current FROM r GROUP BY 1""")  # fmt: skip
def w8(spark: SparkSession, folder: str) -> DataFrame:
    return events.streaks(table(spark, folder, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error")


@query("w09_median_row", """WITH r AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS n, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem)
SELECT l_returnflag, l_extendedprice FROM r WHERE n = c // 2 + 1""")  # fmt: skip
def w9(spark: SparkSession, folder: str) -> DataFrame:
    """The middle row of each group: rows are placed by a range sort, since a group may be a large part of the table."""
    rows = table(spark, folder, "lineitem", "l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    placed = order.numbered(rows, ["l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], "i")
    span = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("c"))
    before = span.withColumn("start", F.coalesce(F.sum("c").over(Window.orderBy("l_returnflag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(before, "l_returnflag").where("i - start = floor(c / 2)").select("l_returnflag", "l_extendedprice")


@query("o03_circular_slice", "WITH n AS (SELECT work_key, row_number() OVER (ORDER BY platform, CAST(platform_work_id AS BIGINT)) - 1 AS i, count(*) OVER () AS c FROM work_master) SELECT work_key FROM n WHERE ((i - 590) % c + c) % c < 25")
def o3(spark: SparkSession, folder: str) -> DataFrame:
    works = table(spark, folder, "work_master", "work_key", "platform", "platform_work_id").withColumn("id", F.col("platform_work_id").cast("bigint"))
    return order.circular(works, ["platform", "id"], 590, 25).select("work_key")


@query("o05_two_tiers", """SELECT conflict_id FROM metadata_conflict WHERE conflict_id IS NOT NULL ORDER BY CASE WHEN field = 'title' THEN 0 ELSE 1 END, CASE WHEN field = 'title' THEN value_retained END NULLS FIRST, CASE WHEN field = 'title' THEN conflict_id END NULLS FIRST, CASE WHEN field <> 'title' THEN conflict_id END NULLS FIRST LIMIT 200""")
def o5(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "metadata_conflict", "conflict_id", "field", "value_retained").where("conflict_id is not null")
    return order.two_tiers(rows, F.col("field") == "title", [F.col("value_retained"), F.col("conflict_id")], [F.col("conflict_id")], 200).select("conflict_id")


@query("o07_evenly_spaced", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS c FROM documents) SELECT doc_id FROM n WHERE i IN (SELECT round_even(k * (c - 1) / 119.0, 0)::BIGINT FROM (SELECT unnest(range(120)) AS k), (SELECT count(*) AS c FROM documents))")
def o7(spark: SparkSession, folder: str) -> DataFrame:
    return order.evenly(table(spark, folder, "documents", "doc_id"), ["doc_id"], 120)


@query("o12_top_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang <> 'zh' NULLS LAST, n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 15")
def o12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "source", "doc_id", "lang", "n_chars")
    return order.top_per_group(rows, ["source"], [(F.col("lang") != "zh").asc_nulls_last(), F.desc("n_chars"), F.col("doc_id")], 15).select("source", "doc_id")


@query("o14_first_distinct", "SELECT status_raw, min(CAST(regexp_extract(row_locator, '([0-9]+)$', 1) AS BIGINT)) AS first_at FROM source_observation GROUP BY 1 ORDER BY 2, 1 LIMIT 22")
def o14(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_observation", "status_raw", "row_locator").withColumn("n", F.regexp_extract("row_locator", "([0-9]+)$", 1).cast("bigint"))
    return order.first_distinct(rows, "status_raw", "n", 22)


@query("o11_slots", "SELECT platform, least(20, greatest(1, ceil(count(*) FILTER (WHERE first_chapter_publication_date IS NULL) / greatest(1, count(*) FILTER (WHERE catalog_pub_date IS NULL))::DOUBLE)))::INTEGER AS slots FROM (SELECT split_part(work_key, ':', 1) AS platform, * FROM work_dates) GROUP BY 1")
def o11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "work_dates", "work_key", "catalog_pub_date", "first_chapter_publication_date").withColumn("platform", F.split_part("work_key", F.lit(":"), F.lit(1)))
    return rows.groupBy("platform").agg(F.count_if(F.col("first_chapter_publication_date").isNull()).alias("a"), F.count_if(F.col("catalog_pub_date").isNull()).alias("b")).select("platform", order.slots(F.col("a"), F.col("b")).alias("slots"))


@query("u01_union_padded", "SELECT work_key, title, catalog_pub_date FROM (SELECT work_key, title, NULL AS catalog_pub_date FROM work_master UNION ALL SELECT work_key, NULL, catalog_pub_date FROM work_dates)")
def u1(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "work_master", "work_key", "title").unionByName(table(spark, folder, "work_dates", "work_key", "catalog_pub_date"), allowMissingColumns=True)


@query("u03_lost_rows", "SELECT title, author FROM work_master EXCEPT SELECT title, author FROM works")
def u3(spark: SparkSession, folder: str) -> DataFrame:
    return audit.lost_rows(table(spark, folder, "work_master"), table(spark, folder, "works"), ["title", "author"])


@query("u04_bag_equality", "SELECT 'left' AS side, (SELECT count(*) FROM (SELECT platform, work_id, status FROM works EXCEPT ALL SELECT DISTINCT platform, work_id, status FROM works)) AS rows UNION ALL SELECT 'right', 0")
def u4(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "works", "platform", "work_id", "status")
    return audit.same_bag(rows, rows.distinct())


@query("q01_preservation", """SELECT 'rows:dates' AS "check", count(*) = 0 AS passed, count(*) AS n FROM (SELECT work_key FROM work_master EXCEPT SELECT work_key FROM work_dates)
UNION ALL SELECT 'rows:live', count(*) = 0, count(*) FROM (SELECT DISTINCT platform, work_id, title FROM works EXCEPT SELECT platform, platform_work_id, title FROM work_master) UNION ALL SELECT 'table:extra', false, 1""")  # fmt: skip
def q1(spark: SparkSession, folder: str) -> DataFrame:
    before = {"dates": table(spark, folder, "work_master", "work_key"), "live": table(spark, folder, "works", "platform", "work_id", "title"), "extra": table(spark, folder, "region")}
    after = {"dates": table(spark, folder, "work_dates", "work_key"), "live": table(spark, folder, "work_master").select("platform", F.col("platform_work_id").alias("work_id"), "title")}
    return audit.preservation(before, after, {"dates": ["work_key"]})


@query("q02_keys_and_references", """SELECT 'unique:work_master' AS "check", count(*) = 0 AS passed, count(*) AS n FROM (SELECT work_key FROM work_master GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unique:source_observation', count(*) = 0, count(*) FROM (SELECT observation_id FROM source_observation GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'reference:preferred', count(*) = 0, count(*) FROM work_master WHERE preferred_observation_id IS NOT NULL AND preferred_observation_id NOT IN (SELECT observation_id FROM source_observation)
UNION ALL SELECT 'rule:year', count(*) = 0, count(*) FROM legacy_bibliography WHERE NOT coalesce(source_reported_year BETWEEN 1990 AND 2026, false)""")  # fmt: skip
def q2(spark: SparkSession, folder: str) -> DataFrame:
    works, seen, legacy = table(spark, folder, "work_master", "work_key", "preferred_observation_id"), table(spark, folder, "source_observation", "observation_id"), table(spark, folder, "legacy_bibliography", "source_reported_year")
    return audit.union(
        [audit.unique(works, "work_master", ["work_key"]), audit.unique(seen, "source_observation", ["observation_id"]), audit.refers(works, seen, "preferred", "preferred_observation_id", "observation_id"), audit.holds(legacy, "year", F.col("source_reported_year").between(1990, 2026))]
    )


@query("q03_rule_gate", """WITH c AS (SELECT count(*) FILTER (WHERE first_pub_year_verified IS NOT NULL) = 0 AS passed FROM work_master UNION ALL SELECT count(*) = count(DISTINCT work_key) FROM work_dates UNION ALL SELECT count(*) FILTER (WHERE source_reported_year NOT BETWEEN 1990 AND 2026) = 0 FROM legacy_bibliography)
SELECT bool_and(passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM c""")  # fmt: skip
def q3(spark: SparkSession, folder: str) -> DataFrame:
    works, days, legacy = table(spark, folder, "work_master", "first_pub_year_verified"), table(spark, folder, "work_dates", "work_key"), table(spark, folder, "legacy_bibliography", "source_reported_year")
    year = F.col("source_reported_year")
    return coverage.gate(audit.union([audit.holds(works, "unverified", F.col("first_pub_year_verified").isNull()), audit.unique(days, "dates", ["work_key"]), audit.holds(legacy, "years", year.isNull() | year.between(1990, 2026))]))


@query("q08_repeated_pages", """WITH p AS (SELECT source_id AS part, CAST(regexp_extract(row_locator, '([0-9]+)$', 1) AS BIGINT) // 3 AS page, string_agg(DISTINCT coalesce(status_raw, ''), ',' ORDER BY coalesce(status_raw, '')) AS ids FROM source_observation GROUP BY 1, 2),
f AS (SELECT part, ids, min(page) AS first_page FROM p GROUP BY 1, 2) SELECT p.part, page, first_page FROM p JOIN f ON p.part IS NOT DISTINCT FROM f.part AND p.ids = f.ids WHERE page <> first_page AND p.part IS NOT NULL""")  # fmt: skip
def q8(spark: SparkSession, folder: str) -> DataFrame:
    page = F.floor(F.regexp_extract("row_locator", "([0-9]+)$", 1).cast("bigint") / 3).alias("page")
    pages = table(spark, folder, "source_observation", "source_id", "row_locator", "status_raw").where("source_id is not null").groupBy(F.col("source_id").alias("part"), page).agg(F.sort_array(F.collect_set(F.coalesce("status_raw", F.lit("")))).alias("ids"))
    return audit.repeated_pages(pages, "part", "page", "ids")


@query("q10_envelope", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN work_key IS NULL THEN 'no_work' WHEN observed_at IS NULL THEN 'no_time' WHEN NOT coalesce(regexp_matches(observed_at, '^[0-9]{4}-'), false) THEN 'bad_time' WHEN raw_record_json IS NULL THEN 'no_payload' END AS reason FROM source_observation) GROUP BY 1""")
def q10(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_observation", "work_key", "observed_at", "raw_record_json")
    rules = {"no_work": F.col("work_key").isNotNull(), "no_time": F.col("observed_at").isNotNull(), "bad_time": F.col("observed_at").rlike("^[0-9]{4}-"), "no_payload": F.col("raw_record_json").isNotNull()}
    return audit.envelope(rows, rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_PROFILED = ("platform", "status", "genre", "last_seen_at")


@query("q13_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE trim({c}) <> '') AS filled, count(DISTINCT {c}) AS \"distinct\", min({c}) AS least, max({c}) AS greatest FROM works" for c in _PROFILED))
def q13(spark: SparkSession, folder: str) -> DataFrame:
    return audit.profile(table(spark, folder, "works"), _PROFILED)


@query("t09_episodes", """WITH r AS (SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), 0) AS b FROM events GROUP BY 1) SELECT e.user_id, count(*) FILTER (WHERE e.event_type = 'error' AND e.event_id > r.b) AS failures FROM events e JOIN r USING (user_id) GROUP BY 1""")
def t9(spark: SparkSession, folder: str) -> DataFrame:
    return events.episode(table(spark, folder, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("w07_circuits", """WITH e AS (SELECT *, user_id % 7 AS kind FROM events), r AS (SELECT kind, coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), 0) AS b FROM e GROUP BY 1),
c AS (SELECT e.kind, count(DISTINCT user_id) FILTER (WHERE event_type = 'error' AND event_id > b) AS jobs FROM e JOIN r USING (kind) GROUP BY 1) SELECT kind, jobs, jobs >= 3 AS is_open FROM c""")  # fmt: skip
def w7(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", "user_id", "event_id", "event_type").withColumn("kind", F.col("user_id") % 7)
    return events.circuits(rows, ["kind"], "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("t08_reservations", """WITH q AS (SELECT event_type, event_id, floor(epoch(ts)) AS now, (20 + user_id % 60)::DOUBLE AS delay FROM events), p AS (SELECT *, coalesce(sum(delay) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM q)
SELECT event_type, event_id, max(now - p) OVER (PARTITION BY event_type ORDER BY event_id) + p AS slot FROM p""")  # fmt: skip
def t8(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", "event_type", "event_id", "ts", "user_id")
    shaped = rows.select("event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("now"), (20 + F.col("user_id") % 60).cast("double").alias("delay"), F.lit(None).cast("double").alias("blocked"))
    return events.reservations(shaped, "event_type", "event_id", "now", "delay", "blocked").select("event_type", "event_id", "slot")


@query("t03_latest_state", "SELECT user_id, first(event_type ORDER BY event_id DESC) AS event_type, first(value ORDER BY event_id DESC) AS value FROM events GROUP BY 1")
def t3(spark: SparkSession, folder: str) -> DataFrame:
    return events.latest_state(table(spark, folder, "events", "user_id", "event_id", "event_type", "value"), "user_id", "event_id", ["event_type", "value"])


@query("t01_enqueue", "SELECT DISTINCT work_key FROM source_observation WHERE work_key IS NOT NULL AND work_key NOT IN (SELECT work_key FROM work_dates WHERE work_key IS NOT NULL)")
def t1(spark: SparkSession, folder: str) -> DataFrame:
    return events.enqueue(table(spark, folder, "work_dates", "work_key"), table(spark, folder, "source_observation", "work_key").where("work_key is not null"), "work_key")
