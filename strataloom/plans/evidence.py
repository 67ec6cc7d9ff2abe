"""Queries of the merge policies, date evidence and chapter operators, over the catalogue's observation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import dates, scalars
from strataloom.operators import chapters as C
from strataloom.operators import merge as M
from strataloom.sources.tables import table

FIELDS = ("title", "author", "genre_raw", "status_raw", "word_count")

#: The observation log in SQL: different rows, arrival number, time, priority.
LOG = """log AS (SELECT DISTINCT o.observation_id, o.work_key, o.title, o.author, o.author_id, o.genre_raw, o.status_raw, o.word_count, o.declared_pub_year,
 o.source_id, o.observed_at, o.date_raw, o.date_type, CAST(regexp_extract(o.row_locator, '([0-9]+)$', 1) AS BIGINT) AS seq, r.priority AS pr, 10 - r.priority AS rank
 FROM source_observation o LEFT JOIN source_registry r ON o.source_id = r.source_id WHERE o.work_key IS NOT NULL)"""


def log(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "source_registry", "source_id", "priority")
    rows = table(spark, folder, "source_observation").drop("raw_record_json").where("work_key is not null")
    seq = F.regexp_extract("row_locator", "([0-9]+)$", 1).cast("bigint")
    return rows.withColumn("seq", seq).drop("row_locator").distinct().join(sources, "source_id", "left").withColumn("rank", 10 - F.col("priority"))


def m1_priority_row(spark: SparkSession, folder: str) -> DataFrame:
    return M.priority_row(log(spark, folder), ["work_key"], "seq", "rank", FIELDS, ("title", "author"))


M1 = f"""WITH {LOG}, w AS (SELECT *, row_number() OVER (PARTITION BY work_key ORDER BY rank DESC, seq DESC) AS n FROM log),
win AS (SELECT * FROM w WHERE n = 1),
fill AS (SELECT l.work_key, arg_min(l.title, l.seq) FILTER (WHERE trim(l.title) <> '') AS t, arg_min(l.author, l.seq) FILTER (WHERE trim(l.author) <> '') AS a
 FROM log l JOIN win USING (work_key) WHERE l.seq >= win.seq GROUP BY 1)
SELECT work_key, coalesce(t, title) AS title, coalesce(a, author) AS author, genre_raw, status_raw, word_count FROM win JOIN fill USING (work_key)"""


def m2_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return M.first_wins(log(spark, folder), ["work_key"], "seq", FIELDS)


M2 = f"WITH {LOG} SELECT work_key, " + ", ".join(f"arg_min({f}, seq) FILTER (WHERE trim({f}) <> '') AS {f}" for f in FIELDS) + " FROM log GROUP BY 1"


def m2_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return M.first_wins_conflicts(log(spark, folder), ["work_key"], "seq", ("title", "author"))


M2C = f"""WITH {LOG}, kept AS (SELECT work_key, arg_min(title, seq) FILTER (WHERE trim(title) <> '') AS t, arg_min(author, seq) FILTER (WHERE trim(author) <> '') AS a FROM log GROUP BY 1)
SELECT work_key, seq, 'title' AS field, t AS value_retained, title AS value_alternative FROM log JOIN kept USING (work_key) WHERE trim(title) <> '' AND title <> t
UNION ALL SELECT work_key, seq, 'author', a, author FROM log JOIN kept USING (work_key) WHERE trim(author) <> '' AND author <> a"""


def m3_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return M.mixed(log(spark, folder), ["work_key"], "seq", ("title", "author", "genre_raw"), ("status_raw",), ("observed_at",), ("declared_pub_year",))


M3 = f"""WITH {LOG} SELECT work_key, arg_min(title, seq) FILTER (WHERE trim(title) <> '') AS title, arg_min(author, seq) FILTER (WHERE trim(author) <> '') AS author,
arg_min(genre_raw, seq) FILTER (WHERE trim(genre_raw) <> '') AS genre_raw, arg_max(status_raw, seq) FILTER (WHERE trim(status_raw) <> '') AS status_raw,
max(observed_at) AS observed_at, min(declared_pub_year) AS declared_pub_year FROM log GROUP BY 1"""


def _chapters(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chapters").where("chapter_key is not null")
    return rows.distinct().withColumn("seq", F.struct("observed_at", F.xxhash64("chapter_title", "word_count")))


CHAPTER_LOG = "ch AS (SELECT DISTINCT * FROM chapters WHERE chapter_key IS NOT NULL)"


def m4_chapters_newest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chapters").where("chapter_key is not null").distinct()
    latest = M.insert_or_replace(rows.withColumn("seq", F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("observed_at", "chapter_title", "word_count", "publication_date", "update_date", "is_vip", "source_kind")])), ["platform", "work_id", "chapter_key"], "seq")
    return latest.groupBy("platform", "work_id").agg(F.count(F.lit(1)).alias("chapters"), F.max("observed_at").alias("observed_at"), F.count_if(F.col("is_vip") == 1).alias("vip"))


M4 = """WITH k AS (SELECT platform, work_id, chapter_key, max(observed_at) AS o, arg_max(is_vip, concat_ws('|', coalesce(observed_at,''), coalesce(chapter_title,''), coalesce(word_count,''), coalesce(publication_date,''), coalesce(update_date,''), coalesce(is_vip::VARCHAR,''), coalesce(source_kind,''))) AS v
 FROM chapters WHERE chapter_key IS NOT NULL GROUP BY 1, 2, 3) SELECT platform, work_id, count(*) AS chapters, max(o) AS observed_at, coalesce(count(*) FILTER (WHERE v = 1), 0) AS vip FROM k GROUP BY 1, 2"""


def m5_newest_wins(spark: SparkSession, folder: str) -> DataFrame:
    return M.newest_wins(log(spark, folder).where("observed_at is not null"), ["work_key"], "seq", "observed_at", FIELDS)


M5 = f"WITH {LOG} SELECT work_key, " + ", ".join(f"(max(struct_pack(t := observed_at, s := -seq, v := {f})) FILTER (WHERE trim({f}) <> '')).v AS {f}" for f in FIELDS) + " FROM log WHERE observed_at IS NOT NULL GROUP BY 1"


def m5_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    seen = log(spark, folder).where("observed_at is not null").withColumn("month", F.substring("observed_at", 1, 7))
    return M.newest_wins_conflicts(seen, ["work_key"], "seq", "month", "status_raw")


M5C = f"""WITH {LOG}, s AS (SELECT *, substr(observed_at, 1, 7) AS m FROM log WHERE observed_at IS NOT NULL AND trim(status_raw) <> ''),
p AS (SELECT *, max(struct_pack(t := m, s := -seq, v := status_raw)) OVER (PARTITION BY work_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s)
SELECT work_key, seq, prev.v AS value_retained, status_raw AS value_alternative FROM p WHERE prev.t = m AND prev.v <> status_raw"""


def m7_seed_fill(spark: SparkSession, folder: str) -> DataFrame:
    """First filled value over three loads: master, live view, observations."""
    master = table(spark, folder, "work_master", "work_key", "title", "author").withColumn("load", F.lit(0)).withColumn("seq", F.lit(0).cast("bigint"))
    live = table(spark, folder, "works", "platform", "work_id", "title", "author", "last_seen_at").select(F.concat_ws(":", "platform", "work_id").alias("work_key"), "title", "author", F.lit(1).alias("load"), F.lit(0).cast("bigint").alias("seq"))
    seen = log(spark, folder).select("work_key", "title", "author", F.lit(2).alias("load"), "seq")
    every = master.unionByName(live).unionByName(seen)
    return every.groupBy("work_key").agg(M.first_value("title", "load", "seq").alias("title"), M.first_value("author", "load", "seq").alias("author"))


M7 = f"""WITH {LOG}, e AS (SELECT work_key, title, author, 0 AS load, 0 AS seq FROM work_master UNION ALL SELECT platform || ':' || work_id, title, author, 1, 0 FROM works UNION ALL SELECT work_key, title, author, 2, seq FROM log)
SELECT work_key, (min(struct_pack(a := load, b := seq, v := title)) FILTER (WHERE trim(title) <> '')).v AS title, (min(struct_pack(a := load, b := seq, v := author)) FILTER (WHERE trim(author) <> '')).v AS author FROM e GROUP BY 1"""


def m8_ignore_replace(spark: SparkSession, folder: str) -> DataFrame:
    rows = log(spark, folder).select("work_key", "source_id", "seq", "title", "status_raw")
    first, last = (f(rows, ["work_key", "source_id"], "seq") for f in (M.insert_or_ignore, M.insert_or_replace))
    return first.select("work_key", "source_id", F.col("seq").alias("first_seq"), F.col("title").alias("first_title")).join(last.select("work_key", "source_id", F.col("seq").alias("last_seq"), F.col("status_raw").alias("last_status")), ["work_key", "source_id"])


M8 = f"WITH {LOG} SELECT work_key, source_id, min(seq) AS first_seq, first(title ORDER BY seq) AS first_title, max(seq) AS last_seq, first(status_raw ORDER BY seq DESC) AS last_status FROM log WHERE source_id IS NOT NULL GROUP BY 1, 2"


def m9_seen_between(spark: SparkSession, folder: str) -> DataFrame:
    return M.seen_between(log(spark, folder).where("observed_at is not null"), ["work_key"], "observed_at", "source_id", "seq")


M9 = f"WITH {LOG} SELECT work_key, min(observed_at) AS first_observed, max(observed_at) AS last_observed, first(source_id ORDER BY observed_at DESC, seq DESC) AS source_id FROM log WHERE observed_at IS NOT NULL GROUP BY 1"


def m10_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A log merged with itself and with new rows: only the new ones are added, none contradicts."""
    rows = log(spark, folder).select("observation_id", "work_key", "title", "seq")
    known, content = rows.where("seq % 3 <> 0"), ("work_key", "title")
    added, contradicting = M.replay(known, rows, "observation_id", content)
    both = added.select(F.lit(1).alias("a"), F.lit(0).alias("c")).unionByName(contradicting.select(F.lit(0).alias("a"), F.lit(1).alias("c")))
    return both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("added"), F.coalesce(F.sum("c"), F.lit(0)).alias("contradicting"))


M10 = f"WITH {LOG} SELECT count(DISTINCT observation_id) FILTER (WHERE seq % 3 = 0) AS added, 0 AS contradicting FROM log"


def m12_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """Newest value where the master counts as older than the live view, and that as older than any observation."""
    master = table(spark, folder, "work_master", "work_key", "status_raw").withColumn("seq", F.lit(0).cast("bigint"))
    live = table(spark, folder, "works", "platform", "work_id", "status", "last_seen_at").select(F.concat_ws(":", "platform", "work_id").alias("work_key"), F.col("status").alias("status_raw"), F.row_number().over(_by_live()).cast("bigint").alias("seq"))
    seen = log(spark, folder).where("observed_at is not null").select("work_key", "status_raw", "seq", F.unix_seconds(F.to_timestamp("observed_at")).alias("ts"))
    return M.newest_wins(M.with_precedence([master, live, seen], "ts"), ["work_key"], "seq", "ts", ("status_raw",))


def _by_live():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("platform", "work_id").orderBy(F.coalesce("last_seen_at", F.lit("")), F.coalesce("status", F.lit("")))


M12 = f"""WITH {LOG}, e AS (SELECT work_key, status_raw, 0 AS seq, -2 AS ts FROM work_master
UNION ALL SELECT platform || ':' || work_id, status, row_number() OVER (PARTITION BY platform, work_id ORDER BY coalesce(last_seen_at, ''), coalesce(status, '')), -1 FROM works
UNION ALL SELECT work_key, status_raw, seq, epoch(CAST(replace(substr(observed_at, 1, 19), 'T', ' ') AS TIMESTAMP))::BIGINT FROM log WHERE observed_at IS NOT NULL)
SELECT work_key, (max(struct_pack(t := ts, s := -seq, v := status_raw)) FILTER (WHERE trim(status_raw) <> '')).v AS status_raw FROM e GROUP BY 1"""


def d1_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Date columns as evidence rows under canonical roles, evidence-only roles left out."""
    wide = table(spark, folder, "work_dates", "work_key", "catalog_pub_date", "first_chapter_publication_date", "latest_chapter_update_date")
    long = wide.select("work_key", F.explode(dates.stack_roles({c: c for c in ("catalog_pub_date", "first_chapter_publication_date", "latest_chapter_update_date")})).alias("e")).select("work_key", dates.role_of(F.col("e.role")).alias("role"), "e.value")
    return long.where(dates.is_current_role(F.col("role")))


D1 = """SELECT work_key, 'catalog_publication' AS role, catalog_pub_date AS value FROM work_dates WHERE catalog_pub_date IS NOT NULL
UNION ALL SELECT work_key, 'first_chapter_publication', first_chapter_publication_date FROM work_dates WHERE first_chapter_publication_date IS NOT NULL
UNION ALL SELECT work_key, 'last_update', latest_chapter_update_date FROM work_dates WHERE latest_chapter_update_date IS NOT NULL"""


def d4_late_endings(spark: SparkSession, folder: str) -> DataFrame:
    """Ending titles late in a work, by work and role."""
    rows = table(spark, folder, "chapters", "platform", "work_id", "chapter_number", "chapter_title", "publication_date", "update_date").distinct()
    keyed = rows.withColumn("work_key", F.concat_ws(":", "platform", "work_id"))
    return C.late_endings(keyed, "work_key", "chapter_number", "chapter_title", "publication_date", "update_date").groupBy("work_key", "role").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))


def d8_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chapters", "platform", "work_id", "chapter_number", "chapter_title").where("try_cast(chapter_number as bigint) is not null")
    one = rows.select(F.concat_ws(":", "platform", "work_id").alias("work_key"), F.col("chapter_number").cast("bigint").alias("position"), "chapter_title").groupBy("work_key", "position").agg(F.min("chapter_title").alias("chapter_title"))
    status = table(spark, folder, "work_master", "work_key", "status_raw").select("work_key", F.col("status_raw").alias("status"))
    return C.windows(one, "work_key", "position", "chapter_title", F.lit(""), status)


_AUX = scalars.AUXILIARY
_ROLE = (
    "CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in scalars.NOT_ENDINGS) + " THEN NULL "
    + " ".join(f"WHEN {' OR '.join(f"contains(t, '{w}')" for w in words)} THEN '{n}'" for n, words in scalars.ENDINGS.items())
    + " WHEN regexp_replace(rtrim(regexp_replace(t, '\\[VIP\\]$', ''), '!！。 '), '^[0-9]+[ .、]*', '') = '完结' THEN 'ending_marker_update' END"
)
D4 = f"""WITH r AS (SELECT DISTINCT platform || ':' || work_id AS work_key, TRY_CAST(chapter_number AS BIGINT) AS n, chapter_title, publication_date, update_date, chapter_number,
 coalesce(trim(regexp_replace(chapter_title, '[\\s\\x{{00a0}}\\x{{3000}}]+', ' ', 'g')), '') AS t FROM chapters),
m AS (SELECT *, {_ROLE} AS role, max(n) OVER (PARTITION BY work_key) AS m FROM r WHERE n IS NOT NULL)
SELECT work_key, role, count(*) AS n, max(coalesce(nullif(publication_date, ''), nullif(update_date, ''))) AS value FROM m
WHERE role IS NOT NULL AND n >= m * 0.6 AND coalesce(nullif(publication_date, ''), nullif(update_date, '')) IS NOT NULL GROUP BY 1, 2"""
D8 = f"""WITH c AS (SELECT platform || ':' || work_id AS work_key, CAST(chapter_number AS BIGINT) AS p, min(chapter_title) AS title FROM chapters WHERE TRY_CAST(chapter_number AS BIGINT) IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, coalesce(trim(regexp_replace(title, '[\\s\\x{{00a0}}\\x{{3000}}]+', ' ', 'g')), '') AS t, NOT regexp_matches(coalesce(title, '') || ' ', '{_AUX}') AS m FROM c),
f AS (SELECT *, m AND coalesce({_ROLE} = 'main_story_end_marker_update', false) AS x, m AND coalesce({_ROLE} IN ('all_text_end_marker_update', 'ending_marker_update'), false) AS b FROM r),
g AS (SELECT work_key, count(*) AS chapters, count(*) FILTER (WHERE NOT m) AS auxiliary, min(p) AS first, max(p) AS last, min(p) FILTER (WHERE m) AS main_start, max(p) FILTER (WHERE m) AS ml,
 count(*) FILTER (WHERE x) AS nx, max(p) FILTER (WHERE x) AS px, count(*) FILTER (WHERE b) AS nb, max(p) FILTER (WHERE b) AS pb FROM f GROUP BY 1),
s AS (SELECT g.*, CASE WHEN nx > 0 THEN nx ELSE nb END AS k, coalesce(lower(trim(w.status_raw)) IN ('完本', '已完成', '完结', 'completed', 'finished'), false) AS done FROM g LEFT JOIN work_master w USING (work_key))
SELECT work_key, chapters, auxiliary, first, last, main_start, CASE WHEN k = 1 THEN coalesce(CASE WHEN nx > 0 THEN px END, pb) WHEN k > 1 THEN NULL WHEN ml < last OR done THEN ml END AS main_end,
CASE WHEN k = 1 AND nx > 0 THEN 'explicit_main_text_title' WHEN k = 1 THEN 'ending_title' WHEN k > 1 THEN 'ambiguous_ending_titles' WHEN ml < last THEN 'before_trailing_auxiliary_titles'
 WHEN main_start IS NOT NULL AND done THEN 'completed_status_last_non_auxiliary' WHEN main_start IS NOT NULL THEN 'no_ending_marker_or_completed_status' ELSE 'unresolved' END AS end_basis, k AS ending_titles FROM s"""


def d9_wide_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row a work: the greatest text of each date role; texts of different precision compare as text."""
    seen = table(spark, folder, "source_observation", "work_key", "date_raw", "date_type").where("work_key is not null and date_raw rlike '^[0-9]{4}'")
    return seen.groupBy("work_key").agg(
        F.max(F.when(F.col("date_type") == "catalog_publication", F.col("date_raw"))).alias("catalog"), F.max(F.when(F.col("date_type") == "last_update", F.col("date_raw"))).alias("updated"), F.min("date_raw").alias("earliest")
    )


D9 = """SELECT work_key, max(date_raw) FILTER (WHERE date_type = 'catalog_publication') AS catalog, max(date_raw) FILTER (WHERE date_type = 'last_update') AS updated, min(date_raw) AS earliest
FROM source_observation WHERE work_key IS NOT NULL AND regexp_matches(date_raw, '^[0-9]{4}') GROUP BY 1"""


def d10_conflict_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "work_dates", "work_key", "catalog_pub_year", "first_chapter_publication_date", "latest_chapter_update_date")
    first, last = F.col("first_chapter_publication_date"), F.col("latest_chapter_update_date")
    return rows.select("work_key", F.coalesce(first > last, F.lit(False)).alias("first_after_last"), F.coalesce(dates.year_of(first) != F.col("catalog_pub_year"), F.lit(False)).alias("year_differs"))


D10 = """SELECT work_key, coalesce(first_chapter_publication_date > latest_chapter_update_date, false) AS first_after_last,
coalesce(TRY_CAST(regexp_extract(first_chapter_publication_date, '((?:19|20)[0-9]{2})', 1) AS INTEGER) <> catalog_pub_year, false) AS year_differs FROM work_dates"""


def d12_single_year(spark: SparkSession, folder: str) -> DataFrame:
    """The year of works for which all dated sightings of good sources agree on one."""
    seen = log(spark, folder).where("priority <= 2 and declared_pub_year is not null")
    return seen.groupBy("work_key").agg(F.sort_array(F.collect_set("declared_pub_year")).alias("y")).select("work_key", F.when(F.size("y") == 1, F.get("y", F.lit(0))).alias("year"), F.size("y").alias("years"))


D12 = f"WITH {LOG} SELECT work_key, CASE WHEN count(DISTINCT declared_pub_year) = 1 THEN min(declared_pub_year) END AS year, count(DISTINCT declared_pub_year)::INTEGER AS years FROM log WHERE pr <= 2 AND declared_pub_year IS NOT NULL GROUP BY 1"


def w2_latest_chapter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chapters", "platform", "work_id", "chapter_number", "chapter_key", "source_kind", "observed_at").where("observed_at is not null").distinct()
    marked = rows.withColumns({"work_key": F.concat_ws(":", "platform", "work_id"), "official": F.col("source_kind").isin("a_detail", "b_detail").cast("int"), "tie": F.concat_ws("|", "chapter_key", "source_kind")})
    return C.latest_per_ordinal(marked, "work_key", "chapter_number", "official", "observed_at", "tie").select("work_key", "chapter_number", "chapter_key", "observed_at")


W2 = """WITH r AS (SELECT DISTINCT platform, work_id, chapter_number, chapter_key, source_kind, observed_at, platform || ':' || work_id AS work_key, CASE WHEN source_kind IN ('a_detail', 'b_detail') THEN 1 ELSE 0 END AS o, concat_ws('|', chapter_key, source_kind) AS tie FROM chapters WHERE observed_at IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY work_key, coalesce(TRY_CAST(chapter_number AS BIGINT)::VARCHAR, 'row:' || tie) ORDER BY o DESC, observed_at DESC, tie DESC) AS k FROM r) SELECT work_key, chapter_number, chapter_key, observed_at FROM n WHERE k = 1"""


def w4_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chapters", "platform", "work_id", "chapter_number", "chapter_key", "chapter_title").where("chapter_title is not null")
    return C.endpoints(rows.withColumn("work_key", F.concat_ws(":", "platform", "work_id")), "work_key", "chapter_number", ["chapter_key", "chapter_title"])


W4 = """WITH r AS (SELECT platform || ':' || work_id AS work_key, TRY_CAST(chapter_number AS BIGINT) AS n, chapter_key, chapter_title FROM chapters WHERE chapter_title IS NOT NULL)
SELECT work_key, first(chapter_key ORDER BY n, chapter_key, chapter_title) AS first_chapter_key, first(chapter_title ORDER BY n, chapter_key, chapter_title) AS first_chapter_title,
first(chapter_key ORDER BY n DESC, chapter_key DESC, chapter_title DESC) AS last_chapter_key, first(chapter_title ORDER BY n DESC, chapter_key DESC, chapter_title DESC) AS last_chapter_title FROM r WHERE n IS NOT NULL GROUP BY 1"""

QUERIES = {
    "m01_priority_row": m1_priority_row, "m02_first_wins": m2_first_wins, "m02_conflicts": m2_conflicts, "m03_mixed_upsert": m3_mixed, "m04_chapters_newest": m4_chapters_newest,
    "m05_newest_wins": m5_newest_wins, "m05_conflicts": m5_conflicts, "m07_seed_fill": m7_seed_fill, "m08_ignore_replace": m8_ignore_replace, "m09_seen_between": m9_seen_between,
    "m10_replay": m10_replay, "m12_precedence": m12_precedence, "d01_roles": d1_roles, "d04_late_endings": d4_late_endings, "d08_main_text_window": d8_windows, "d09_wide_summary": d9_wide_summary,
    "d10_conflict_flags": d10_conflict_flags, "d12_single_year": d12_single_year, "w02_latest_chapter": w2_latest_chapter, "w04_endpoints": w4_endpoints,
}
ORACLES = {
    "m01_priority_row": M1, "m02_first_wins": M2, "m02_conflicts": M2C, "m03_mixed_upsert": M3, "m04_chapters_newest": M4, "m05_newest_wins": M5, "m05_conflicts": M5C, "m07_seed_fill": M7,
    "m08_ignore_replace": M8, "m09_seen_between": M9, "m10_replay": M10, "m12_precedence": M12, "d01_roles": D1, "d04_late_endings": D4, "d08_main_text_window": D8, "d09_wide_summary": D9,
    "d10_conflict_flags": D10, "d12_single_year": D12, "w02_latest_chapter": W2, "w04_endpoints": W4,
}
