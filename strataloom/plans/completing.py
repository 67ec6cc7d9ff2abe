"""Gates by named checks, envelopes, parsers of generated pages, and the remaining forms of projection, evidence and merge."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import dates, scalars
from strataloom.functions.text import BLANK
from strataloom.operators import audit, merge
from strataloom.sources import pages
from strataloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):  # noqa: ANN201
    """Registers a query, with the SQL that gives the same rows."""

    def add(function):  # noqa: ANN001, ANN202
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return add


# Gates. A check is a unique key, a reference or a rule; rules are predicates that both engines read.
UNIQUE = {"q03_checks": [("work_master", "work_key"), ("work_dates", "work_key"), ("source_observation", "observation_id"), ("external_bibliography", "external_key"), ("legacy_bibliography", "legacy_id"), ("metadata_conflict", "conflict_id")], "q04_checks": [("work_dates", "work_key")]}
REFERENCES = {
    "q03_checks": [("work_master", "preferred_observation_id", "source_observation", "observation_id"), ("source_observation", "source_id", "source_registry", "source_id"), ("metadata_conflict", "observation_id", "source_observation", "observation_id"), ("source_observation", "work_key", "work_master", "work_key")],
    "q04_checks": [("work_dates", "work_key", "work_master", "work_key"), ("work_master", "work_key", "work_dates", "work_key")],
}
RULES = {
    "q03_checks": [("work_master", "unverified", "first_pub_year_verified IS NULL"), ("work_master", "key", "work_key = concat(platform, ':', platform_work_id)"), ("work_master", "titled", "trim(title) <> ''"), ("legacy_bibliography", "year", "source_reported_year IS NULL OR source_reported_year BETWEEN 1990 AND 2026"), ("legacy_bibliography", "month", "source_reported_month IS NULL OR source_reported_month BETWEEN 1 AND 12"), ("external_bibliography", "unlinked", "linked_work_key IS NULL")],
    "q04_checks": [("work_dates", "flag", "chapter_time_conflict IN (0, 1)"), ("work_dates", "year", "catalog_pub_year IS NULL OR catalog_pub_year BETWEEN 1990 AND 2026"), ("work_dates", "dated", "catalog_pub_date IS NOT NULL OR catalog_pub_year IS NULL"), ("work_dates", "ordered", "first_chapter_publication_date IS NULL OR latest_chapter_update_date IS NULL OR first_chapter_publication_date <= latest_chapter_update_date")],
}


def _gate_sql(gate: str) -> str:
    parts = [f"SELECT 'unique:{t}.{k}' AS \"check\", count(*) AS n FROM (SELECT {k} FROM {t} GROUP BY 1 HAVING count(*) > 1)" for t, k in UNIQUE[gate]]
    parts += [f"SELECT 'reference:{t}.{k}', count(*) FROM {t} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {q} FROM {p} WHERE {q} IS NOT NULL)" for t, k, p, q in REFERENCES[gate]]
    parts += [f"SELECT 'rule:{t}.{name}', count(*) FILTER (WHERE NOT coalesce({rule}, false)) FROM {t}" for t, name, rule in RULES[gate]]
    return f"SELECT \"check\", n = 0 AS passed, n FROM ({' UNION ALL '.join(parts)})"


def _gate(spark: SparkSession, folder: str, gate: str) -> DataFrame:
    """(check, passed, n) of every named check; the rules of a table in one pass."""
    checks = [audit.unique(table(spark, folder, t, k), f"{t}.{k}", [k]) for t, k in UNIQUE[gate]]
    checks += [audit.refers(table(spark, folder, t, k), table(spark, folder, p, q), f"{t}.{k}", k, q) for t, k, p, q in REFERENCES[gate]]
    for t in dict.fromkeys(t for t, _, _ in RULES[gate]):
        checks.append(audit.rules(table(spark, folder, t), t, {name: F.expr(rule) for u, name, rule in RULES[gate] if u == t}))
    return audit.union(checks)


@query("q03_checks", _gate_sql("q03_checks"))
def q3(spark: SparkSession, folder: str) -> DataFrame:
    return _gate(spark, folder, "q03_checks")


@query("q04_checks", _gate_sql("q04_checks"))
def q4(spark: SparkSession, folder: str) -> DataFrame:
    return _gate(spark, folder, "q04_checks")


@query("q10_reasons", r"""WITH c AS (SELECT s.*, split_part(work_key, ':', 1) AS own, r.platform AS theirs, CASE WHEN json_valid(raw_record_json) THEN json_keys(raw_record_json) END AS ks, TRY_CAST(declared_pub_year AS DOUBLE) AS y FROM source_observation s LEFT JOIN (SELECT source_id, max(platform) AS platform FROM source_registry GROUP BY 1) r USING (source_id))
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN work_key IS NULL THEN 'no_work' WHEN NOT regexp_matches(work_key, '^[a-z0-9_]+:[0-9]+$') THEN 'bad_key' WHEN observed_at IS NULL THEN 'no_time' WHEN NOT regexp_matches(observed_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN 'no_zone'
WHEN theirs IS NOT NULL AND theirs <> own THEN 'other_platform' WHEN y IS NOT NULL AND NOT (isfinite(y) AND y BETWEEN 1900 AND 2100) THEN 'bad_year' WHEN raw_record_json IS NULL THEN 'no_payload' WHEN ks IS NULL THEN 'cut_off' WHEN len(ks) <> len(list_distinct(ks)) THEN 'repeated_key' END AS reason FROM c) GROUP BY 1""")  # fmt: skip
def q10(spark: SparkSession, folder: str) -> DataFrame:
    """Observations by the first rule of the envelope that they break: types, time basis, platform, finite numbers, payload."""
    platforms = table(spark, folder, "source_registry", "source_id", "platform").groupBy("source_id").agg(F.max("platform").alias("theirs"))
    rows = table(spark, folder, "source_observation", "source_id", "work_key", "observed_at", "declared_pub_year", "raw_record_json").join(platforms, "source_id", "left")
    year, keys = F.col("declared_pub_year").try_cast("double"), F.json_object_keys("raw_record_json")
    checks = {
        "no_work": F.col("work_key").isNotNull(),
        "bad_key": F.col("work_key").rlike("^[a-z0-9_]+:[0-9]+$"),
        "no_time": F.col("observed_at").isNotNull(),
        "no_zone": F.col("observed_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})$"),
        "other_platform": F.col("theirs").isNull() | (F.col("theirs") == F.split_part("work_key", F.lit(":"), F.lit(1))),
        "bad_year": year.isNull() | (year.between(1900, 2100) & ~F.isnan(year)),
        "no_payload": F.col("raw_record_json").isNotNull(),
        "cut_off": F.try_parse_json("raw_record_json").isNotNull() & keys.isNotNull(),
        "repeated_key": F.size(keys) == F.size(F.array_distinct(keys)),
    }
    return audit.envelope(rows, checks).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# Pages. Every work gives a page of each kind; what the parser reads back is compared with the columns.
_BARE_SQL = "regexp_replace(coalesce({}, ''), '[\\s\\x{{00a0}}\\x{{3000}}\\x{{2000}}-\\x{{200b}}\\x{{feff}}]+', '', 'g')"


def _sql(*columns: str) -> str:
    return ", ".join(f"{_BARE_SQL.format(c)} AS {a}" for c, a in (x.split(" AS ") if " AS " in x else (x, x) for x in columns))


def _bare(*columns: str) -> list[Column]:
    """Columns without any blanks, null as empty: pages don't tell kinds of white space apart."""
    return [F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK}+", "").alias(c) for c in columns]


def _html(c: str) -> Column:
    text = F.coalesce(F.col(c), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _works(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "work_master", "work_key", "platform_work_id", "title", "author", "genre_raw", "status_raw", "word_count", "platform_declared_pub_date")


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


@query("pj12_catalog_page", f"SELECT work_key, {_sql('platform_work_id AS id', 'title', 'author', 'genre_raw AS genre', 'status_raw AS status', 'word_count AS words', 'platform_declared_pub_date AS date')}, 2 AS page, 9 AS pages, '/list?page=3' AS next, '2020,2021' AS years FROM work_master")
def p12(spark: SparkSession, folder: str) -> DataFrame:
    rows = _works(spark, folder)
    cells = _row(*[_html(c) for c in ("platform_work_id", "title", "author", "genre_raw", "status_raw", "word_count", "platform_declared_pub_date")])
    head = '<select name="year"><option value="">全部</option><option value="2020">2020</option><option value="2021">2021</option></select><table>'
    html = F.concat(F.lit(head), _row(F.lit("a heading")), cells, F.lit('</table><p>共9页 当前为第2页</p><a href="/list?page=1">上一页</a><a href="/list?page=3">下一页</a>'))
    schema = ", ".join(f"{c} string" for c in pages.CATALOG) + ", page int, pages int, next string, years string"
    found = pages.parse(rows.select("work_key", html.alias("html")), "html", pages.catalog_page, schema, ("work_key",))
    return found.select("work_key", *_bare(*pages.CATALOG), "page", "pages", "next", "years")


@query("pj13_detail_page", f"SELECT work_key, {_sql('title', 'author', 'status_raw AS status', 'genre_raw AS genre')}, number, CASE WHEN number = '1' THEN '第一章' ELSE '第二章' END AS chapter, CASE WHEN number = '1' THEN '2020-01-01' ELSE '2020-01-02' END AS date FROM work_master, (VALUES ('1'), ('2')) AS n(number) WHERE {_BARE_SQL.format('title')} <> '' OR title IS NULL OR title = ''")
def p13(spark: SparkSession, folder: str) -> DataFrame:
    """Works from their own pages; chapters stand in a table on one half of the pages and on cards on the other."""
    rows = _works(spark, folder)
    chapters = (("1", "第一章", "2020-01-01"), ("2", "第二章", "2020-01-02"))
    listed = "<table>" + "".join(f"<tr><td>{n}</td><td>{t}</td><td>{d}</td></tr>" for n, t, d in chapters) + "</table>"
    cards = "".join(f'<a class="chapter vip" data-number="{n}" title="{d}"><span>{t}</span></a>' for n, t, d in chapters)
    fields = F.concat(*[x for label, c in (("作者", "author"), ("状态", "status_raw"), ("类型", "genre_raw")) for x in (F.lit(f"<li>{label}："), _html(c), F.lit("</li>"))])
    # A page without a heading is no detail page: works without a title get a mark.
    html = F.concat(F.lit("<h1>|"), _html("title"), F.lit("</h1><ul>"), fields, F.lit("</ul>"), F.when(F.crc32("work_key") % 2 == 0, listed).otherwise(cards))
    found = pages.parse(rows.select("work_key", html.alias("html")), "html", pages.detail_page, "title string, author string, status string, genre string, number string, chapter string, date string", ("work_key",))
    return found.withColumn("title", F.substring("title", 2, 1 << 20)).select("work_key", *_bare("title", "author", "status", "genre"), "number", "chapter", "date")


@query("pj14_rank_page", f"SELECT work_key, '1' AS place, {_sql('platform_work_id AS id', 'title', 'word_count AS words')}, '2024-05-01 08:30' AS made FROM work_master")
def p14(spark: SparkSession, folder: str) -> DataFrame:
    rows = _works(spark, folder)
    cells = _row(F.lit("1"), *[_html(c) for c in ("platform_work_id", "title", "author", "genre_raw", "status_raw", "word_count")], F.lit("9"))
    html = F.concat(F.lit("<p>更新时间：2024-05-01 08:30</p><table>"), cells, F.lit("</table>"))
    found = pages.parse(rows.select("work_key", html.alias("html")), "html", pages.rank_page, ", ".join(f"{c} string" for c in pages.RANK) + ", made string", ("work_key",))
    return found.select("work_key", "place", *_bare("id", "title", "words"), "made")


@query("pj15_issue_page", f"SELECT work_key, 'b7' AS id, {_sql('title')}, CASE WHEN author IS NULL THEN NULL ELSE '2024-05-01' END AS issued FROM work_master")
def p15(spark: SparkSession, folder: str) -> DataFrame:
    """Books of issues; an issue that shows two different dates outside its books has none."""
    rows = _works(spark, folder)
    html = F.concat(F.lit('<h2>2024年5月1日</h2><div class="book">2019-01-01 <a href="/book/b7">'), _html("title"), F.lit("</a></div>"), F.when(F.col("author").isNull(), "<p>2024-05-02</p>").otherwise("<p>2024-05-01</p>"))
    found = pages.parse(rows.select("work_key", html.alias("html")), "html", pages.issue_page, "id string, title string, issued string", ("work_key",))
    return found.select("work_key", "id", *_bare("title"), "issued")


@query("pj17_json_ld", f"SELECT work_key, {_sql('title AS name')} FROM work_master WHERE author IS NOT NULL")
def p17(spark: SparkSession, folder: str) -> DataFrame:
    """Titles from the JSON-LD object of the work that was asked for; pages of works without author show another work's."""
    rows = _works(spark, folder)
    item = F.to_json(F.struct(F.lit("Book").alias("@type"), F.when(F.col("author").isNull(), "another").otherwise(F.col("work_key")).alias("@id"), F.coalesce("title", F.lit("")).alias("name")))
    html = F.concat(F.lit('<script type="application/ld+json">'), F.replace(item, F.lit("<"), F.lit("\\u003c")), F.lit("</script>"), F.lit("<i>"), F.col("work_key"), F.lit("</i>"))

    def parser(page: str) -> list[dict]:
        return pages.asked_object(page, ("Book",), pages.tree(page).all("i")[0].text())

    return pages.parse(rows.select("work_key", html.alias("html")), "html", parser, "name string", ("work_key",)).select("work_key", *_bare("name"))


@query("pj18_category_json", "SELECT work_key, 0 AS place, platform_work_id AS id, title, 3 AS page, 90 AS total FROM work_master UNION ALL SELECT work_key, 1, 'x', NULL, 3, 90 FROM work_master")
def p18(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and paging of a category's JSON, read by its schema in the JVM."""
    rows = _works(spark, folder)
    item = lambda i, t: F.struct(i.alias("id"), t.alias("title"))
    raw = F.to_json(F.struct(F.struct(F.lit(3).alias("page"), F.lit(90).alias("total")).alias("paging"), F.array(item(F.col("platform_work_id"), F.col("title")), item(F.lit("x"), F.lit(None).cast("string"))).alias("records")))
    read = rows.select("work_key", F.from_json(raw, "paging struct<page:int,total:int>, records array<struct<id:string,title:string>>").alias("j"))
    return read.select("work_key", "j.paging", F.posexplode("j.records").alias("place", "r")).select("work_key", "place", "r.id", "r.title", "paging.page", "paging.total")


# Projections, rejects and labels.
@query("pj09_year_check", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN platform_declared_pub_year IS NULL THEN 'no_year' WHEN y IS NULL THEN 'no_date' WHEN y <> platform_declared_pub_year THEN 'other_year' END AS reason FROM (SELECT *, TRY_CAST(nullif(regexp_extract(platform_declared_pub_date, '(19|20)[0-9]{2}'), '') AS INTEGER) AS y FROM work_master)) GROUP BY 1")
def p9(spark: SparkSession, folder: str) -> DataFrame:
    """Works by whether the declared year is the year of the declared date; what disagrees is a reject with its reason."""
    rows = table(spark, folder, "work_master", "platform_declared_pub_year", "platform_declared_pub_date")
    year, of_date = F.col("platform_declared_pub_year"), dates.year_of(F.col("platform_declared_pub_date"))
    return audit.envelope(rows, {"no_year": year.isNotNull(), "no_date": of_date.isNotNull(), "other_year": year == of_date}).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("pj26_candidate_files", """WITH f AS (SELECT source_id || '/' || coalesce(row_locator, '') || CASE WHEN observation_id LIKE '%1' THEN '.csv' WHEN observation_id LIKE '%2' THEN '.json' WHEN observation_id LIKE '%3' THEN '.tmp' ELSE '.sqlite' END AS path, octet_length(encode(raw_record_json)) AS size FROM source_observation)
SELECT CASE WHEN path LIKE '%.csv' THEN 'table' WHEN path LIKE '%.json' THEN 'document' ELSE 'database' END AS kind, count(*) AS files, sum(size)::BIGINT AS bytes FROM f WHERE NOT regexp_matches(path, '(^|/)(test|cache|tmp)(/|$)') AND path NOT LIKE '%.tmp' AND size BETWEEN 50 AND 100000 GROUP BY 1""")  # fmt: skip
def p26(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a listing that may be read, by kind: no denied folder, a known suffix, a size within bounds."""
    name = F.col("observation_id")
    suffix = F.when(name.endswith("1"), ".csv").when(name.endswith("2"), ".json").when(name.endswith("3"), ".tmp").otherwise(".sqlite")
    files = table(spark, folder, "source_observation", "observation_id", "source_id", "row_locator", "raw_record_json").select(F.concat("source_id", F.lit("/"), F.coalesce("row_locator", F.lit("")), suffix).alias("path"), F.octet_length("raw_record_json").alias("size"))
    kinds = F.create_map(*[F.lit(x) for pair in ((".csv", "table"), (".json", "document"), (".sqlite", "database")) for x in pair])
    kind = F.try_element_at(kinds, F.regexp_extract("path", r"(\.[a-z]+)$", 1))
    allowed = files.where(~F.col("path").rlike("(^|/)(test|cache|tmp)(/|$)") & F.col("size").between(50, 100000)).withColumn("kind", kind).where("kind is not null")
    return allowed.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("bytes"))


@query("pj27_availability", "SELECT work_key, CASE WHEN synopsis IS NOT NULL AND trim(synopsis) <> '' THEN 'synopsis' WHEN work_url IS NOT NULL THEN 'link' ELSE 'none' END AS text_availability, 'catalogue' AS basis FROM work_master")
def p27(spark: SparkSession, folder: str) -> DataFrame:
    held = F.when(merge.filled(F.col("synopsis")), "synopsis").when(F.col("work_url").isNotNull(), "link").otherwise("none")
    return table(spark, folder, "work_master", "work_key", "synopsis", "work_url").select("work_key", held.alias("text_availability"), F.lit("catalogue").alias("basis"))


@query("pj29_id_disagreement", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN platform_work_id IS NULL OR regexp_matches(platform_work_id, '^0*$') THEN 'skipped' WHEN u = '' THEN 'no_id_in_url' WHEN u = platform_work_id THEN 'agrees' ELSE 'rejected' END AS outcome FROM (SELECT *, coalesce(regexp_extract(work_url, '([0-9]+)[^0-9]*$', 1), '') AS u FROM work_master)) GROUP BY 1")
def p29(spark: SparkSession, folder: str) -> DataFrame:
    """Works by whether the last number in their address is their id; zero ids are skipped, others that differ are rejected."""
    known, in_url = F.col("platform_work_id"), F.coalesce(F.regexp_extract("work_url", "([0-9]+)[^0-9]*$", 1), F.lit(""))
    outcome = F.when(known.isNull() | known.rlike("^0*$"), "skipped").when(in_url == "", "no_id_in_url").when(in_url == known, "agrees").otherwise("rejected")
    return table(spark, folder, "work_master", "platform_work_id", "work_url").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("f24_refresh_days", "SELECT work_key, CASE WHEN title IS NULL THEN NULL WHEN coalesce(lower(trim(status_raw)) IN ('完本', '已完成', '完结', 'completed', 'finished'), false) THEN 90 ELSE 14 END AS days FROM work_master")
def f24(spark: SparkSession, folder: str) -> DataFrame:
    """Days until each work is looked at again; rows without a title stand for lists."""
    return table(spark, folder, "work_master", "work_key", "title", "status_raw").select("work_key", scalars.refresh_days(F.col("title").isNull(), F.col("status_raw")).alias("days"))


@query("f29_confidence_label", "SELECT observation_id, CASE WHEN date_type IS NULL OR date_raw IS NULL THEN 'undated' WHEN priority = 1 THEN 'declared' WHEN priority <= 3 THEN 'reported' ELSE 'weak' END AS label FROM source_observation LEFT JOIN (SELECT source_id, min(priority) AS priority FROM source_registry GROUP BY 1) USING (source_id)")
def f29(spark: SparkSession, folder: str) -> DataFrame:
    """How far the date of an observation can be trusted, from its role and the rank of its source."""
    ranks = table(spark, folder, "source_registry", "source_id", "priority").groupBy("source_id").agg(F.min("priority").alias("priority"))
    label = F.when(F.col("date_type").isNull() | F.col("date_raw").isNull(), "undated").when(F.col("priority") == 1, "declared").when(F.col("priority") <= 3, "reported").otherwise("weak")
    return table(spark, folder, "source_observation", "observation_id", "source_id", "date_type", "date_raw").join(ranks, "source_id", "left").select("observation_id", label.alias("label"))


# Evidence and merges.
@query("d07_claims", "SELECT work_key, count(*) FILTER (WHERE trim(date_raw) <> '') AS claims, count(DISTINCT date_raw) FILTER (WHERE trim(date_raw) <> '') AS spellings FROM source_observation WHERE work_key IS NOT NULL GROUP BY 1")
def d7(spark: SparkSession, folder: str) -> DataFrame:
    """Every claim of a date stays in the evidence, whichever becomes current: claims and their spellings by work."""
    c = F.col("date_raw")
    rows = table(spark, folder, "source_observation", "work_key", "date_raw").where("work_key is not null")
    return rows.groupBy("work_key").agg(F.count_if(merge.filled(c)).alias("claims"), F.countDistinct(F.when(merge.filled(c), c)).alias("spellings"))


@query("d14_endpoint_roles", """WITH c AS (SELECT platform || ':' || work_id AS work_key, TRY_CAST(chapter_number AS BIGINT) AS n, publication_date AS p FROM chapters), f AS (SELECT work_key, min(n) AS a FROM c WHERE n IS NOT NULL GROUP BY 1)
SELECT work_key, CASE WHEN a = 1 THEN 'first_chapter_publication' ELSE 'chapter_publication' END AS role, max(p) AS value FROM c JOIN f USING (work_key) WHERE n = a AND p IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def d14(spark: SparkSession, folder: str) -> DataFrame:
    """The date of a work's earliest known chapter: its first publication only if that is chapter 1, else mere evidence."""
    rows = table(spark, folder, "chapters", "platform", "work_id", "chapter_number", "publication_date")
    first = rows.select(F.concat_ws(":", "platform", "work_id").alias("work_key"), F.col("chapter_number").try_cast("bigint").alias("n"), "publication_date").where("n is not null")
    # The greatest date text among the rows of the smallest number: numbers are negated, so one maximum finds both.
    dated = first.groupBy("work_key", "n").agg(F.max("publication_date").alias("value")).groupBy("work_key").agg(F.min(F.struct("n", "value")).alias("e"))
    role = F.when(F.col("e.n") == 1, "first_chapter_publication").otherwise("chapter_publication")
    return dated.where("e.value is not null").select("work_key", role.alias("role"), "e.value")


@query("m06_chapter_merge", """WITH c AS (SELECT platform, work_id, coalesce(nullif(trim(chapter_key), ''), 'n:' || chapter_number) AS k, coalesce(observed_at, '') AS t, chapter_title AS a, publication_date AS b FROM chapters)
SELECT platform, work_id, k AS chapter, (max(struct_pack(t := t, v := a)) FILTER (WHERE trim(a) <> '')).v AS title, (max(struct_pack(t := t, v := b)) FILTER (WHERE trim(b) <> '')).v AS published FROM c WHERE k IS NOT NULL GROUP BY 1, 2, 3""")  # fmt: skip
def m6(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters from all sightings: the newest filled value of each field; a chapter without a key is known by its number."""
    rows = table(spark, folder, "chapters", "platform", "work_id", "chapter_key", "chapter_number", "observed_at", "chapter_title", "publication_date")
    key = F.coalesce(F.nullif(F.trim("chapter_key"), F.lit("")), F.concat(F.lit("n:"), "chapter_number"))
    # Aliases of a field are folded before the merge.
    named = rows.select("platform", "work_id", key.alias("chapter"), F.coalesce("observed_at", F.lit("")).alias("t"), F.col("chapter_title").alias("title"), F.col("publication_date").alias("published")).where("chapter is not null")
    return named.groupBy("platform", "work_id", "chapter").agg(merge.last_value("title", "t").alias("title"), merge.last_value("published", "t").alias("published"))


@query("m11_ownership", "SELECT node, count(*) AS seen, count(*) FILTER (WHERE length(platform) % 3 = node) AS owned FROM works, (VALUES (0), (1), (2)) AS n(node) GROUP BY 1")
def m11(spark: SparkSession, folder: str) -> DataFrame:
    """What each of three nodes sees, all rows, and owns, by the plan that gives every platform one owner."""
    per = table(spark, folder, "works", "platform").groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    nodes = per.withColumn("node", F.explode(F.array(*map(F.lit, range(3)))))
    return nodes.groupBy("node").agg(F.sum("n").alias("seen"), F.sum(F.when(F.length("platform") % 3 == F.col("node"), F.col("n")).otherwise(0)).alias("owned"))


# Functions that other queries only have inside.
@query("pj07_digit_first", "SELECT observation_id, coalesce(regexp_matches(date_raw, '^[0-9]'), false) AS dated FROM source_observation")
def p7(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_observation", "observation_id", "date_raw").select("observation_id", scalars.starts_with_digit(F.col("date_raw")).alias("dated"))


@query("pj16_state_agrees", "SELECT work_key, platform_work_id IS NOT NULL AND author IS NOT NULL AS agrees FROM work_master")
def p16(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the state that a page holds as JSON agrees with its visible list; works without author show another id."""
    rows = _works(spark, folder)
    state = F.to_json(F.array(F.struct(F.col("platform_work_id").alias("id"))))
    shown = F.when(F.col("author").isNull(), "x").otherwise(F.coalesce("platform_work_id", F.lit("")))
    html = F.concat(F.lit('<script id="state">'), state, F.lit('</script><ul><li data-id="'), shown, F.lit('">'), _html("title"), F.lit("</li></ul>"))

    def parser(page: str) -> list[dict]:
        visible = [{"id": n.attributes.get("data-id")} for n in pages.tree(page).all("li")]
        return [{"agrees": pages.agrees(pages.embedded_state(page, "state"), visible, ["id"])}]

    return pages.parse(rows.select("work_key", html.alias("html")), "html", parser, "agrees boolean", ("work_key",))


@query("pj20_volumes", "SELECT work_key, CASE WHEN place = 2 THEN NULL ELSE '卷一' END AS volume, place, 'c' || place AS chapter FROM work_master, (VALUES (0), (1), (2)) AS n(place)")
def p20(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of a tree of volumes with the nearest volume's name, in order; a chapter beside the volumes has none."""
    raw = F.lit('[{"vN": "卷一", "cs": [{"name": "c0"}, {"part": [{"name": "c1"}]}]}, {"name": "c2"}]')

    def parser(page: str) -> list[dict]:
        return [{"volume": v, "place": i, "chapter": c["name"]} for i, (v, c) in enumerate(pages.flatten(json.loads(page)))]

    return pages.parse(table(spark, folder, "work_master", "work_key").withColumn("html", raw), "html", parser, "volume string, place int, chapter string", ("work_key",))


@query("pj22_challenge", "SELECT work_key, author IS NULL AS challenged FROM work_master")
def p22(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that ask for a code instead of showing the work; a word in a script is none."""
    rows = _works(spark, folder)
    html = F.concat(F.lit("<script>var captcha = 0</script><h1>"), _html("work_key"), F.lit("</h1>"), F.when(F.col("author").isNull(), "<p>请输入验证码</p>").otherwise(""))
    return pages.parse(rows.select("work_key", html.alias("html")), "html", lambda page: [{"challenged": pages.is_challenge(page)}], "challenged boolean", ("work_key",))


@query("d02_current_roles", """SELECT role, count(*) AS n, role NOT IN ('chapter_publication', 'chapter_update') AS is_current FROM (SELECT 'chapter_publication' AS role FROM chapters WHERE publication_date IS NOT NULL UNION ALL SELECT 'chapter_update' FROM chapters WHERE update_date IS NOT NULL
UNION ALL SELECT 'catalog_publication' FROM work_dates WHERE catalog_pub_date IS NOT NULL) GROUP BY 1""")  # fmt: skip
def d2(spark: SparkSession, folder: str) -> DataFrame:
    """Dates by role, and whether a role may become a work's current value: dates of single chapters never do."""
    of_chapters = table(spark, folder, "chapters", "publication_date", "update_date").select(F.explode(dates.stack_roles({"chapter_publication": "publication_date", "chapter_update": "update_date"})).alias("e"))
    of_works = table(spark, folder, "work_dates", "catalog_pub_date").select(F.explode(dates.stack_roles({"catalog_pub_date": "catalog_pub_date"})).alias("e"))
    counted = of_chapters.unionByName(of_works).groupBy(dates.role_of(F.col("e.role")).alias("role")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("is_current", dates.is_current_role(F.col("role")))


@query("d15_single_date", "SELECT work_key, CASE WHEN catalog_pub_date IS NULL THEN first_chapter_publication_date WHEN first_chapter_publication_date IS NULL OR first_chapter_publication_date = catalog_pub_date THEN catalog_pub_date END AS date FROM work_dates")
def d15(spark: SparkSession, folder: str) -> DataFrame:
    """The one date that a work's page and its first chapter agree on, or that only one of them has."""
    rows = table(spark, folder, "work_dates", "work_key", "catalog_pub_date", "first_chapter_publication_date")
    return rows.select("work_key", dates.single_date(F.array("catalog_pub_date", "first_chapter_publication_date")).alias("date"))


@query("f23_retry_after", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN floor(value)::BIGINT WHEN 1 THEN greatest(0, epoch(TIMESTAMP '2024-01-05 01:00:00')::BIGINT - floor(epoch(ts))::BIGINT) END AS seconds FROM events WHERE value >= 0")
def f23(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds to wait from a server's header: seconds, a date, or neither."""
    kind = F.col("event_id") % 3
    header = F.when(kind == 0, F.floor("value").cast("string")).when(kind == 1, "Fri, 05 Jan 2024 01:00:00 GMT").otherwise("soon")
    rows = table(spark, folder, "events", "event_id", "ts", "value").where("value >= 0")
    return rows.select("event_id", scalars.retry_after_seconds(header, F.col("ts").cast("timestamp")).alias("seconds"))


@query("q05_same_bag", "SELECT 'left' AS side, (SELECT count(*) FROM works) - (SELECT count(*) FROM (SELECT DISTINCT * FROM works)) AS rows UNION ALL SELECT 'right', 0")
def q5(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that the works have more often than their distinct rows, and the other way round."""
    works = table(spark, folder, "works")
    return audit.same_bag(works, works.distinct())
