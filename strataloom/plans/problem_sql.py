"""SQL of those problem queries that plain SQL can express, written on its own and not derived from the plans."""

from __future__ import annotations

_WIDE, _NARROW = "０１２３４５６７８９．，：／－＋　", "0123456789.,:/-+ "
_PROFILE = """SELECT source_id AS sk, * FROM source_registry UNION ALL SELECT source_kind AS sk, * FROM source_registry"""


def _bare(column: str) -> str:
    """A column with narrow signs, lower case, without blanks at the ends."""
    return f"regexp_replace(lower(translate({column}, '{_WIDE}', '{_NARROW}')), '^[\\s\\x{{00a0}}\\x{{3000}}\\x{{2000}}-\\x{{200b}}\\x{{feff}}]+|[\\s\\x{{00a0}}\\x{{3000}}\\x{{2000}}-\\x{{200b}}\\x{{feff}}]+$', '', 'g')"


P5 = f"""WITH s AS (SELECT DISTINCT work_key, observed_at, trim(regexp_replace(regexp_replace({_bare("status_raw")}, '^(状态|status) *: *', ''), '[\\[\\]【】()（）《》「」]', '', 'g')) AS t
 FROM source_observation WHERE work_key IS NOT NULL AND trim(observed_at) <> ''),
o AS (SELECT DISTINCT s.work_key, s.observed_at, v.status_code FROM s JOIN status_vocab v ON s.t = lower(trim(v.status_text))),
m AS (SELECT *, status_code IS DISTINCT FROM lag(status_code) OVER (PARTITION BY work_key ORDER BY observed_at, status_code) AS fresh FROM o),
r AS (SELECT work_key, status_code, observed_at AS valid_from, lead(observed_at) OVER (PARTITION BY work_key ORDER BY observed_at, status_code) AS following FROM m WHERE fresh),
l AS (SELECT platform || ':' || work_id AS work_key, max(last_seen_at) AS seen FROM works GROUP BY 1)
SELECT r.work_key, r.status_code, r.valid_from, coalesce(r.following, l.seen, '') AS valid_to FROM r LEFT JOIN l USING (work_key)"""

_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
_OFFSETS = "MAP {'utc': 0, 'gmt': 0, 'z': 0, 'jst': 540, 'est': -300, 'edt': -240, 'cet': 60, 'cest': 120, 'aest': 600, 'aedt': 660}"
#: Every notation is read by parts: the date by the notation of its start, the clock and the zone wherever they stand.
P6 = f"""WITH v AS (SELECT 'source_observation' AS table_name, observation_id AS record_key, 'date_raw' AS field_name, date_raw AS raw, source_id AS sk FROM source_observation
 UNION SELECT 'chapters', concat_ws(':', platform, work_id, chapter_key), 'publication_date', publication_date, source_kind FROM chapters
 UNION SELECT 'chapters', concat_ws(':', platform, work_id, chapter_key), 'update_date', update_date, source_kind FROM chapters
 UNION SELECT 'work_dates', work_key, 'catalog_pub_date', catalog_pub_date, '-' FROM work_dates),
p AS ({_PROFILE}),
c AS (SELECT v.*, CASE WHEN table_name = 'work_dates' THEN 'Asia/Shanghai' ELSE local_zone END AS zone, coalesce(contains(lower(notes), 'month before day'), false) AS mf, {_bare("raw")} AS t0 FROM v LEFT JOIN p USING (sk) WHERE raw IS NOT NULL),
l AS (SELECT *, contains(t0, '北京时间') AS beijing, regexp_replace(regexp_replace(t0, '^(?:[^0-9:,]{{1,24}}: *|首发 *|更新于 *|updated +|first published +|published +)', ''), '^北京时间[: ]*', '') AS t FROM c),
f AS (SELECT *, regexp_extract(t, '^([0-9]{{4}})[-/.年]([0-9]{{1,2}})[-/.月]([0-9]{{1,2}})', ['y', 'm', 'd']) AS ymd, regexp_extract(t, '^([0-9]{{4}})[-/.年]([0-9]{{1,2}})月?$', ['y', 'm']) AS ym, regexp_extract(t, '^([0-9]{{4}})年?$', 1) AS yy,
 regexp_extract(t, '^([0-9]{{1,2}})[.]([0-9]{{1,2}})[.]([0-9]{{4}})', ['d', 'm', 'y']) AS dots, regexp_extract(t, '^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})', ['a', 'b', 'y']) AS strokes,
 regexp_extract(t, '^(?:[a-z]{{3}}, )?([0-9]{{1,2}})[- ]([a-z]{{3}})[a-z]*[- ]([0-9]{{4}})', ['d', 'm', 'y']) AS dmy, regexp_extract(t, '^([a-z]{{3}})[a-z]* ([0-9]{{1,2}}),? ([0-9]{{4}})', ['m', 'd', 'y']) AS mdy,
 regexp_extract(t, '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(?:t?([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})z?)?$', ['y', 'm', 'd', 'h', 'i', 's']) AS run,
 regexp_extract(t, '[ t午]([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.]([0-9]{{1,6}}))?)?', ['h', 'i', 's', 'f']) AS clock, regexp_extract(t, '日([0-9]{{1,2}})时([0-9]{{1,2}})分([0-9]{{1,2}})秒', ['h', 'i', 's']) AS words FROM l),
g AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{{10}}$|^[0-9]{{13}}$') THEN NULL ELSE coalesce(nullif(ymd.y, ''), nullif(ym.y, ''), nullif(yy, ''), nullif(dots.y, ''), nullif(strokes.y, ''), nullif(dmy.y, ''), nullif(mdy.y, ''), nullif(run.y, ''))::INTEGER END AS y,
 strokes.a <> '' AND (CASE WHEN TRY_CAST(strokes.a AS INTEGER) > 12 THEN false WHEN TRY_CAST(strokes.b AS INTEGER) > 12 THEN true ELSE mf END) AS us,
 coalesce(nullif(clock.h, ''), nullif(words.h, ''), nullif(run.h, ''))::INTEGER AS h0, coalesce(nullif(clock.i, ''), nullif(words.i, ''), nullif(run.i, ''))::INTEGER AS mi, coalesce(nullif(clock.s, ''), nullif(words.s, ''), nullif(run.s, ''), '0')::INTEGER AS s,
 rpad(coalesce(nullif(clock.f, ''), '0'), 6, '0')::BIGINT AS us6, regexp_extract(t, '(?:[0-9]|[ap]m) *(z|[+-][0-9]{{2}}:?[0-9]{{2}}|(?:utc|gmt)(?:[+-][0-9]{{1,2}})?|[a-z]{{3,4}})$', 1) AS z FROM f),
k AS (SELECT *, coalesce(TRY_CAST(nullif(ymd.m, '') AS INTEGER), TRY_CAST(nullif(ym.m, '') AS INTEGER), TRY_CAST(nullif(dots.m, '') AS INTEGER), TRY_CAST(CASE WHEN strokes.a = '' THEN NULL WHEN us THEN strokes.a ELSE strokes.b END AS INTEGER),
 nullif(list_position({_MONTHS}, dmy.m), 0), nullif(list_position({_MONTHS}, mdy.m), 0), TRY_CAST(nullif(run.m, '') AS INTEGER)) AS m,
 coalesce(TRY_CAST(nullif(ymd.d, '') AS INTEGER), TRY_CAST(nullif(dots.d, '') AS INTEGER), TRY_CAST(CASE WHEN strokes.a = '' THEN NULL WHEN us THEN strokes.b ELSE strokes.a END AS INTEGER), TRY_CAST(nullif(dmy.d, '') AS INTEGER), TRY_CAST(nullif(mdy.d, '') AS INTEGER), TRY_CAST(nullif(run.d, '') AS INTEGER)) AS d,
 CASE WHEN regexp_matches(t, 'pm|下午') AND h0 < 12 THEN h0 + 12 WHEN regexp_matches(t, ' am|上午') AND h0 = 12 THEN 0 ELSE h0 END AS h,
 CASE WHEN h0 IS NULL OR z = '' THEN NULL WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (TRY_CAST(z[2:3] AS INTEGER) * 60 + TRY_CAST(right(z, 2) AS INTEGER))
  WHEN regexp_matches(z, '^(utc|gmt)[+-]') THEN TRY_CAST(z[4:] AS INTEGER) * 60 ELSE {_OFFSETS}[z] END AS minutes FROM g),
d AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d', y, coalesce(m, 1), coalesce(d, 1)) AS DATE) AS day FROM k),
w AS (SELECT *, CASE WHEN h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 THEN day + to_hours(h) + to_minutes(mi) + to_seconds(s) + to_microseconds(us6) END AS wall, CASE WHEN beijing AND z = '' THEN 'Asia/Shanghai' ELSE zone END AS own FROM d),
u AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{{10}}$') THEN make_timestamp(TRY_CAST(t AS BIGINT) * 1000000) WHEN regexp_matches(t, '^[0-9]{{13}}$') THEN make_timestamp(TRY_CAST(t AS BIGINT) * 1000) WHEN minutes IS NOT NULL THEN wall - to_minutes(minutes)
 WHEN h0 IS NOT NULL AND (z = '' OR z IN ('am', 'pm')) THEN CASE WHEN timezone(own, timezone(own, wall) - INTERVAL 1 HOUR) = wall THEN timezone('UTC', timezone(own, wall) - INTERVAL 1 HOUR) ELSE timezone('UTC', timezone(own, wall)) END END AS moment FROM w)
SELECT DISTINCT table_name, record_key, field_name, CASE WHEN moment IS NOT NULL THEN strftime(moment, '%Y-%m-%dT%H:%M:%S.%fZ') ELSE substr(day::VARCHAR, 1, CASE WHEN m IS NULL THEN 4 WHEN d IS NULL THEN 7 ELSE 10 END) END AS normal_time
FROM u WHERE moment IS NOT NULL OR (day IS NOT NULL AND h0 IS NULL)"""


def _section(x: str) -> str:
    """The value of a numeral below ten thousand whose digits are Arabic."""
    part = lambda mark: f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '([0-9.]+){mark}', 1), '') AS DECIMAL(18,6)), 0)"
    tens = f"CASE WHEN contains({x}, '十') THEN coalesce(TRY_CAST(nullif(regexp_extract({x}, '([0-9])十', 1), '') AS INTEGER), 1) * 10 ELSE 0 END"
    return f"({part('千')} * 1000 + {part('百')} * 100 + {tens} + coalesce(TRY_CAST(nullif(regexp_extract({x}, '([0-9.]+)$', 1), '') AS DECIMAL(18,6)), 0))"


#: A written unit or label counts, then the unit of the source; the model decides only what neither states.
P1 = f"""WITH v AS (SELECT 'work_master' AS table_name, work_key AS record_key, word_count AS raw, '-' AS sk FROM work_master
 UNION SELECT 'source_observation', observation_id, word_count, source_id FROM source_observation UNION SELECT 'chapters', concat_ws(':', platform, work_id, chapter_key), word_count, source_kind FROM chapters),
p AS ({_PROFILE}),
c AS (SELECT v.*, CASE WHEN table_name = 'work_master' THEN 1 WHEN contains(notes, '万字') THEN 10000 WHEN regexp_matches(notes, '千字|thousands of characters') THEN 1000 WHEN regexp_matches(notes, 'bytes') THEN 0.5 ELSE 1 END AS stated,
 regexp_replace({_bare("raw")}, '\\s+', '', 'g') AS t FROM v LEFT JOIN p USING (sk) WHERE raw IS NOT NULL),
l AS (SELECT *, regexp_matches(t, '^字数:') AS labelled, regexp_replace(regexp_replace(t, '^字数:', ''), '^(约|全文|共)', '') AS r FROM c),
n AS (SELECT *, regexp_extract(r, '^([0-9,]+(?:[.][0-9]+)?)(字节|bytes|b|kb|千字?|k字?|万字?|w字?|字符?|chars|characters)?$', ['n', 'u']) AS a, translate(r, '一二两三四五六七八九零', '12234567890') AS z FROM l),
s AS (SELECT *, TRY_CAST(nullif(replace(a.n, ',', ''), '') AS DECIMAL(18,6)) * CASE WHEN a.u IN ('字节', 'bytes', 'b') THEN 0.5 WHEN a.u = 'kb' THEN 512 WHEN a.u IN ('千', '千字', 'k', 'k字') THEN 1000 WHEN a.u IN ('万', '万字', 'w', 'w字') THEN 10000
 WHEN a.u <> '' OR labelled THEN 1 ELSE stated END AS plain,
 CASE WHEN a.n = '' AND regexp_matches(z, '^[0-9千百十]*万?[0-9千百十]+字$|^[0-9千百十]+万字$') THEN {_section("CASE WHEN contains(z, '万') THEN split_part(z, '万', 1) ELSE '' END")} * 10000 + {_section("replace(CASE WHEN contains(z, '万') THEN split_part(z, '万', 2) ELSE z END, '字', '')")} END AS words FROM n)
SELECT DISTINCT table_name, record_key, floor(coalesce(plain, words))::BIGINT AS char_count FROM s WHERE coalesce(plain, words) IS NOT NULL AND raw <> floor(coalesce(plain, words))::BIGINT::VARCHAR"""
