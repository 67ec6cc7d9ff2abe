"""SQL of the survivorship query, written on its own and not derived from the plan: every combination is scored."""

from __future__ import annotations

_MISSING = "('', '未知', '暂无', '佚名', '无', '待定', 'n/a', 'na', 'null', 'none', 'unknown', 'anonymous', '-', '--', '?', '？')"


def _real(c: str) -> str:
    return f"coalesce(lower(trim({c}, ' \t 　')) NOT IN {_MISSING} AND NOT regexp_matches(trim({c}, ' \t 　'), '(…|[.]{{2,}})$'), false)"


_FIELDS = ("title", "author", "genre_raw", "declared_pub_year")
_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
#: Trust of a value: priority and recency of the observations that have it; an author that other works of the id contradict
#: is out. Options near the best are combined, one of each field, and the combination whose values have most trust, alone and in common, wins.
P7 = f"""WITH o AS (SELECT DISTINCT s.work_key, s.observation_id, s.observed_at, r.priority AS pr, s.title, s.author, s.genre_raw, s.declared_pub_year::VARCHAR AS declared_pub_year, s.author_id, s.status_raw, s.word_count
 FROM source_observation s LEFT JOIN source_registry r ON s.source_id = r.source_id WHERE s.work_key IS NOT NULL),
q AS (SELECT DISTINCT work_key, observation_id, observed_at, pr, title, author, genre_raw, declared_pub_year, author_id FROM o),
k AS (SELECT *, pow(0.6, least(greatest(coalesce(pr, 6), 1), 6) - 1) * pow(0.4, row_number() OVER (PARTITION BY work_key ORDER BY observed_at DESC NULLS LAST, md5(observation_id)) - 1) AS w,
 row_number() OVER (PARTITION BY work_key ORDER BY observed_at DESC NULLS LAST, md5(observation_id)) - 1 AS n FROM q),
e AS ({" UNION ALL ".join(f"SELECT work_key, {i} AS b, {f} AS v, {'author_id' if f == 'author' else 'NULL'} AS who, w, n FROM k WHERE {f} IS NOT NULL" for i, f in enumerate(_FIELDS))}),
t AS (SELECT work_key, b, v, min(n) AS seen, count(*) AS c, NOT {_real("v")} AS fake, CASE WHEN {_real("v")} THEN sum(w) ELSE 0 END AS trust FROM e GROUP BY 1, 2, 3),
i AS (SELECT DISTINCT work_key, b, v, who FROM e WHERE who IS NOT NULL AND {_real("v")}),
h AS (SELECT work_key, b, v, max(others) AS others FROM (SELECT *, count(*) OVER (PARTITION BY b, who, v) - 1 AS others FROM i) GROUP BY 1, 2, 3),
f AS (SELECT t.work_key, t.b, t.v, seen, c, fake, coalesce(others, 0) AS others, trust * (1 + 0.05 * least(coalesce(others, 0), 10)) AS trust FROM t LEFT JOIN h ON t.work_key = h.work_key AND t.b = h.b AND t.v = h.v),
a AS (SELECT * FROM (SELECT *, max(others) OVER g >= 2 AND sum(others) OVER g = max(others) OVER g AS binds FROM f WINDOW g AS (PARTITION BY work_key, b)) WHERE NOT binds OR others > 0),
p AS (SELECT *, max(trust) OVER (PARTITION BY work_key, b) AS best, row_number() OVER (PARTITION BY work_key, b ORDER BY trust DESC, fake, seen, c DESC, v) AS place FROM a),
s AS (SELECT *, row_number() OVER (PARTITION BY work_key, b ORDER BY round(trust / best, 10) DESC, seen, c DESC, v) AS turn, trust / best AS share FROM p WHERE trust > 0 AND trust * 1.3 >= best * 0.9999999999),
u AS (SELECT DISTINCT work_key FROM s WHERE turn > 1),
j AS (SELECT x.work_key, x.b AS b1, x.v AS v1, y.b AS b2, y.v AS v2, sum(x.w) AS w FROM e x JOIN e y ON x.work_key = y.work_key AND x.n = y.n AND x.b < y.b WHERE x.work_key IN (SELECT work_key FROM u) GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT u.work_key, {", ".join(f"s{i}.v AS v{i}, s{i}.turn AS t{i}" for i in range(4))}, {" + ".join(f"coalesce(s{i}.share, 0)" for i in range(4))} + {" + ".join(f"coalesce(0.1 * j{a}{b}.w / greatest(s{a}.best, s{b}.best), 0)" for a, b in _PAIRS)} AS score
 FROM u {" ".join(f"LEFT JOIN s s{i} ON s{i}.work_key = u.work_key AND s{i}.b = {i}" for i in range(4))}
 {" ".join(f"LEFT JOIN j j{a}{b} ON j{a}{b}.work_key = u.work_key AND j{a}{b}.b1 = {a} AND j{a}{b}.b2 = {b} AND j{a}{b}.v1 = s{a}.v AND j{a}{b}.v2 = s{b}.v" for a, b in _PAIRS)}),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_key ORDER BY round(score, 9) DESC, t0, t1, t2, t3) AS place FROM x) WHERE place = 1),
r AS (SELECT p.work_key, p.b, coalesce(CASE p.b WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END, p.v) AS v FROM p LEFT JOIN z ON p.work_key = z.work_key WHERE p.place = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY work_key ORDER BY observed_at DESC, coalesce(pr, 6), observation_id) AS place, count(*) OVER (PARTITION BY work_key) AS c, min(coalesce(pr, 6)) OVER (PARTITION BY work_key) AS best FROM o WHERE observed_at IS NOT NULL)
SELECT r.work_key, m.field AS field_name, r.v AS surviving_value FROM r JOIN (SELECT DISTINCT work_key, field FROM metadata_conflict) m ON r.work_key = m.work_key AND list_position({list(_FIELDS)}, m.field) = r.b + 1
UNION ALL SELECT work_key, 'preferred_observation_id', observation_id FROM d WHERE place = 1 AND c >= 2 AND coalesce(pr, 6) = best AND {" AND ".join(_real(x) for x in ("title", "author", "genre_raw", "status_raw", "word_count"))}"""
