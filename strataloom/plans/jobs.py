"""Queries of the job log: the events table read as the log of a queue whose jobs are its users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import events, jobs
from strataloom.sources import files
from strataloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: What the types of events stand for in the log.
KINDS = {"signup": "enqueued", "view": "claimed", "click": "deferred", "purchase": "finished", "error": "failed"}
#: The failures that are told apart, and other names of theirs.
CATEGORIES = ("network", "blocked", "parse", "unknown")
ALIASES = {"timeout": "network", "dns": "network", "captcha": "blocked", "layout": "parse"}
#: The moment at which the state is asked for: the end of the log.
NOW = "SELECT floor(max(epoch(ts))) FROM events"


def query(name: str, sql: str):  # noqa: ANN201
    """Registers a query, with the SQL that gives the same rows."""

    def add(function):  # noqa: ANN001, ANN202
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return add


def log(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type")), F.lit("enqueued"))
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return rows.select(F.col("user_id").alias("job"), F.col("event_id").alias("order"), at.alias("at"), kind.alias("kind"), (F.col("value") / 100).alias("coverage"), F.when(F.col("event_type") == "click", 60.0).alias("delay"))


def now(rows: DataFrame) -> Column:
    """The end of the log, as a scalar subquery."""
    return rows.agg(F.max("at")).scalar()


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The folded log with the moment ``now``."""
    rows = log(spark, folder)
    return jobs.fold(rows).withColumn("now", now(rows))


_E = f"""e AS (SELECT DISTINCT user_id AS job, event_id AS o, floor(epoch(ts))::BIGINT AS sec, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} ELSE 'enqueued' END AS kind, value / 100 AS coverage, CASE WHEN event_type = 'click' THEN 60.0 END AS delay FROM events),
b AS (SELECT job, coalesce(max(o) FILTER (WHERE kind = 'finished'), 0) AS b FROM e GROUP BY 1),
c AS (SELECT e.job, count(*) FILTER (WHERE kind = 'failed' AND o > b.b) AS failures, count(*) FILTER (WHERE kind = 'deferred' AND o > b.b) AS deferrals, count(*) FILTER (WHERE kind = 'finished') AS finishes, max(sec) AS updated_at FROM e JOIN b USING (job) GROUP BY 1),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job ORDER BY o DESC) = 1),
w AS ({NOW}),
s AS (SELECT l.job, l.kind, l.sec, failures, deferrals, finishes, updated_at, (SELECT * FROM w) AS now, CASE WHEN l.kind = 'finished' THEN CASE WHEN coverage >= 1 THEN 'done' WHEN coverage > 0 THEN 'pending' ELSE 'unresolved' END WHEN l.kind = 'claimed' AND l.sec + {jobs.LEASE} > (SELECT * FROM w) THEN 'leased' ELSE 'pending' END AS status,
 CASE l.kind WHEN 'failed' THEN l.sec + CASE WHEN failures >= 5 THEN greatest(least(86400, 30 * pow(2, least(failures - 1, 12))), 3600) ELSE 30 * pow(2, failures - 1) END WHEN 'deferred' THEN l.sec + 60 WHEN 'claimed' THEN l.sec + {jobs.LEASE} ELSE l.sec END::DOUBLE AS due_at FROM l JOIN c USING (job))"""


def _now() -> Column:
    return F.col("now")


@query("t02_claim", f"WITH {_E}, x AS (SELECT job % 7 AS grp, max(sec) + 3600 AS until FROM e WHERE kind = 'failed' AND coverage > 1.5 GROUP BY 1) SELECT job, due_at FROM s WHERE status = 'pending' AND due_at <= now AND job % 7 NOT IN (SELECT grp FROM x WHERE until > (SELECT * FROM w)) ORDER BY due_at, job LIMIT 50")
def t2(spark: SparkSession, folder: str) -> DataFrame:
    """The next 50 jobs to be claimed (a limit that is the feature): expired leases are free again, groups that cool down wait."""
    rows = log(spark, folder)
    blocked = rows.where("kind = 'failed' and coverage > 1.5").groupBy((F.col("job") % 7).alias("grp")).agg((F.max("at") + 3600).alias("blocked_until"))
    waiting = blocked.where(F.col("blocked_until") > now(rows)).select("grp")
    return jobs.claimable(state(spark, folder).withColumn("grp", F.col("job") % 7), waiting, "grp", _now(), 50).select("job", "due_at")


@query("t03_status", f"WITH {_E} SELECT job, status, due_at FROM s")
def t3(spark: SparkSession, folder: str) -> DataFrame:
    """The status of every job and when it is due."""
    return state(spark, folder).select("job", jobs.status(_now()).alias("status"), jobs.due_at().alias("due_at"))


_NAMES = ["network", "blocked", "parse", "timeout", "dns", "captcha", "layout", "odd"]
_ALIAS = f"CASE n {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items())} WHEN 'odd' THEN 'unknown' ELSE n END"


@query("t04_failures", f"""WITH f AS (SELECT user_id AS job, ({_NAMES})[event_id % 8 + 1] AS n, floor(epoch(ts))::BIGINT AS sec FROM events WHERE event_type = 'error')
SELECT job, {_ALIAS} AS category, count(*) AS failures, max(sec) AS last_at FROM f GROUP BY 1, 2""")  # fmt: skip
def t4(spark: SparkSession, folder: str) -> DataFrame:
    """Failures of every job by category; other names of a category are folded, unknown ones are one category."""
    rows = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type").where("event_type = 'error'")
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 8).cast("int"))
    folded = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), name), name)
    category = F.when(folded.isin(*CATEGORIES), folded).otherwise("unknown")
    return rows.groupBy(F.col("user_id").alias("job"), category.alias("category")).agg(F.count(F.lit(1)).alias("failures"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("last_at"))


@query("t05_deferrals", f"WITH {_E} SELECT job, deferrals, failures FROM s WHERE deferrals > 0")
def t5(spark: SparkSession, folder: str) -> DataFrame:
    """Deferrals of every job since its last finish, and its failures, which they leave as they are."""
    return jobs.fold(log(spark, folder)).where("deferrals > 0").select("job", "deferrals", "failures")


@query("t10_recovery", f"WITH {_E} SELECT job, due_at AS due, CASE WHEN finishes = 0 THEN 'first' ELSE 'refresh' END AS pass, now - due_at > {jobs.OVERDUE} AS overdue FROM s WHERE status = 'pending'")
def t10(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.recovery(state(spark, folder), _now())


@query("t12_scope", """WITH k AS (SELECT DISTINCT user_id AS job, event_type AS kind FROM events) SELECT job, kind, CASE WHEN kind = 'signup' THEN 'excluded' ELSE 'kept' END AS status FROM k
UNION ALL SELECT job, 'view', 'pending' FROM k WHERE kind = 'signup' AND job NOT IN (SELECT job FROM k WHERE kind = 'view')""")  # fmt: skip
def t12(spark: SparkSession, folder: str) -> DataFrame:
    """One kind of job retired in favour of another."""
    return jobs.migrate(table(spark, folder, "events", F.col("user_id").alias("job"), F.col("event_type").alias("kind")), "signup", "view")


@query("t14_log", f"WITH {_E} SELECT kind, count(*) AS n, min(sec) AS first_at, max(sec) AS last_at FROM e GROUP BY 1")
def t14(spark: SparkSession, folder: str) -> DataFrame:
    """The log written as an append-only sink in two batches, and read back by kind."""
    path, rows = files.scratch(spark, "log"), log(spark, folder)
    for batch in (rows.where("kind in ('failed', 'finished')"), rows.where("kind not in ('failed', 'finished')")):
        batch.write.partitionBy("kind").mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("q12_job_health", f"""WITH {_E}, f AS (SELECT job % 7 AS grp, count(DISTINCT job) AS bad FROM s WHERE failures > 0 GROUP BY 1)
SELECT s.job % 7 AS grp, count(*) FILTER (WHERE status = 'unresolved') AS quarantined, count(*) FILTER (WHERE status = 'pending' AND failures > 0) AS blocking, count(*) FILTER (WHERE failures >= 5) AS slow, count(*) FILTER (WHERE status = 'pending' AND now - due_at > {jobs.OVERDUE}) AS overdue, coalesce(any_value(bad), 0) >= 3 AS circuit_open
FROM s LEFT JOIN f ON s.job % 7 = f.grp GROUP BY 1""")  # fmt: skip
def q12(spark: SparkSession, folder: str) -> DataFrame:
    """Health by group: quarantined jobs apart from those that block, slow retries, overdue ones, and whether the circuit is open."""
    rows = state(spark, folder).withColumns({"grp": F.col("job") % 7, "status": jobs.status(_now()), "due": jobs.due_at()})
    pending = F.col("status") == "pending"
    measures = {"quarantined": F.col("status") == "unresolved", "blocking": pending & (F.col("failures") > 0), "slow": F.col("failures") >= 5, "overdue": pending & (_now() - F.col("due") > jobs.OVERDUE), "bad": F.col("failures") > 0}
    return events.progress(rows, ["grp"], measures).select("grp", "quarantined", "blocking", "slow", "overdue", (F.col("bad") >= 3).alias("circuit_open"))
