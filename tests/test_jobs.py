from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataloom.operators import jobs
from strataloom.sources import pages

KIND = "job string, `order` long, at long, kind string, coverage double, delay double"


def by_hand(rows, now):
    """The state of every job, event by event."""
    out = {}
    for job, _, at, kind, coverage, delay in sorted(set(rows), key=lambda r: r[1]):
        s = out.setdefault(job, {"failures": 0, "deferrals": 0, "finishes": 0})
        if kind == "finished":
            s.update(failures=0, deferrals=0, finishes=s["finishes"] + 1)
        s["failures"] += kind == "failed"
        s["deferrals"] += kind == "deferred"
        wait = 30.0 * 2 ** min(s["failures"] - 1, 12)
        wait = max(3600.0, min(wait, 86400.0)) if s["failures"] >= 5 else wait
        due = {"failed": at + (delay if delay is not None else wait), "deferred": at + (delay or 0), "claimed": at + jobs.LEASE}.get(kind, at)
        if kind == "finished":
            status = "done" if coverage >= 1 else "pending" if coverage > 0 else "unresolved"
        else:
            status = "leased" if kind == "claimed" and at + jobs.LEASE > now else "pending"
        s.update(status=status, due=float(due))
    return out


def test_fold_equals_the_log_event_by_event(spark):
    draw = random.Random(9)
    rows = [(f"j{draw.randrange(20)}", i, 1000 + 40 * i, draw.choice(["enqueued", "claimed", "finished", "failed", "failed", "deferred"]), draw.choice([0.0, 0.5, 1.0]), draw.choice([None, None, 90.0])) for i in range(400)]
    now = 1000 + 40 * 400
    state = jobs.fold(spark.createDataFrame(rows + rows[:30], KIND))
    got = {r.job: {"failures": r.failures, "deferrals": r.deferrals, "finishes": r.finishes, "status": r.s, "due": r.d} for r in state.withColumns({"s": jobs.status(F.lit(now)), "d": jobs.due_at()}).collect()}
    assert got == by_hand(rows, now)
    assert jobs.fold(spark.createDataFrame([], KIND)).count() == 0


def test_claims_leases_and_recovery(spark):
    rows = [("fresh", 1, 100, "enqueued", None, None), ("leased", 2, 990, "claimed", None, None), ("expired", 3, 10, "claimed", None, None), ("blocked", 4, 50, "enqueued", None, None), ("later", 5, 995, "deferred", None, 60.0), ("done", 6, 20, "finished", 1.0, None), ("none", 7, 0, "enqueued", None, None)]
    state = jobs.fold(spark.createDataFrame(rows, KIND)).withColumn("grp", F.when(F.col("job") == "blocked", "b").otherwise("a"))
    now = F.lit(1000)
    claimed = jobs.claimable(state, spark.createDataFrame([("b",)], "grp string"), "grp", now, 2).collect()
    assert [r.job for r in claimed] == ["none", "fresh"]
    assert {r.job for r in jobs.claimable(state, spark.createDataFrame([], "grp string"), "grp", now, 9).collect()} == {"none", "fresh", "expired", "blocked"}
    found = {r.job: (r["due"], r["pass"], r.overdue) for r in jobs.recovery(state, F.lit(90_000)).collect()}
    assert found["none"] == (0.0, "first", True) and found["fresh"] == (100.0, "first", True) and "done" not in found


def test_migration_is_idempotent(spark):
    first = jobs.migrate(spark.createDataFrame([("a", "old"), ("b", "old"), ("b", "new"), ("c", "other"), ("c", "other")], "job string, kind string"), "old", "new")
    assert {tuple(r) for r in first.collect()} == {("a", "old", "excluded"), ("b", "old", "excluded"), ("b", "new", "kept"), ("c", "other", "kept"), ("a", "new", "pending")}
    again = jobs.migrate(first.select("job", "kind"), "old", "new")
    assert again.where("status = 'pending'").count() == 0 and again.count() == first.count()


def test_page_parsers():
    catalog = '<table><tr><td>1</td></tr><tr>' + "".join(f"<td>{c}</td>" for c in "ABCDEFG") + '</tr></table>共3页 当前为第3页<a href="/p/2">上一页</a>'
    assert pages.catalog_page(catalog) == [dict(zip(pages.CATALOG, "ABCDEFG", strict=True)) | {"page": 3, "pages": 3, "next": None, "years": ""}]
    cards = '<h1>T</h1><li>作者: X</li><a class="x chapter" data-number="4" title="2020-02-02">Four</a>'
    assert pages.detail_page(cards) == [{"title": "T", "author": "X", "status": None, "genre": None, "number": "4", "chapter": "Four", "date": "2020-02-02"}]
    assert pages.detail_page("<p>nothing</p>") == [] and pages.rank_page("") == [] and pages.issue_page("") == []
    two = '<script type="application/ld+json">{"@type": "Book", "@id": "1", "name": "a"}</script><script type="application/ld+json">{"@type": "Book", "@id": "1", "name": "b"}</script>'
    assert pages.asked_object(two, ("Book",), "1") == []
    assert [o["name"] for o in pages.asked_object(two.split("</script>")[0] + "</script>", ("Book",), "1")] == ["a"] and pages.asked_object(two, ("Book",), "2") == []
