"""Merge policies against sequential folds over random logs, and the golden cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strataloom.functions import dates
from strataloom.operators import merge as M

KIND = "key string, seq long, ts long, pr int, a string, b string"


def randomlog(seed, n=400, keys=12):
    draw = random.Random(seed)
    return [(f"k{draw.randrange(keys)}", i, draw.randrange(8), draw.randrange(3), draw.choice([None, "", "x", "y", "z"]), draw.choice([None, "p", "q"])) for i in range(n)]


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_newest_wins_and_conflicts(spark, seed):
    rows = randomlog(seed)
    frame = spark.createDataFrame(rows, KIND)
    current, conflicts = {}, []
    for key, items in by_key(rows).items():
        best = None
        for _, seq, ts, _, a, _ in items:
            if not (a or "").strip():
                continue
            if best is None or ts > best[0]:
                best = (ts, a)
            elif ts == best[0] and a != best[1]:
                conflicts.append((key, seq, best[1], a))
        current[key] = best[1] if best else None
    assert {r.key: r.a for r in M.newest_wins(frame, ["key"], "seq", "ts", ["a"]).collect()} == current
    assert sorted(tuple(r) for r in M.newest_wins_conflicts(frame, ["key"], "seq", "ts", "a").collect()) == sorted(conflicts)


@pytest.mark.parametrize("seed", range(3))
def test_priority_row_and_first_wins(spark, seed):
    rows = randomlog(seed)
    frame = spark.createDataFrame(rows, KIND)
    winner, first, conflicts = {}, {}, []
    for key, items in by_key(rows).items():
        best = a = None
        for _, seq, _, pr, x, y in items:
            if best is None or pr >= best[0]:
                best, a = (pr, y), x
            if not (a or "").strip() and (x or "").strip():
                a = x
            if (x or "").strip():
                if first.get(key) is None:
                    first[key] = x
                elif first[key] != x:
                    conflicts.append((key, seq, "a", first[key], x))
        first.setdefault(key, None)
        winner[key] = (a, best[1])
    found = {r.key: (r.a, r.b) for r in M.priority_row(frame, ["key"], "seq", "pr", ["a", "b"], ["a"]).collect()}
    assert {k: ((a or None), b) for k, (a, b) in found.items()} == {k: ((a or None), b) for k, (a, b) in winner.items()}
    assert {r.key: r.a for r in M.first_wins(frame, ["key"], "seq", ["a"]).collect()} == first
    assert sorted(tuple(r) for r in M.first_wins_conflicts(frame, ["key"], "seq", ["a"]).collect()) == sorted(conflicts)


def test_out_of_order_observation_fills_gaps_only(spark):
    frame = spark.createDataFrame([("w", 1, 20, 0, "current", None), ("w", 2, 10, 0, "old", "author")], KIND)
    row = M.newest_wins(frame, ["key"], "seq", "ts", ["a", "b"]).first()
    assert (row.a, row.b) == ("current", "author")


def test_sticky_spelling(spark):
    rows = [("w", 1, 1, 0, "2013-09-21T13:36:56+08:00", None), ("w", 2, 2, 0, "2013-09-21 13:36:56", None), ("w", 3, 3, 0, "2013-09-21T05:36:56Z", None), ("v", 1, 1, 0, "2000", None), ("v", 2, 2, 0, "2001", None)]
    frame = spark.createDataFrame(rows, KIND)
    found = {r.key: (r.a, r.last_ts) for r in M.sticky_newest(frame, ["key"], "seq", "ts", "a", dates.same_moment_key(F.col("a"))).collect()}
    assert found == {"w": ("2013-09-21T13:36:56+08:00", 3), "v": ("2001", 2)}


def test_equal_time_conflict_keeps_the_first(spark):
    frame = spark.createDataFrame([("w", 1, 5, 0, "kept", None), ("w", 2, 5, 0, "conflicting", None)], KIND)
    assert M.newest_wins(frame, ["key"], "seq", "ts", ["a"]).first().a == "kept"
    assert [tuple(r) for r in M.newest_wins_conflicts(frame, ["key"], "seq", "ts", "a").collect()] == [("w", 2, "kept", "conflicting")]


def test_replay_is_idempotent_and_finds_contradictions(spark):
    known = spark.createDataFrame([("1", "a"), ("2", None)], "id string, v string")
    incoming = spark.createDataFrame([("1", "a"), ("2", "x"), ("3", "c"), ("3", "c")], "id string, v string")
    added, contradicting = M.replay(known, incoming, "id", ["v"])
    assert [r.id for r in added.collect()] == ["3"] and [r.id for r in contradicting.collect()] == ["2"]
    assert M.replay(known, known, "id", ["v"])[0].count() == 0


def test_ignore_replace_and_empty(spark):
    frame = spark.createDataFrame(randomlog(9), KIND)
    assert M.insert_or_ignore(frame, ["key"], "seq").count() == M.insert_or_replace(frame, ["key"], "seq").count() == 12
    empty = frame.limit(0)
    assert M.newest_wins(empty, ["key"], "seq", "ts", ["a"]).count() == M.priority_row(empty, ["key"], "seq", "pr", ["a"], ["a"]).count() == 0
