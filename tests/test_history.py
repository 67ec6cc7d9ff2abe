from __future__ import annotations

import datetime as dt
import random
from itertools import groupby

from strataloom.operators import history


def brute(rows):
    out = []
    for key, items in groupby(sorted({r for r in rows if None not in r}, key=lambda r: (r[0], r[2], r[1])), key=lambda r: r[0]):
        runs = [list(g) for _, g in groupby(items, key=lambda r: r[1])]
        for run, following in zip(runs, [*runs[1:], None], strict=True):
            out.append((key, run[0][1], run[0][2], following[0][2] if following else None))
    return sorted(out, key=str)


def test_random_histories_equal_a_fold(spark):
    draw = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"w{draw.randrange(25)}", draw.choice(["a", "b", "c"]), start + dt.timedelta(hours=6 * draw.randrange(60))) for _ in range(900)]
    rows += rows[:50] + [(None, "a", start), ("w1", None, start), ("w1", "a", None)]
    frame = spark.createDataFrame(rows, "key string, state string, at timestamp")
    found = sorted(((r["key"], r["state"], r["valid_from"], r["valid_to"]) for r in history.versions(frame, "key", "state", "at").collect()), key=str)
    assert found == brute(rows)


def test_clashing_columns_and_empty(spark):
    frame = spark.createDataFrame([("x", "a", dt.datetime(2024, 1, 1), 1, 2, 3)], "k string, v string, t timestamp, p int, n int, o int")
    found = history.versions(frame, "k", "v", "t").collect()
    assert [(r["k"], r["v"], r["valid_to"]) for r in found] == [("x", "a", None)]
    assert history.versions(frame.limit(0), "k", "v", "t").count() == 0


def test_a_hot_key_is_spread_over_its_periods(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", "ab"[i % 2], start + dt.timedelta(minutes=i)) for i in range(4000)]
    assert history.versions(spark.createDataFrame(rows, "k string, s string, a timestamp"), "k", "s", "a").count() == 4000


def test_events_and_ends(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("w", "a", day), ("w", "a", day + dt.timedelta(days=3)), ("w", "b", day + dt.timedelta(days=9)), ("x", "a", day)]
    frame = spark.createDataFrame(rows, "k string, s string, a timestamp")
    events = history.differences(history.snapshots(frame, "k", "s", "a"))
    assert sorted((r.k, r.event, r.v) for r in events.collect()) == [("w", "changed", "b"), ("w", "deleted", None), ("w", "inserted", "a"), ("w", "unchanged", "a"), ("x", "deleted", None), ("x", "inserted", "a")]
    ends = spark.createDataFrame([("w", day + dt.timedelta(days=20)), ("nobody", day)], "k string, a timestamp")
    found = {(r.k, r.s): r.valid_to for r in history.versions(frame, "k", "s", "a", ends=ends).collect()}
    assert found == {("w", "a"): day + dt.timedelta(days=9), ("w", "b"): day + dt.timedelta(days=20), ("x", "a"): None}
