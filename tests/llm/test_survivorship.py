from __future__ import annotations

import datetime as dt
import itertools
import random

from strataloom.llm import survivorship as S

KIND = "work string, obs string, at timestamp, pr int, title string, author string, author_id string, year string"
DAY = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(w, o, None if d is None else DAY + dt.timedelta(days=d), p, t, a, i, y) for w, o, d, p, t, a, i, y in rows], KIND)


def best(f):
    return {(r.group, r.field): r.value for r in S.survivors(f, "work", ["title", "author", "year"], "at", "obs", "pr", {"author": "author_id"}).collect()}


def test_trust_weighs_priority_recency_agreement_and_completeness(spark):
    rows = [
        ("late_low", "1", 1, 1, "A", None, None, None), ("late_low", "2", 2, 1, "A", None, None, None), ("late_low", "3", 3, 4, "B", None, None, None),
        ("early_high", "4", 1, 1, "A", None, None, None), ("early_high", "5", 2, 2, "B", None, None, None), ("early_high", "6", 3, 2, "B", None, None, None),
        ("newest", "7", 1, 1, "A", None, None, None), ("newest", "8", 2, 1, "B", None, None, None),
        ("cut", "9", 1, 4, "whole", None, None, None), ("cut", "10", 2, 1, "who…", None, None, None), ("cut", "11", 3, 1, "未知", None, None, None),
        ("none", "12", 1, 1, "暂无", None, None, None), ("undated", "13", None, 2, "A", None, None, None),
    ]
    found = best(frame(spark, rows + rows[:3]))
    assert {k[0]: v for k, v in found.items()} == {"late_low": "A", "early_high": "B", "newest": "B", "cut": "whole", "none": "暂无", "undated": "A"}


def test_functional_dependency_across_groups(spark):
    rows = [(f"w{i}", f"o{i}", 1, 1, None, "right", "id7", None) for i in range(4)] + [("x", "a", 1, 1, None, "right", "id7", None), ("x", "b", 2, 1, None, "wrong", "id7", None)]
    assert best(frame(spark, rows))["x", "author"] == "right"


def total(bundles, joint, pick):
    return sum(b[i] for b, i in zip(bundles, pick, strict=True)) + sum(w for (a, i, b, j), w in joint.items() if pick[a] == i and pick[b] == j)


def test_search_equals_exhaustive_and_differs_from_each_bundle_alone():
    draw, apart = random.Random(5), 0
    for _ in range(300):
        bundles = [sorted((draw.random() for _ in range(draw.randrange(1, 5))), reverse=True) for _ in range(draw.randrange(1, 5))]
        joint = {(a, i, b, j): 0.4 * draw.random() for a in range(len(bundles)) for b in range(a + 1, len(bundles)) for i in range(len(bundles[a])) for j in range(len(bundles[b])) if draw.random() < 0.6}
        want = max(total(bundles, joint, pick) for pick in itertools.product(*[range(len(b)) for b in bundles]))
        got = S.search(bundles, joint)
        assert abs(total(bundles, joint, got) - want) < 1e-9
        apart += any(got)
    assert apart > 50
    assert S.search([], {}) == []
    assert S.search([[1.0, 1.0], [1.0, 1.0]], {}) == [0, 0]


def test_values_observed_together_survive_together(spark):
    """Alone, title A (0.46 of 0.4 + 0.16 ...) and B are close; B was seen with the author that wins, so B survives."""
    rows = [
        ("w", "1", 4, 2, "A", None, None, None), ("w", "2", 3, 1, "B", "x", None, "2001"), ("w", "3", 2, 1, "B", "x", None, "2001"),
    ]
    found = best(frame(spark, rows))
    weights = {"A": 0.6, "B": 0.4 + 0.16}
    assert weights["A"] > weights["B"] and found == {("w", "title"): "B", ("w", "author"): "x", ("w", "year"): "2001"}


def test_a_value_with_several_determinants(spark):
    rows = [(f"w{i}", f"o{i}", 1, 1, None, "right", "id7", None) for i in range(4)] + [("x", "a", 1, 3, None, "right", "id7", None), ("x", "c", 1, 3, None, "right", "id0", None), ("x", "b", 2, 1, None, "wrong", "id7", None)]
    assert best(frame(spark, rows))["x", "author"] == "right"


def test_newest_trusted(spark):
    rows = [
        ("fit", "1", 1, 2, "A", "x", None, None), ("fit", "2", 2, 1, "A", "x", None, None), ("fit", "2", 2, 1, "A", "x", None, None),
        ("worse", "3", 1, 1, "A", "x", None, None), ("worse", "4", 2, 2, "A", "x", None, None),
        ("placeholder", "5", 1, 1, "A", "x", None, None), ("placeholder", "6", 2, 1, "A", "佚名", None, None),
        ("single", "7", 1, 1, "A", "x", None, None), ("single", "8", None, 1, "A", "x", None, None), (None, "9", 1, 1, "A", "x", None, None),
    ]
    f = frame(spark, rows)
    found = S.newest_trusted(f, "work", "at", "obs", "pr", ["title", "author"])
    assert [tuple(r) for r in found.collect()] == [("fit", "2")]
    assert S.newest_trusted(f.limit(0), "work", "at", "obs", "pr", ["title"]).count() == 0
    assert best(f.limit(0)) == {}


def test_ranks_of_a_hot_group(spark):
    rows = [("hot", f"o{i:04d}", i if i % 7 else None, 1, "old" if i < 990 else "new", None, None, None) for i in range(1000)]
    f = frame(spark, rows)
    ranks = {r.obs: r._rank for r in S.ranked(f, "work", "at", "obs").collect()}
    assert sorted(ranks.values()) == list(range(1000))
    assert ranks["o0999"] == 0 and ranks["o0998"] == 1 and max(ranks[f"o{i:04d}"] for i in range(1000) if i % 7) < min(ranks[f"o{i:04d}"] for i in range(1000) if not i % 7)
    assert best(f)["hot", "title"] == "new"


def test_old_values_count_where_no_newer_is_real(spark):
    rows = [("w", f"p{i:04d}", 5000 - i, 1, "未知", None, None, None) for i in range(1200)] + [("w", "x", 3, 1, "newer", None, None, None), ("w", "y", 2, 1, "older", None, None, None), ("w", "z", 1, 1, "older", None, None, None)]
    assert best(frame(spark, rows))["w", "title"] == "newer"
