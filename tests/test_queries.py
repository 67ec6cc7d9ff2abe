"""Every core query against its SQL on the smallest tables; those without SQL must run and give stable columns."""

from __future__ import annotations

import oracle
import pytest

from strataloom.plans import completing, evidence, further, jobs, joining, problems, shaping

MODULES = (problems, evidence, joining, shaping, further, jobs, completing)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, small, name):
    assert oracle.compare(spark, QUERIES[name], ORACLES[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, small, name):
    frame = QUERIES[name](spark, small)
    assert frame.count() > 0
    assert len(set(frame.columns)) == len(frame.columns)


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_read_only_what_they_need(spark, small):
    plan = evidence.m5_newest_wins(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "raw_record_json" not in plan
    plan = joining.j1(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_packed_values_stand_in_their_fields(spark, small):
    """Every value of p2_found is in its text, in order; lists in JSON notation come out whole."""
    import json

    from strataloom.plans.problems import PACKED
    from strataloom.sources.tables import table

    texts = {(n, r[0], f): r[1] for n, k, f in PACKED for r in table(spark, small, n, k, f).collect()}
    found: dict = {}
    for r in problems.p2_found(spark, small).collect():
        found.setdefault((r.table_name, r.record_key, r.field_name), []).append((r.item_no, r.item_value))
    lists = 0
    for key, items in found.items():
        assert [n for n, _ in sorted(items)] == list(range(1, len(items) + 1)) and len(items) >= 2
        values, at = [v for _, v in sorted(items)], 0
        try:
            given = json.loads(texts[key])
        except ValueError:
            for v in values:
                at = texts[key].replace('""', '"').replace('\\"', '"').find(v, at)
                assert at >= 0, (texts[key], values)
        else:
            lists += 1
            assert values == [str(v).strip() for v in given if v is not None and str(v).strip()]
    assert lists > 0
