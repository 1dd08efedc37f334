import pytest

import __spark_entry__ as entry
from duck import same
from lumenframe.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    same(entry.queries()[name](spark, data), ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_heavy_column_is_pruned_and_filter_pushed(spark, data):
    plan = entry.queries()["viable_clips"](spark, data)._jdf.queryExecution().toString()
    assert "text" not in plan.split("ReadSchema")[-1]
