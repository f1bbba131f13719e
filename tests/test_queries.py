"""Every query that has SQL gives the rows of its SQL."""

import pytest
from conftest import by_sql, same

from gavel.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), by_sql(sf_dir, ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 500
    assert set(e.oracle_sql()) <= set(e.queries())


def test_prompts_are_read_without_shuffle(spark, sf_dir):
    plan = QUERIES["render_prompt"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "struct<doc_id:bigint,text:string>" in plan
