"""Every registered query of the event engine against its SQL."""

import pytest

from sluiceway.plans import catalog, programs  # noqa: F401

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, same, name):
    found = catalog.QUERIES[name](spark, SMALL).toPandas()
    if name in catalog.ORACLES:
        same(found, duck.execute(catalog.ORACLES[name]).df())
    else:
        assert len(found) > 0


def test_fn_math_equals_its_sql_on_odd_values(spark, duck, tmp_path):
    values = ["NULL", "0.0", "-0.0", "-0.01", "-2.5", "1e-320", "0.5", "1.0", "2.5", "49.99", "50.0", "1e15", "4515.94"]
    rows = ", ".join(f"({k}, TIMESTAMP '2024-01-01', {'NULL' if v == 'NULL' else k - 8}, 'view', {v}::DOUBLE, '')" for k, v in enumerate(values))
    duck.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    want = duck.execute(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet') {catalog.ORACLES['fn_math']}").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["fn_math"](spark, str(tmp_path)).collect()]
    cells = lambda rows: sorted((tuple("nan" if v != v else v for v in r) for r in rows), key=lambda r: r[0])
    assert cells(got) == cells(want)
    assert {r[6] for r in got if r[0] in (1, 2)} == {float("-inf")}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_emit"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,50.0)]" in plan
    assert "props" not in plan


def test_a_chain_of_steps_costs_one_shuffle(spark):
    plan = catalog.QUERIES["seq3"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
