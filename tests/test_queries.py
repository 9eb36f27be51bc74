"""Every registered query with a SQL counterpart gives the SQL result."""

import pytest
from compare import differences

from tabloom.catalog import load

QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []


@pytest.mark.parametrize("name", ["decision_tree", "score_rows", "forecast_exog", "selection_report", "combined_time_choice"])
def test_rows_only_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
