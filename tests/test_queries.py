import pytest

from tidelog.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, same_as_oracle):
    assert name in ORACLE
    same_as_oracle(QUERIES[name], ORACLE[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_key_filter_reaches_the_scan_and_value_filter_does_not(spark, sf_dir):
    from tidelog.plans.view import visible
    from tidelog.queries import USER, event_log

    view = visible(event_log(spark, sf_dir), USER)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(user_id,20)" in plan(view.where("user_id > 20"))
    assert "EqualTo(event_type,click)" not in plan(view.where("event_type = 'click'"))
