"""What the driver calls."""

import __spark_entry__ as entry


def test_names(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and all(callable(f) for f in names.values())
    assert entry.entry(spark).columns == ["judge_id", "motion_type", "total", "granted", "denied", "granted_in_part", "other", "grant_rate"]
