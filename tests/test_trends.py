"""Trends of grant rates, attorneys and firms, by hand."""

import datetime

from docketry.operators import analytics

DAY = datetime.date


def test_spans_follow_the_calendar(spark):
    rows = [("a", DAY(2024, 1, 5), "granted"), ("a", DAY(2024, 3, 31), "denied"), ("a", DAY(2024, 12, 31), "granted"), ("a", DAY(2025, 1, 1), "granted")]
    rows += [("a", DAY(2025, 2, 1), None), ("a", DAY(2025, 2, 2), "moot"), ("a", None, "granted"), ("b", DAY(2025, 1, 1), "moot"), (None, DAY(2025, 1, 1), "denied_in_part")]
    df = spark.createDataFrame(rows, "judge_id string, hearing_date date, outcome string")
    got = {(r.judge_id, str(r.period)): r for r in analytics.rate_trends(df, "judge_id", least=3).collect()}
    assert set(got) == {("a", "2024-01-01"), ("a", "2024-10-01"), ("a", "2025-01-01"), ("b", "2025-01-01"), (None, "2025-01-01")}
    take = lambda k: (got[k].rulings, got[k].decided, got[k].span_decided, got[k].span_rate, got[k].change, got[k].provisional)
    # the year up to 2024's last quarter holds three decided; the next one no longer holds the first quarter
    assert take(("a", "2024-10-01")) == (1, 1, 3, 2 / 3, None, False)
    assert take(("a", "2025-01-01")) == (3, 1, 2, 1.0, 0.5, True)
    assert take(("b", "2025-01-01")) == (1, 0, 0, None, None, True)
    assert take((None, "2025-01-01")) == (1, 1, 1, 0.0, None, True)
    assert analytics.rate_trends(df.limit(0), "judge_id").count() == 0


def test_a_case_counts_once_for_a_firm(spark):
    seen = [(1, "F", "x"), (1, "F", "y"), (1, "F", "x"), (2, "F", "x"), (2, None, "z"), (3, "G", "w"), (None, "G", "w"), (1, "G", None)]
    rulings = [(1, "granted"), (1, "denied"), (2, "denied_in_part"), (2, "moot"), (9, "granted")]
    appearances = spark.createDataFrame(seen, "case_id int, firm string, counsel string")
    got = {(r.firm, r.counsel): (r.cases, r.rulings, r.granted, r.grant_rate) for r in analytics.counsel_stats(appearances, spark.createDataFrame(rulings, "case_id int, outcome string")).collect()}
    assert got == {
        ("F", "x"): (2, 4, 1, 1 / 3), ("F", "y"): (1, 2, 1, 0.5), (None, "z"): (1, 2, 0, 0.0), ("G", "w"): (1, 0, 0, 0.0),
        ("F", None): (2, 4, 1, 1 / 3), (None, None): (1, 2, 0, 0.0), ("G", None): (1, 0, 0, 0.0),
    }
