"""Changes of texts by hand."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import changes

OLD = "The motion for summary judgment is GRANTED. The hearing is on March 5, 2026.\nParties shall meet and confer about discovery."


@pytest.mark.parametrize(
    "new, kind, share",
    [
        (OLD, "none", 0.0), (OLD.upper().replace("\n", "\n\n  "), "formatting", 0.0), (OLD.replace("discovery", "discoverry"), "typo", 7 / 21), (OLD.replace("March 5", "March 6"), "substantive", 7 / 21),
        (OLD.replace("GRANTED", "DENIED"), "substantive", 7 / 21), (OLD.replace("GRANTED", "GRANTED in part"), "substantive", 9 / 23), (OLD + " Counsel shall give notice.", "substantive", 4 / 25), (OLD[: OLD.index("\n")], "substantive", 0.0),
        ("Parties shall meet and confer about discovery. " + OLD[: OLD.index("\n")], "substantive", 0.0), (None, "substantive", 0.0), ("", "substantive", 0.0),
    ],
)
def test_kinds(spark, new, kind, share):
    r = spark.createDataFrame([(OLD, new)], "a string, b string").select(changes.change(F.col("a"), F.col("b")).alias("c")).first().c
    assert r.kind == kind and r.share == pytest.approx(share)


def test_versions(spark):
    rows = [(1, "c", 1, "h1", "a b"), (2, "c", 2, "h1", "a b"), (3, "c", 3, "h2", "A  b!"), (4, "c", 4, "h3", "a b. New words here"), (5, "d", 1, "h9", None)]
    df = spark.createDataFrame(rows, "document_id int, source string, captured_at int, content_hash string, text string")
    got = {r.document_id: (r.version, r.previous_version_id, r.change, round(r.changed_share, 3)) for r in changes.version_changes(df, ["source"]).collect()}
    assert got == {1: (1, None, "first", 1.0), 3: (2, 1, "formatting", 0.0), 4: (3, 3, "substantive", 0.6), 5: (1, None, "first", 1.0)}


def test_weekday_anomalies(spark):
    import datetime

    from docketry.operators import analytics

    day = lambda n: datetime.date(2026, 1, 5) + datetime.timedelta(days=n)
    # ten on Mondays, none else; then a Monday without, a Tuesday with
    rows = [("s", day(n), 10 if n % 7 == 0 else 0) for n in range(28)] + [("s", day(28), 0), ("s", day(29), 5), ("s", day(30), 1)]
    got = {r.day: r.anomaly for r in analytics.weekday_anomalies(spark.createDataFrame(rows, "source string, day date, n int")).collect()}
    assert {d: a for d, a in got.items() if a} == {day(28): "drop", day(29): "spike"}
