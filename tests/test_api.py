"""Public queries over a small store."""

import datetime

import pytest
from pyspark.sql import functions as F

from docketry.operators import search
from docketry.plans.api import Store

DAY = datetime.date


@pytest.fixture(scope="module")
def store(spark):
    make = spark.createDataFrame
    rulings = make(
        [("r1", "d1", "c1", "j1", "k1", DAY(2026, 3, 2), "granted", "msj", "Summary judgment is granted."), ("r2", "d2", "c1", "j1", "k1", DAY(2026, 3, 1), "denied", "mtd", "Denied."), ("r3", "d3", "c1", "j1", "k1", DAY(2099, 12, 31), "granted", "msj", "Later.")],
        "id string, document_id string, case_id string, judge_id string, court_id string, hearing_date date, outcome string, motion_type string, ruling_text string",
    )
    indexed = rulings.select("document_id", "hearing_date", "ruling_text", F.lit("24NNCV02551").alias("case_number"), F.lit("Los Angeles").alias("county"))
    return Store(
        make([("k1", "CA", "Los Angeles")], "id string, state string, county string"), make([("j1", "Crowfoot, William A.", "k1"), ("j2", "Adams", "k1")], "id string, canonical_name string, court_id string"),
        make([("c1", "24NNCV02551", "civil", "active", DAY(2024, 1, 15), "k1")], "id string, case_number string, case_type string, case_status string, created_at date, court_id string"),
        rulings, make([], "case_id string, judge_id string"), index=search.build_index(indexed),
    )


def test_lists(store):
    ids = lambda **k: [r.id for r in store.ruling_list(today="2026-06-01", **k).fetch()["rows"]]
    assert ids() == ["r1", "r2"] and ids(include_future=True) == ["r3", "r1", "r2"] and ids(outcome="denied") == ["r2"]
    assert ids(county="Los Angeles") == ["r1", "r2"] and ids(county="Kern") == [] and ids(county="") == ["r1", "r2"]
    assert ids(case_number="24NNCV02551", date_from="2026-03-02") == ["r1"] and ids(judge_id="j2") == []
    first = store.ruling_list(today="2026-06-01", first=1).fetch()
    assert first["has_next"] and ids(after=first["end"]) == ["r2"]
    assert [r.id for r in store.judge_list(court_id="k1").fetch()["rows"]] == ["j2", "j1"]
    assert [r.id for r in store.case_list(case_status="active", case_type="").fetch()["rows"]] == ["c1"]


def test_records(store):
    case = store.case("c1").first()
    assert case.court.county == "Los Angeles" and [j.id for j in case.judges] == ["j1"] and store.case("x").count() == 0
    assert store.judge("j1").first().canonical_name.startswith("Crowfoot") and store.ruling("r2").first().outcome == "denied"
    assert store.judge_analytics("j1").first().total_rulings == 3 and store.judge_analytics("j2").first().total_rulings == 0
    assert store.judge_analytics("nobody").count() == 0 and store.health() == "ok"


def test_search(store):
    page, matches = store.search_rulings("summary judgments", county="Los Angeles", today="2026-06-01")
    rows = page.fetch()["rows"]
    assert [r.ruling_id for r in rows] == ["r1"] and "<mark>" in rows[0].excerpt and matches.count() == 1
