"""Rules as data, quarantine, and promotions that die, return and repeat."""

import datetime

import pytest
from pyspark.sql import functions as F

from docketry.operators import staging
from docketry.operators.staging import Check, Staging

SCHEMA = "id string, scraper_id string, ruling_text string, judge_name string, hearing_date date, captured_at timestamp"
AT = datetime.datetime(2026, 3, 4, 8)
GOOD = "The motion for summary judgment is GRANTED."


def rows(spark, *captures):
    made = [(i, s, t, j, d and datetime.date.fromisoformat(d), AT) for i, s, t, j, d in captures]
    return spark.createDataFrame(made, SCHEMA)


def test_rules(spark):
    rules = [*staging.GENERIC, Check("known_source", "scraper_id", "one_of", ("a", "b"), "flag"), Check("la_case", "judge_name", "matches", ("^Lee",), "fail", "b"), Check("volume", "captured_at", "daily_count", (2, 4), "flag")]
    got = staging.validate(
        rows(
            spark, ("1", "a", GOOD, "Ann Lee", "2026-03-05"), ("2", "a", None, None, None), ("3", "a", "<p>The motion is GRANTED today</p>", "Ann Lee", "2026-03-05"), ("4", "a", "short", "x1", "1890-01-01"),
            ("5", "b", GOOD, "Bo Day", "2026-03-05"), ("6", "b", GOOD, "Lee, Bo", "2026-03-05"), ("7", "c", GOOD + " â€œ", "Ann Lee", "2026-03-05"), ("8", None, "  ", "Ann Lee", "2026-03-05"),
        ),
        rules,
    )
    assert {r.id: (r.validation_status, [n.rule for n in r.validation_notes]) for r in got.collect()} == {
        "1": ("passed", []), "2": ("failed", ["has_text"]), "3": ("failed", ["no_markup"]), "4": ("failed", ["text_length", "judge_is_a_name", "date_is_plausible"]), "5": ("failed", ["la_case"]),
        "6": ("passed", []), "7": ("flagged", ["no_garbling", "known_source", "volume"]), "8": ("failed", ["has_text", "text_length", "volume"]),
    }
    counts = {r.rule: r.broken for r in staging.rule_counts(got, rules).collect()}
    assert counts == {"has_text": 2, "text_length": 2, "no_markup": 1, "no_garbling": 1, "judge_is_a_name": 1, "date_is_plausible": 1, "known_source": 1, "la_case": 1, "volume": 2}
    assert staging.validate(rows(spark), rules).collect() == []
    with pytest.raises(ValueError):
        staging.validate(got, [Check("x", "id", "no such kind")])


def ids(df):
    return sorted(r.id for r in df.collect())


def decisions(spark, *made):
    return spark.createDataFrame([(*d, "human:a") for d in made], "id string, staged_batch long, decision string, reviewer string")


def test_promotion(spark, tmp_path):
    store, rules = Staging(spark, str(tmp_path / "s"), SCHEMA), list(staging.GENERIC)
    store.stage(rows(spark, ("ok", "a", GOOD, "Ann Lee", "2026-03-05"), ("manual", "b", GOOD, "Ann Lee", "2026-03-05"), ("odd", "a", GOOD, "J1", "2026-03-05"), ("bad", "a", "<b>x</b>", "Ann Lee", "2026-03-05")), 0, rules)
    assert ids(store.promoted()) == [] and ids(store.quarantine()) == ["bad", "odd"]
    # what dies between the two phases isn't there, and the next try does it all
    put = store._put
    store._put = lambda df, name, part, n: (_ for _ in ()).throw(OSError("gone")) if name == "promotions" else put(df, name, part, n)
    with pytest.raises(OSError):
        store.promote(0, ["a"])
    store._put = put
    assert ids(store.promoted()) == []
    assert store.promote(0, ["a"]) and ids(store.promoted()) == ["ok"]
    assert not store.promote(0, ["a", "b"]) and ids(store.promoted()) == ["ok"]
    # approvals: of flagged captures and of sources that can't promote by themselves, never of failed ones
    store.review(decisions(spark, ("odd", 0, "approve"), ("manual", 0, "approve"), ("bad", 0, "approve")), 0)
    assert store.promote(1, ["a"]) and ids(store.promoted()) == ["manual", "odd", "ok"] and ids(store.quarantine()) == ["bad"]
    # a corrected capture comes back; one that was promoted stays as it was; a batch staged twice counts once
    for _ in range(2):
        store.stage(rows(spark, ("bad", "a", GOOD, "Ann Lee", "2026-03-05"), ("ok", "a", GOOD + " Again.", "Ann Lee", "2026-03-05"), ("no", "a", GOOD, "J2", "2026-03-05")), 1, rules)
    store.review(decisions(spark, ("no", 1, "reject")), 1)
    assert store.promote(2, ["a"]) and ids(store.promoted()) == ["bad", "manual", "odd", "ok"]
    got = {r.id: r for r in store.promoted().collect()}
    assert got["ok"].ruling_text == GOOD and got["bad"].ruling_text == GOOD and (got["bad"].staged_batch, got["bad"].promotion) == (1, 2)
    assert ids(store.quarantine()) == ["no"] and len({r.promoted_document_id for r in got.values()}) == 4
    # a rejected version that passed isn't promoted, and a later decision takes the place of an earlier
    store.stage(rows(spark, ("p", "a", GOOD, "Ann Lee", "2026-03-05"), ("q", "b", GOOD, "Ann Lee", "2026-03-05")), 2, rules)
    store.review(decisions(spark, ("p", 2, "reject"), ("q", 2, "reject")), 2)
    store.review(decisions(spark, ("q", 2, "approve")), 3)
    assert store.promote(3, ["a"]) and ids(store.promoted()) == ["bad", "manual", "odd", "ok", "q"]
    assert store.promote(4, ["a", "b"]) and store.promoted().where(F.col("promotion") == 4).count() == 0
