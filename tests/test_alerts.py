"""Alerts against every subscription held against every ruling; events and digests once."""

import datetime
import json
import random
import re

from pyspark.sql import functions as F

from docketry.functions.stem import STOP_WORDS
from docketry.operators import alerts

AT = datetime.datetime(2026, 3, 4, 8)
RULING = "document_id string, case_id string, judge_id string, court_id string, county string, outcome string, motion_type string, party_ids array<string>, ruling_text string, captured_at timestamp"
SUBSCRIPTION = "id string, user_id string, alert_type string, filters string, is_active boolean"
WORDS = "motion fraud demurrer order lease tenant the of".split()


def fits(kind, f, r):
    words = [w for w in re.findall(r"\w+", f.get("keyword", "").lower()) if w not in STOP_WORDS]
    if not f.get(alerts.KINDS.get(kind, "no"), "") or ("keyword" in f and not words):
        return False
    fields = dict(zip(("document_id", "case_id", "judge_id", "court_id", "county", "outcome", "motion_type"), r))
    text = re.findall(r"\w+", (r[8] or "").lower())
    return all(fields.get(n) == v for n, v in f.items() if n in fields) and all(w in text for w in words) and f.get("party_id") in (None, *(r[7] or []))


def test_all_kinds_against_brute_force(spark):
    rng = random.Random(2)
    rulings = [
        (f"d{k}", f"c{rng.randrange(9)}", rng.choice([None, "j1", "j2"]), f"k{rng.randrange(3)}", rng.choice(["Kern", "Kings"]), rng.choice([None, "granted", "denied"]), "msj", rng.choice([None, [], ["p1"], ["p1", "p2"]]), rng.choice([None, " ".join(rng.choices(WORDS, k=5))]), AT)
        for k in range(60)
    ]
    subs = []
    for k in range(80):
        kind = rng.choice([*alerts.KINDS, "unknown"])
        f = {"case_docket": {"case_id": f"c{rng.randrange(9)}"}, "judge_ruling": {"judge_id": rng.choice(["j1", "j2"])}, "keyword": {"keyword": " ".join(rng.choices(WORDS, k=2))}, "party_attorney": {"party_id": rng.choice(["p1", "p2", "p3"])}}.get(kind, {"case_id": "c1"})
        f |= rng.choice([{}, {}, {"outcome": "granted"}, {"county": "Kern"}, {"keyword": "motion"}, {"party_id": "p1"}])
        subs.append((f"s{k}", f"u{k % 7}", kind, json.dumps(f), rng.random() < 0.9))
    subs += [("bad1", "u", "keyword", "not json", True), ("bad2", "u", "judge_ruling", "{}", True), ("bad3", "u", "keyword", '{"keyword": "the of"}', True), ("bad4", "u", "case_docket", None, True)]
    usable = alerts.subscriptions(spark.createDataFrame(subs, SUBSCRIPTION))
    table = spark.createDataFrame(rulings, RULING)
    want = {(s, r[0]) for s, _, kind, f, active in subs if active and f and f.startswith("{") for r in rulings if kind in alerts.KINDS and fits(kind, json.loads(f), r)}
    assert len(want) > 50 and {kind for s, _, kind, *_ in subs if any(s == x for x, _ in want)} == set(alerts.KINDS)
    for frequencies in (None, spark.createDataFrame([("motion", 30), ("fraud", 2)], "term string, df long")):
        got = alerts.triggered(table, alerts.waiting(usable, frequencies)).collect()
        assert len(got) == len(want) and {(r.subscription_id, r.document_id) for r in got} == want
    # a keyword waits at its rarest word
    waits = alerts.waiting(alerts.subscriptions(spark.createDataFrame([("x", "u", "keyword", '{"keyword": "motion fraud"}', True)], SUBSCRIPTION)), spark.createDataFrame([("motion", 1), ("fraud", 2)], "term string, df long"))
    assert waits.first().key == "word:motion"
    assert alerts.triggered(table.limit(0), alerts.waiting(usable)).collect() == []


def test_events_and_digests_come_once(spark, tmp_path):
    log = alerts.AlertLog(spark, str(tmp_path / "a"))
    made = lambda *ids: spark.createDataFrame([(f"e{i}", f"s{i % 2}", "u", "keyword", f"d{i}", AT) for i in ids], alerts._EVENT)
    sent = lambda run: sorted(r.event_id for r in log.digest(run).collect())
    assert sent(0) == []
    log.record(made(1, 2), 0)
    log.record(made(1, 2), 0)
    assert sent(1) == ["e1", "e2"] and sent(1) == ["e1", "e2"]
    log.record(made(2, 3), 1)  # a ruling that was captured once more
    assert sorted((r.event_id, r.batch) for r in log.events().collect()) == [("e1", 0), ("e2", 0), ("e3", 1)]
    assert sent(2) == ["e3"] and sent(1) == ["e1", "e2"] and sent(3) == []
    # a run that died before its manifest row is done again
    log.record(made(4), 2)
    made(9).select("user_id", "subscription_id", "event_id", "document_id").write.parquet(str(tmp_path / "a/digests/run=4"))
    assert sent(4) == ["e4"]


def test_a_common_word_meets_by_all_fields(spark):
    """Many wait at one word that all rulings have, each in its own county: pairs don't grow with both."""
    rulings = [(f"d{k}", f"c{k}", None, "k", f"county {k % 40}", "granted", "msj", None, "motion of the kind " + ("promo" if k % 3 else "large"), AT) for k in range(400)]
    subs = [(f"s{k}", "u", "keyword", json.dumps({"keyword": "motion promo", "county": f"county {k}"}), True) for k in range(40)]
    subs += [("odd", "u", "keyword", '{"keyword": "motion", "county": "1:county 1|"}', True), ("moot", "u", "keyword", '{"keyword": "motion", "outcome": "moot"}', True)]
    table, waits = spark.createDataFrame(rulings, RULING), alerts.waiting(alerts.subscriptions(spark.createDataFrame(subs, SUBSCRIPTION)))
    rows = alerts._said(table.select("*", F.col("party_ids").alias("parties"), F.split("ruling_text", " ").alias("words")), waits)
    assert alerts.met(rows, waits).count() == 400
    want = {(f"s{k % 40}", f"d{k}") for k in range(400) if k % 3}
    assert {(r.subscription_id, r.document_id) for r in alerts.triggered(table, waits).collect()} == want


def test_more_shapes_and_words_than_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(alerts, "FEW", 0)
    test_all_kinds_against_brute_force(spark)
    test_a_common_word_meets_by_all_fields(spark)
