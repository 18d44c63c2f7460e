"""The loader against events applied one after another, however they are dealt to batches and whenever these are compacted."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docketry.streaming import keyed, load


def event(k, **fields):
    base = {
        "document_id": f"d{k}", "scraper_id": "s", "state": "CA", "county": "Kern", "court": "Superior Court", "content_format": "html", "content_hash": "h", "case_number": "N1",
        "capture_timestamp": "2026-03-04T08:00:00", "hearing_date": "2026-03-05", "ruling_text": "The motion is GRANTED.",
    }
    return {n: v for n, v in (base | fields).items() if v is not None}


def made(rng, n):
    """Events whose documents, titles, names and days contradict one another, captured in no order."""
    return [
        event(
            rng.randrange(6), case_number=rng.choice(["N1", "N2", "N3"]), case_title=rng.choice([None, None, "", "A v. B", "New v. Old", "In re C"]), court=rng.choice(["Superior Court", "Court"]), county=rng.choice(["Kern", "Kings"]),
            hearing_date=rng.choice([None, "2026-03-05", "2026-04-01"]), judge_name=rng.choice([None, "LEE, ANN", "Ann Lee", "Bo Day"]), outcome=rng.choice([None, "granted", "denied"]), content_hash=rng.choice("abc"),
            capture_timestamp=f"2026-03-{rng.randrange(1, 28):02d}T08:00:00",
        )
        for _ in range(n)
    ]


def applied(events, aliases=()):
    """What a relational store holds after upserts and guarded inserts in this order."""
    courts, cases, documents, judges, rulings, links = {}, {}, {}, {("Ann Lee", "ca-kern"): "known"} if aliases else {}, {}, {}
    for e in events:
        code = f"ca-{e['county'].lower()}"
        courts[code] = f"{e['court']}, County of {e['county']}"
        case = (code, e["case_number"])
        cases[case] = e.get("case_title") or cases.get(case)
        documents.setdefault(e["document_id"], (case, e["content_hash"], e.get("hearing_date")))
        judge = e.get("judge_name")
        if judge:
            judge = judges.setdefault((judge, code), (judge, code))
        if e.get("hearing_date"):
            rulings.setdefault(e["document_id"], (case, judge, e["hearing_date"], e.get("outcome") or "granted"))
        if judge:
            links.setdefault((case, judge), e.get("hearing_date"))
    return courts, cases, documents, judges, rulings, links


def held(spark, base):
    """The same from the loader's tables."""
    rows = {t: load.read_log(spark, base, t).collect() for t in load.RULES}
    code = {r.court_id: r.court_code for r in rows["courts"]}
    case = {r.case_id: (code[r.court_id], r.case_number) for r in rows["cases"]}
    judge = {r.judge_id: (r.raw_name, code[r.court_id]) for r in rows["judge_aliases"] if r.judge_id != "known"} | {None: None, "known": "known"}
    day = lambda d: d and str(d)
    assert {r.judge_id for r in rows["judges"]} == {r.judge_id for r in rows["judge_aliases"] if r.judge_id != "known"}
    return (
        {r.court_code: r.court_name for r in rows["courts"]}, {case[r.case_id]: r.case_title for r in rows["cases"]},
        {r.document_id: (case[r.case_id], r.content_hash, day(r.hearing_date)) for r in rows["documents"]}, {(r.raw_name, code[r.court_id]): judge[r.judge_id] for r in rows["judge_aliases"]},
        {r.document_id: (case[r.case_id], judge[r.judge_id], day(r.hearing_date), r.outcome) for r in rows["rulings"]}, {(case[r.case_id], judge[r.judge_id]): day(r.assigned_at) for r in rows["case_judges"]},
    )


def put(spark, base, batch, events):
    rows = [(json.dumps(e), k) for k, e in enumerate(events)]
    random.Random(batch).shuffle(rows)  # the place of arrival counts, not the place in the table
    load.load_batch(spark.createDataFrame(rows, "value string, arrived long"), batch, base)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_into_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    events, base, at, batch = made(rng, 14), str(tmp_path / "t"), 0, 0
    load.create_tables(spark, base)
    if seed == 3:
        court = spark.sql("select sha2('ca-kern', 256) as court_id, 'Ann Lee' as raw_name, 'known' as judge_id, 'people' as source, 1.0D as confidence, true as is_verified")
        load.add_aliases(spark, base, court)
    while at < len(events):
        n = rng.randrange(2, 9)
        put(spark, base, batch, events[at : at + n])
        if rng.random() < 0.3:
            put(spark, base, batch, events[at : at + n])  # a replay
        if rng.random() < 0.5:
            load.compact(spark, base)
        at, batch = at + n, batch + 1
    want = applied(events, aliases=seed == 3)
    assert held(spark, base) == want
    load.compact(spark, base)
    assert load.compact(spark, base) == {} and held(spark, base) == want


def test_a_title_survives_a_later_event_without_one(spark, tmp_path):
    base = str(tmp_path / "t")
    load.create_tables(spark, base)
    put(spark, base, 0, [event(1, case_title="Old v. Old", capture_timestamp="2026-03-01T08:00:00"), event(2, capture_timestamp="2026-03-09T08:00:00")])
    put(spark, base, 1, [event(3, case_title="New v. New", capture_timestamp="2026-03-05T08:00:00")])
    assert [r.case_title for r in load.current_cases(spark, base).collect()] == ["New v. New"]


def test_batches_and_compactions_that_died(spark, tmp_path):
    base = str(tmp_path / "t")
    load.create_tables(spark, base)
    put(spark, base, 0, [event(1, case_title="A")])
    before = held(spark, base)
    # events without a manifest row, and buckets without a generation
    load.derive(load.split_events(spark.createDataFrame([(json.dumps(event(2, case_title="B")),)], "value string"), batch=1)[0]).write.parquet(f"{base}/events/bid=1")
    store = load._store(spark, base)
    spark.createDataFrame([("x", "wrong", None, None, "c", "n", "m")], "case_id string, case_title string, case_title__seq string, first__seq string, court_id string, case_number string, case_number_normalized string").write.parquet(f"{base}/tables/cases/bucket=0/gen=7")
    assert held(spark, base) == before
    load.compact(spark, base)
    assert held(spark, base) == before and store.newest()[0] == 0
    put(spark, base, 1, [event(2, case_title="B")])
    assert set(held(spark, base)[1].values()) == {"B"}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    base = str(tmp_path / "t")
    load.create_tables(spark, base)
    put(spark, base, 0, [event(k, case_number=f"N{k}") for k in range(80)])
    every = load.compact(spark, base)
    assert len(every["cases"]) > 12 and len(every["courts"]) == 1
    put(spark, base, 1, [event(100, case_number="N3", case_title="T")])
    some = load.compact(spark, base)
    assert {t: len(b) for t, b in some.items()} == {"courts": 1, "cases": 1, "documents": 1, "judges": 0, "judge_aliases": 0, "case_judges": 0, "rulings": 1}
    assert {r.case_number: r.case_title for r in load.current_cases(spark, base).collect()} == {f"N{k}": "T" if k == 3 else None for k in range(80)}
    # a batch reads nothing of what is there
    plan = load.derive(load.split_events(spark.createDataFrame([("x",)], "value string"), batch=2)[0])._jdf.queryExecution().toString()
    assert "parquet" not in plan.lower()


def test_merging_is_associative(spark):
    rule = keyed.Rule(("k",), last=("a",), fill=("b",), first=("c",))
    rng = random.Random(5)
    rows = [(rng.randrange(3), (rng.randrange(4), rng.randrange(3), n), f"a{n}", rng.choice([None, f"b{n}"]), rng.choice([None, f"c{n}"])) for n in range(40)]
    df = keyed.states(spark.createDataFrame(rows, f"k int, seq {keyed.SEQ}, a string, b string, c string"), rule)
    once = sorted(map(str, keyed.merged(df, rule).collect()))
    part = F.pmod(F.hash("a"), F.lit(3))
    some = [keyed.merged(df.where(part == n), rule) for n in range(3)]
    assert sorted(map(str, keyed.merged(some[2].unionByName(keyed.merged(some[0].unionByName(some[1]), rule)), rule).collect())) == once


def test_columns_of_a_table_are_those_of_the_whole(spark, sf):
    from docketry.plans.catalog import _loaded

    base = _loaded(spark, sf)
    few = load.read_log(spark, base, "rulings", ("case_id", "outcome"))
    assert few.columns == [c for c in load.read_log(spark, base, "rulings").columns if c in ("document_id", "case_id", "outcome")]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "ruling_text" not in plan.split("Relation")[0] and "raw_judge" not in plan.split("Relation")[0]
    whole = load.read_log(spark, base, "rulings").select(*few.columns)
    assert few.exceptAll(whole).count() == 0 and whole.exceptAll(few).count() == 0
