"""Pages, analytics, merges, search, sources and streams by example."""

import datetime
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry import session
from docketry.operators import analytics, merge, paging, relations, search
from docketry.sources import files
from docketry.streaming import health, load

DAY = datetime.date


@given(st.lists(st.one_of(st.text(max_size=20), st.integers(-(2**50), 2**50), st.none()), max_size=4))
def test_cursor_round_trip(values):
    assert paging.decode_cursor(paging.encode_cursor(values)) == values


def test_page_sizes():
    assert [paging.page_size(n) for n in (None, 0, -5, 7, 500)] == [20, 1, 1, 7, 100]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10**6)), min_size=1, max_size=40, unique=True), st.integers(1, 9), st.booleans())
def test_pages_are_the_sorted_whole(spark, rows, size, descending):
    df = spark.createDataFrame(rows, "a int, id int")
    out, after = [], None
    while True:
        got = paging.page(df, ["a", "id"], descending, first=size, after=after).fetch()
        out += [tuple(r) for r in got["rows"]]
        after = got["end"]
        if not got["has_next"]:
            break
    assert out == sorted(rows, reverse=descending)


def test_keyset_and_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("cast(id % 7 as int) a", "id", "cast('2026-01-01' as date) d").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = paging.page(paging.date_range(df, "d", "2025-01-01"), ["a", "id"], True, 5, paging.encode_cursor([3, 50])).rows._jdf.queryExecution().toString()
    assert "LessThanOrEqual(a,3)" in plan and "GreaterThanOrEqual(d,2025-01-01)" in plan and "TakeOrderedAndProject" in plan


RULINGS = [
    ("2025-01-10", "granted", "msj"), ("2025-02-15", "granted", "msj"), ("2025-03-20", "granted", "msj"), ("2025-04-01", "denied", "msj"),
    ("2025-05-12", "granted_in_part", "msj"), ("2025-06-01", "denied", "mtd"), ("2025-07-15", "moot", "mtd"), ("2025-08-01", "granted", "demurrer"),
    ("2025-09-01", "granted", None), ("2025-10-01", None, "msj"),
]


def test_judge_analytics(spark):
    rulings = spark.createDataFrame([(1, DAY.fromisoformat(d), o, m) for d, o, m in RULINGS], "judge_id int, hearing_date date, outcome string, motion_type string")
    judges = spark.createDataFrame([(1, "A"), (2, "B")], "id int, canonical_name string")
    got = {r.judge_id: r for r in analytics.judge_analytics(judges, rulings).collect()}
    r = got[1]
    assert (r.total_rulings, r.earliest, r.latest) == (10, "2025-01-10", "2025-10-01")
    assert {x.outcome: x.n for x in r.by_outcome} == {"granted": 5, "denied": 2, "granted_in_part": 1, "moot": 1}
    motions = [tuple(x) for x in r.by_motion_type]
    assert motions == [("msj", 6, 3, 1, 1, 0, 0.6), ("mtd", 2, 0, 1, 0, 1, 0.0), ("demurrer", 1, 1, 0, 0, 0, 1.0)]
    assert (got[2].total_rulings, got[2].by_outcome, got[2].by_motion_type, got[2].earliest) == (0, [], [], None)
    stats = {x.motion_type: tuple(x)[1:] for x in analytics.motion_stats(rulings).collect()}
    assert stats == {m[0]: m[1:] for m in motions}


def test_upsert(spark):
    target = spark.createDataFrame([(1, "old", "x", "first"), (2, "old", None, "first")], "k int, a string, b string, c string")
    batch = spark.createDataFrame([(1, 1, "n1", "y", "z"), (1, 2, "n2", None, "z"), (3, 1, "n", None, "p"), (3, 2, "m", None, "q")], "k int, seq int, a string, b string, c string")
    got = sorted(tuple(r) for r in merge.upsert(target, batch, ["k"], overwrite=["a"], fill=["b"], first=["c"]).collect())
    assert got == [(1, "n2", "y", "first"), (2, "old", None, "first"), (3, "m", None, "p")]


def test_relations(spark):
    links = spark.createDataFrame([(1, 10)], "case_id int, judge_id int")
    rulings = spark.createDataFrame([(1, 11), (2, 12), (2, 12), (3, None)], "case_id int, judge_id int")
    assert sorted(tuple(r) for r in relations.judges_of_cases(links, rulings).collect()) == [(1, 10), (2, 12)]
    hits = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    ids = spark.createDataFrame([("d1", "r1"), ("d1", "r2")], "document_id string, ruling_id string")
    assert sorted(r.ruling_id for r in relations.ruling_ids_of_hits(hits, ids).collect()) == ["d2", "r2"]
    assert relations.unknown_ids(["a", "b", "a", "c"], ["b"]) == ["a", "c"]


def corpus(spark):
    rows = [
        ("d1", "23STCV01234", "Court, County of Los Angeles", "Los Angeles", "CA", "Johnson, Robert M.", DAY(2026, 2, 10), "The motion for summary judgment is granted. Judgments are final."),
        ("d2", "23STCV01234", "Court, County of Los Angeles", "Los Angeles", "CA", "Johnson, Robert M.", DAY(2026, 2, 11), "Demurrer overruled. Fraud is alleged."),
        ("d3", "24XX", "Other", "Kern", "CA", "Lee", DAY(2099, 1, 1), "A demurrer, later; summary."),
        ("d4", "24XX", "Other", "Kern", "CA", "Lee", None, None),
    ]
    return spark.createDataFrame(rows, "document_id string, case_number string, court string, county string, state string, judge_name string, hearing_date date, ruling_text string")


def test_search(spark, tmp_path):
    search.build_index(corpus(spark)).write(str(tmp_path / "index"))
    index = search.SearchIndex.read(spark, str(tmp_path / "index"))
    ids = lambda *a, **k: [r.document_id for r in search.search(index, *a, today="2026-03-01", **k)[0].fetch()["rows"]]
    hit = search.search(index, "Summary Judgment", today="2026-03-01")[0].fetch()["rows"]
    assert [r.document_id for r in hit] == ["d1"] and hit[0].score > 0 and "<mark>judgment</mark>" in hit[0].excerpt and "<mark>Judgments</mark>" in hit[0].excerpt
    assert ids("demurrer fraud") == ["d2"] and ids("zebra") == [] and ids("the of") == [] and ids("demurrer") == ["d2"]
    assert ids("demurrer", include_future=True)[:1] and set(ids("demurrer", date_to="2100-01-01")) == {"d2", "d3"}
    assert ids(county="Los Angeles") == ["d2", "d1"] and ids(date_from="2026-02-11") == ["d2"] and ids(case_number="23STCV") == ["d2", "d1"] and ids(judge_name="johnson") == []
    assert ids(include_future=True) == ["d3", "d2", "d1", "d4"]
    first = search.search(index, county="Los Angeles", today="2026-03-01", first=1)[0].fetch()
    assert first["has_next"] and ids(county="Los Angeles", first=1, after=first["end"]) == ["d1"]
    assert search.search(index, "demurrer", include_future=True)[1].count() == 2


def test_refresh_index(spark):
    """An equal hash is skipped even though the text differs; a null hash, another hash and a new id are indexed."""
    schema = "document_id string, content_hash string, ruling_text string"
    before = [("a", "1", "alpha one"), ("b", "2", "beta"), ("c", None, "gamma"), ("d", "4", None)]
    batch = [("a", "1", "skipped"), ("b", "3", "delta"), ("c", None, "gamma anew"), ("d", "5", ""), ("e", "6", "alpha")]
    index = search.refresh_index(search.build_index(spark.createDataFrame(before, schema), stemmed=False), spark.createDataFrame(batch, schema))
    assert {r.document_id: r.ruling_text for r in index.docs.collect()} == {"a": "alpha one", "b": "delta", "c": "gamma anew", "d": "", "e": "alpha"}
    assert {(r.term, r.document_id) for r in index.postings.collect()} == {("alpha", "a"), ("one", "a"), ("delta", "b"), ("gamma", "c"), ("anew", "c"), ("alpha", "e")}
    assert {r.term: r.df for r in index.terms.collect()} == {"alpha": 2, "one": 1, "delta": 1, "gamma": 1, "anew": 1}
    again = search.refresh_index(index, spark.createDataFrame(batch, schema).where("document_id <> 'c'"))
    assert sorted(again.docs.collect()) == sorted(index.docs.select(again.docs.columns).collect())
    empty = search.refresh_index(index, spark.createDataFrame([], schema))
    assert empty.terms.count() == 5 and empty.docs.count() == 5


def test_publish_index(spark, tmp_path):
    """The alias moves to what was published last; a refresh can be published while the old version is read."""
    root, schema = str(tmp_path / "indexes"), "document_id string, content_hash string, ruling_text string"
    search.publish_index(search.build_index(spark.createDataFrame([("a", "1", "alpha")], schema), stemmed=False), root)
    old = search.published_index(spark, root, stemmed=False)
    folder = search.publish_index(search.refresh_index(old, spark.createDataFrame([("b", "2", "beta")], schema)), root)
    assert {r.term for r in search.published_index(spark, root, stemmed=False).terms.collect()} == {"alpha", "beta"}
    assert {r.term for r in old.terms.collect()} == {"alpha"} and folder.startswith(f"{root}/versions/")
    # a publisher that read the same last number comes after, whatever its folder is called
    assert not session.put_once(spark, f"{root}/alias/{2:012d}", "elsewhere") and session.last_put(spark, f"{root}/alias") == (f"{2:012d}", folder)
    with pytest.raises(ValueError):
        search.published_index(spark, str(tmp_path / "none"))


def test_run_table(spark, tmp_path):
    schema = "event_id string, scraper_id string, success boolean, records_captured int, response_time_seconds double, error_message string, run_timestamp timestamp"
    at = datetime.datetime(2026, 3, 1, 8)
    rows = [("e1", "a", True, 3, 1.5, None, at), ("e1", "a", True, 3, 1.5, None, at), ("e2", "a", False, 2, 0.25, "boom", at), ("e3", "b", False, 0, None, "boom", at), ("e4", "b", None, None, 1.0, None, None)]
    for _ in range(2):  # the second time is a replay
        health.load_runs(spark.createDataFrame(rows, schema), 7, str(tmp_path / "runs"))
    got = {r.id: (r.status, r.records_captured, r.response_time_ms, r.completed_at) for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    done = lambda ms: at + datetime.timedelta(milliseconds=ms)
    assert got == {"e1": ("success", 3, 1500, done(1500)), "e2": ("partial", 2, 250, done(250)), "e3": ("failure", 0, None, None), "e4": ("failure", 0, 1000, None)}


PAGE = """<html><body><form><input type="hidden" name="__VIEWSTATE" value="a&amp;b"/><select><option value="ALH,3,03/02/2026">(Alhambra Courthouse:  Dept. 3) March 2, 2026</option>
<option value="bad">x</option><option value="BH,205,99/99/2026">(Beverly Hills: Dept. 205) ?</option></select></form><a href="/a.pdf">One&nbsp; <b>file</b></a><a class="x" href="/a.pdf">again</a>
<a href="b.html">b</a><script>no</script><div id="speechSynthesis">The motion<div>is <b>GRANTED</b></div></div><p>after</p></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://x.org/dir/index.html", PAGE)], "page_id int, url string, html string")
    options = [tuple(r) for r in files.dropdown_options(pages).select("courthouse_code", "department", "hearing_date", "courthouse").orderBy("position").collect()]
    assert options == [("ALH", "3", DAY(2026, 3, 2), "Alhambra Courthouse"), ("BH", "205", None, "Beverly Hills")]
    links = files.page_links(pages, "page_id", ending=".pdf").collect()
    assert [(r.href, r.link_text) for r in links] == [("/a.pdf", "One file")]
    r = pages.select(files.html_text("html").alias("t"), files.form_tokens(F.col("html")).alias("f"), *[files.absolute_url(F.lit(h), F.col("url")).alias(n) for n, h in (("u", "/a.pdf"), ("v", "b.html"), ("w", "http://y/z"))]).first()
    assert r.t == "The motion\nis\nGRANTED" and r.f["__VIEWSTATE"] == "a&amp;b" and r.f["__EVENTVALIDATION"] is None
    assert (r.u, r.v, r.w) == ("https://x.org/a.pdf", "https://x.org/dir/b.html", "http://y/z")
    queue = spark.createDataFrame([('{"a":1}',), (json.dumps({"Records": [{"body": '{"a":2}'}, {"Sns": {"Message": '{"a":3}'}}, {}]}),)], "value string")
    assert sorted(r.value for r in files.queue_events(queue).collect()) == ['{"a":1}', '{"a":2}', '{"a":3}', "{}"]


def test_archive(spark, tmp_path):
    folder = tmp_path / "ca/los_angeles/superior_court/raw/2026/03/05"
    folder.mkdir(parents=True)
    (folder / "doc1.html").write_bytes(b"ok \xff")
    r = files.read_documents(spark, str(tmp_path)).first()
    assert (r.text, r.state, r.county, r.court, r.day, r.document_id, r.extension) == ("ok �", "ca", "los_angeles", "superior_court", DAY(2026, 3, 5), "doc1", "html")


def event(doc, **more):
    base = {
        "document_id": doc, "scraper_id": "ca-la", "state": "CA", "county": "Los Angeles", "court": "Superior Court", "content_format": "html", "content_hash": "h",
        "case_number": "23STCV12345", "judge_name": "Smith, John A.", "ruling_text": "The motion for summary judgment is GRANTED.", "hearing_date": "2026-03-05", "capture_timestamp": f"2026-03-04T23:00:0{doc[-1]}",
    }
    return json.dumps({k: v for k, v in (base | more).items() if v is not None})


def tables(spark, base):
    return {t: load.read_log(spark, base, t).count() for t in ("documents", "rulings", "judges", "judge_aliases", "case_judges", "dead_letters")} | {
        "courts": load.current_courts(spark, base).count(), "cases": load.current_cases(spark, base).count(),
    }


def test_stream_load(spark, tmp_path):
    landed, base = tmp_path / "in", str(tmp_path / "tables")
    landed.mkdir()
    lines = [event("d1", case_title="A v. B"), event("d2", hearing_date=None), event("d1", outcome="denied", capture_timestamp="2026-03-04T23:30:00"), "not json", event("d3", outcome="GRANTED"), event("d4", case_number=None, judge_name=None, ruling_text=None)]
    lines.append(json.dumps({"scraper_id": "x"}))
    (landed / "1.txt").write_text("\n".join(lines))
    run = lambda mark: load.run_loader(files.stream_events(spark, str(landed)), base, str(tmp_path / mark))
    run("c")
    want = {"documents": 3, "rulings": 2, "judges": 1, "judge_aliases": 1, "case_judges": 1, "dead_letters": 3, "courts": 1, "cases": 2}
    assert tables(spark, base) == want
    rows = {r.document_id: r for r in load.read_log(spark, base, "rulings").collect()}
    assert (rows["d1"].outcome, rows["d1"].motion_type, rows["d4"].judge_id) == ("granted", "msj", None)
    assert {r.case_number for r in load.current_cases(spark, base).collect()} == {"23STCV12345", "UNKNOWN-d4"}
    assert {r.reason for r in load.read_log(spark, base, "dead_letters").collect()} == {"malformed_json", "bad_outcome", "missing_key"}
    assert load.read_log(spark, base, "judges").first().canonical_name == "John A. Smith"
    run("c")
    assert tables(spark, base) == want
    run("again")  # a lost checkpoint replays everything
    assert tables(spark, base) == want
    (landed / "2.txt").write_text("\n".join([event("d2", case_title=None, outcome="moot"), event("d5", judge_name="Smith, John A.")]))
    run("c")
    assert tables(spark, base) == want | {"documents": 4, "rulings": 4}
    assert {r.case_title for r in load.current_cases(spark, base).collect()} == {"A v. B", None}
    assert load.index_documents(spark, base).count() == 4


def test_normalized_outcomes(spark):
    raw = spark.createDataFrame([(event(f"d{i}", outcome=o),) for i, o in enumerate(["SUSTAINED", "Off  calendar", "granted"])], "value string")
    good, dead = load.split_events(raw, normalize_outcomes=True)
    assert sorted(r.outcome for r in good.collect()) == ["granted", "granted", "off_calendar"] and dead.count() == 0


def test_windows(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1, 12) + datetime.timedelta(minutes=m)
    rows = [("a", at(m)) for m in (0, 5, 14, 15, 29.5, 31)] + [("b", at(100))]
    df = spark.createDataFrame(rows, "who string, at timestamp")
    got = sorted((r.who, r.at, r.attempt, r.ok) for r in health.number_attempts(df, "who", "at", "at", allowed=2).collect())
    assert [(n, ok) for *_, n, ok in got] == [(1, True), (2, True), (3, False), (1, True), (2, True), (1, True), (1, True)]
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = health.limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "who", "at", allowed=2)
    stream.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.who, r.attempts, r.ok) for r in spark.table("limits").collect()) == sorted((w, n, ok) for w, _, n, ok in got)


@pytest.mark.parametrize("seconds", [3.0])
def test_health(spark, seconds):
    runs = spark.createDataFrame([("s", True, 5, seconds, datetime.datetime(2026, 1, 1, 3)), ("s", False, 7, 1.0, datetime.datetime(2026, 1, 1, 4))], "scraper_id string, success boolean, records_captured int, response_time_seconds double, run_timestamp timestamp")
    assert tuple(analytics.run_health(runs).first())[:5] == ("s", 2, 1, 5, 2.0)
    assert [tuple(r) for r in health.daily_successes(runs).collect()] == [("s", DAY(2026, 1, 1), 2, 1)]
