"""More registered queries: the public lists, the loader, fields of sources, backfill, boolean and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import courts
from docketry.operators import analytics, merge, paging, relations, search
from docketry.plans import alerts as _alerts  # noqa: F401
from docketry.plans import entities as _entities  # noqa: F401  (registers its queries)
from docketry.plans import staging as _staging_queries  # noqa: F401
from docketry.plans import text_search as _text_search  # noqa: F401
from docketry.plans.api import Store
from docketry.plans.queries import _RATE, _TOKENS, ORACLE_SQL, QUERIES, TODAY, _index, query
from docketry.plans.sql import over
from docketry.session import read_table, scratch_folder
from docketry.sources import domain, files
from docketry.streaming import health, load

__all__ = ["ORACLE_SQL", "QUERIES"]


# the public queries over a store

_PUBLIC = "r AS (SELECT case_id || '-' || seq AS id, case_id, judge_id, court_id, hearing_date, outcome FROM rulings JOIN cases ON cases.id = case_id)"


def _store(spark: SparkSession, sf_dir: str) -> Store:
    cases, rulings = domain.cases(spark, sf_dir), domain.rulings(spark, sf_dir)
    of_case = cases.select(F.col("id").alias("case_id"), "court_id")
    rulings = rulings.join(of_case, "case_id").withColumn("id", F.concat_ws("-", F.col("case_id").cast("string"), "seq"))
    links = rulings.where("outcome = 'granted'").select("case_id", "judge_id").distinct()
    numbered = cases.withColumn("case_number", F.concat(F.lit("N"), F.col("id")))
    return Store(domain.courts(spark, sf_dir), domain.judges(spark, sf_dir), numbered, rulings, links)


@query(over("cases", query="SELECT id, case_type, strftime(created_at, '%Y-%m-%d') AS day FROM cases WHERE court_id = 7 AND case_status = 'F' ORDER BY cases.created_at DESC, id DESC LIMIT 41"))
def api_case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q03."""
    page = _store(spark, sf_dir).case_list(court_id=7, case_status="F", first=40)
    return page.rows.select("id", "case_type", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(over("judges", query="SELECT id, canonical_name FROM judges WHERE court_id = 3 ORDER BY canonical_name, id LIMIT 21"))
def api_judge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q06."""
    return _store(spark, sf_dir).judge_list(court_id=3).rows.select("id", "canonical_name")


@query(
    over(
        "rulings", "cases", "courts", more=_PUBLIC,
        query="SELECT id, case_id, CAST(hearing_date AS VARCHAR) AS hearing_date FROM r WHERE outcome = 'denied' AND court_id IN (SELECT id FROM courts WHERE county = 'NATION_4') "
        f"AND hearing_date >= DATE '1993-01-01' AND hearing_date <= DATE '{TODAY}' ORDER BY r.hearing_date DESC, id DESC LIMIT 101",
    )
)
def api_ruling_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q08: filters on the ruling and on its court's county; the future is left out."""
    page = _store(spark, sf_dir).ruling_list(outcome="denied", county="NATION_4", date_from="1993-01-01", today=TODAY, first=100)
    return page.rows.select("id", "case_id", F.col("hearing_date").cast("string").alias("hearing_date"))


@query(
    over(
        "rulings", "cases", more=_PUBLIC,
        query="SELECT id, CAST(hearing_date AS VARCHAR) AS hearing_date, outcome FROM r WHERE case_id = 34",
    )
)
def api_rulings_of_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By case number, the future included."""
    page = _store(spark, sf_dir).ruling_list(case_number="N34", include_future=True)
    return page.rows.select("id", F.col("hearing_date").cast("string").alias("hearing_date"), "outcome")


@query(
    over(
        "rulings", "cases", "courts", "judges",
        query="SELECT cases.id, county, (SELECT coalesce(string_agg(canonical_name, ',' ORDER BY canonical_name), '') FROM judges WHERE id IN (SELECT judge_id FROM rulings WHERE case_id = 35 AND "
        "(outcome = 'granted' OR NOT EXISTS (SELECT 1 FROM rulings WHERE case_id = 35 AND outcome = 'granted')))) AS judges FROM cases JOIN courts ON courts.id = court_id WHERE cases.id = 35",
    )
)
def api_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q02, Q09: a case with its court and its judges, by links or else by rulings."""
    row = _store(spark, sf_dir).case(35)
    return row.select("id", "court.county", F.array_join(F.transform("judges", lambda x: x["canonical_name"]), ",").alias("judges"))


@query(over("rulings", "cases", "judges", more=_PUBLIC, query="SELECT 'ruling' AS kind, id, outcome AS detail FROM r WHERE id = (SELECT MIN(id) FROM r) UNION ALL SELECT 'judge', CAST(id AS VARCHAR), canonical_name FROM judges WHERE id = 5"))
def api_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q05, Q07, S17."""
    store = _store(spark, sf_dir)
    first = store.rulings.agg(F.min("id").alias("id"))
    ruling = relations.lookup(store.rulings, first).select(F.lit("ruling").alias("kind"), "id", F.col("outcome").alias("detail"))
    return ruling.unionAll(store.judge(5).select(F.lit("judge"), F.col("id").cast("string"), "canonical_name"))


@query(
    over(
        "rulings", "judges",
        query="SELECT judges.id AS judge_id, canonical_name, (SELECT COUNT(*) FROM rulings WHERE judge_id = 9) AS total_rulings, (SELECT COUNT(DISTINCT motion_type) FROM rulings WHERE judge_id = 9) AS motion_types, "
        "(SELECT MAX(grant_rate) FROM (SELECT motion_type, " + _RATE.replace("granted_in_part", "partly") + " AS grant_rate FROM (SELECT motion_type, COUNT(*) FILTER (WHERE outcome = 'granted') AS granted, "
        "COUNT(*) FILTER (WHERE outcome = 'denied') AS denied, COUNT(*) FILTER (WHERE outcome IN ('granted_in_part', 'denied_in_part')) AS partly FROM rulings WHERE judge_id = 9 GROUP BY motion_type))) AS best_rate FROM judges WHERE id = 9",
    )
)
def api_judge_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q04."""
    row = _store(spark, sf_dir).judge_analytics(9)
    best = F.array_max(F.transform("by_motion_type", lambda x: x["grant_rate"]))
    return row.select("judge_id", "canonical_name", "total_rulings", F.size("by_motion_type").cast("long").alias("motion_types"), best.alias("best_rate"))


# loads


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One captured event an order; the court's name depends on the order's status, and so changes with time."""
    o = read_table(spark, sf_dir, "orders")
    n, text = F.col("o_orderkey").cast("string"), lambda c: F.col(c).cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fields = {
        "document_id": F.concat(F.lit("d"), n), "scraper_id": F.lit("s"), "state": F.lit("CA"), "county": F.concat(F.lit("County "), (F.col("o_custkey") % 7).cast("string")),
        "court": F.concat(F.lit("Court "), F.col("o_orderstatus")), "content_format": F.lit("html"), "content_hash": F.lit("h"), "case_number": F.concat(F.lit("N-"), text("o_custkey")),
        "case_title": F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Case "), n)), "ruling_text": F.when(F.col("o_orderstatus") == "F", "The demurrer is GRANTED.").otherwise("The hearing is continued."),
        "hearing_date": F.when(F.col("o_orderpriority") != "1-URGENT", day), "capture_timestamp": F.concat(day, F.lit("T08:00:00")), "outcome": F.when(F.col("o_orderpriority") == "5-LOW", "moot"),
        "judge_name": F.concat(F.lit("LEE, ANN "), F.upper(F.substring("o_orderstatus", 1, 1))),
    }
    return o.select("o_orderdate", F.col("o_orderkey").alias("arrived"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value"))


_LOADED = (
    "e AS (SELECT 'd' || o_orderkey AS doc, 'ca-county-' || (o_custkey % 7) AS court_code, 'Court ' || o_orderstatus || ', County of County ' || (o_custkey % 7) AS court_name, 'N-' || o_custkey AS case_number, o_orderpriority AS p, o_orderstatus AS s, "
    "CASE WHEN o_orderstatus = 'O' THEN 'Case ' || o_orderkey END AS title, (o_orderdate < TIMESTAMP '1995-01-01', o_orderkey) AS seq FROM orders)"
)


def _loaded(spark: SparkSession, sf_dir: str) -> str:
    """Tables that the loader has written from two batches, the first of them compacted, and from one that died before its
    manifest.  Orders arrive by their keys within a batch; the later half of the dates comes first."""
    base, rows = scratch_folder(spark, "loaded"), _events(spark, sf_dir)
    load.create_tables(spark, base)
    late = F.col("o_orderdate") >= "1995-01-01"
    load.load_batch(rows.where(late).select("value", "arrived"), 0, base)
    load.compact(spark, base)
    load.load_batch(rows.where(~late).select("value", "arrived"), 1, base)
    lost = rows.select(F.replace("value", F.lit("Court "), F.lit("Lost ")).alias("value"), "arrived")
    load.derive(load.split_events(lost, batch=2)[0]).write.mode("overwrite").parquet(f"{base}/events/bid=2")
    return base


@query(f"WITH {_LOADED} SELECT court_code, arg_max(court_name, seq) AS court_name, 'America/Los_Angeles' AS timezone, COUNT(*) AS documents, COUNT(*) FILTER (WHERE p <> '1-URGENT') AS rulings FROM e GROUP BY court_code")
def load_courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts by their last event, with the documents and rulings that were loaded."""
    base = _loaded(spark, sf_dir)
    count = lambda t, name: load.read_log(spark, base, t).groupBy("court_id").agg(F.count(F.lit(1)).alias(name))
    out = load.current_courts(spark, base).join(count("documents", "documents"), "court_id").join(count("rulings", "rulings"), "court_id", "left")
    return out.select("court_code", "court_name", "timezone", "documents", F.coalesce("rulings", F.lit(0)).alias("rulings"))


@query(f"WITH {_LOADED} SELECT court_code, case_number, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS case_title, COUNT(*) FILTER (WHERE p <> '1-URGENT' AND p <> '5-LOW' AND s = 'F') AS granted, COUNT(*) FILTER (WHERE p <> '1-URGENT' AND p = '5-LOW') AS moot FROM e GROUP BY ALL")
def load_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M02, E1, T-S2: cases by their last title, with outcomes from the event or else from its text."""
    base = _loaded(spark, sf_dir)
    rulings = load.read_log(spark, base, "rulings", ("case_id", "outcome")).groupBy("case_id").agg(F.count_if(F.col("outcome") == "granted").alias("granted"), F.count_if(F.col("outcome") == "moot").alias("moot"))
    out = load.current_cases(spark, base).join(load.current_courts(spark, base).select("court_id", "court_code"), "court_id").join(rulings, "case_id", "left")
    return out.select("court_code", "case_number", "case_title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("granted", "moot")])


@query(
    "SELECT COUNT(*) AS processed, COUNT(*) FILTER (WHERE s_acctbal >= 0) AS updated, COUNT(*) FILTER (WHERE s_acctbal >= 0) AS filled_title FROM (SELECT * FROM supplier WHERE s_nationkey < 12 ORDER BY s_suppkey LIMIT 50)"
)
def backfill_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run over the first 50 suppliers without a title, of whom those out of debt have one."""
    supplier = read_table(spark, sf_dir, "supplier")
    target = supplier.select("s_suppkey", F.when(F.col("s_nationkey") >= 12, "there").alias("title"))
    values = supplier.where("s_acctbal >= 0").select("s_suppkey", F.concat(F.lit("T"), "s_suppkey").alias("title"))
    return merge.backfill(target, values, ["s_suppkey"], ["title"], limit=50, dry_run=True)[1]


# fields of sources


@query(
    "SELECT s_suppkey, 'Ann Mc' || s_suppkey || ' Lee' AS oc_judge, 'C' || s_nationkey AS oc_department, 'PS' || s_nationkey AS riverside_department, 'Ann ' || s_suppkey AS riverside_judge, "
    "'S' || s_nationkey AS sb_department, DATE '2026-03-04' AS sb_date, lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS sf_department FROM supplier"
)
def source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text of a link or a file's name tells."""
    n, d = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    oc = courts.extract_fields("oc_civil", F.lit("").cast("string"), F.concat(F.lit("LEE, Ann Mc"), n, F.lit(" - Dept. C"), d))
    riverside = courts.extract_fields("riverside", F.lit(""), F.concat(F.lit("Department PS"), d, F.lit(" - Honorable Ann "), n))
    sb = courts.extract_fields("san_bernardino", F.lit(""), F.concat(F.lit("CVS"), d, F.lit("030426.pdf")))
    sf = courts.extract_fields("san_francisco", F.lit(""), F.concat(F.lpad(d, 3, "0"), F.lit(" Tentative Rulings")))
    return read_table(spark, sf_dir, "supplier").select(
        "s_suppkey", oc["judge_name"].alias("oc_judge"), oc["department"].alias("oc_department"), riverside["department"].alias("riverside_department"), riverside["judge_name"].alias("riverside_judge"),
        sb["department"].alias("sb_department"), sb["hearing_date"].alias("sb_date"), sf["department"].alias("sf_department"),
    )


@query(
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS hearing_date, 'Ann Lee' AS judge_name, '16' AS department, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || 'CV' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS case_number, "
    "CASE o_orderstatus WHEN 'F' THEN 'GRANTED' WHEN 'O' THEN 'Off calendar' ELSE 'SUSTAINED' END AS outcome, CASE o_orderstatus WHEN 'P' THEN 'Demurrer' ELSE 'Motion to compel' END AS motion_type FROM orders"
)
def source_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of a document from its text."""
    what = F.when(F.col("o_orderstatus") == "F", "motion  to compel is GRANTED").when(F.col("o_orderstatus") == "O", "motion to compel: off calendar").otherwise("demurrer is SUSTAINED")
    number = F.concat(F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("CV"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    t = F.concat(F.lit("Department 16\nHonorable Ann  Lee, Presiding\n"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("\n"), number, F.lit("\nThe "), what)
    found = courts.extract_fields("santa_clara", t)
    names = ("hearing_date", "judge_name", "department", "case_number", "outcome", "motion_type")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", *[found[n].alias(n) for n in names])


@query("SELECT c_mktsegment AS segment, COUNT(*) AS pages FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def error_pages_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's pages are apologies here."""
    page = F.when(F.col("c_mktsegment") == "BUILDING", "<p>We're sorry, no ruling was found</p>").otherwise(F.concat(F.lit("<p>"), "c_name", F.lit("</p>")))
    pages = read_table(spark, sf_dir, "customer").select("c_mktsegment", page.alias("html"))
    return files.without_error_pages(pages).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("pages"))


@query(
    "SELECT n_name AS department, '/d/' || n_regionkey || '.pdf' AS href, CAST(n_nationkey AS BIGINT) AS position, j AS judge FROM nation LEFT JOIN "
    "(SELECT s_nationkey, arg_min(s_name, s_suppkey) AS j FROM supplier WHERE s_nationkey < 4 GROUP BY 1) ON s_nationkey = n_regionkey"
)
def department_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departments and judges that share an address; the first judge of an address counts."""
    address = lambda c: F.concat(F.lit("/d/"), F.col(c).cast("string"), F.lit(".pdf")).alias("href")
    departments = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("position"), address("n_regionkey"), F.col("n_name").alias("link_text"))
    twice = departments.unionAll(departments.withColumn("position", F.col("position") + 100))
    judges = read_table(spark, sf_dir, "supplier").where("s_nationkey < 4").select(F.col("s_suppkey").alias("position"), address("s_nationkey"), F.col("s_name").alias("link_text"))
    return files.judges_of_departments(twice, judges)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'J' || o_custkey END AS judge_name, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END AS n_parties, 0 AS n_attorneys FROM orders")
def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON, some without lists."""
    name = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("J"), "o_custkey"))
    parties = F.when(F.col("o_orderstatus") != "P", F.array(F.lit("a"), F.lit("b")))
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(name.alias("judge_name"), parties.alias("parties"))).alias("value"))
    record = rows.select("o_orderkey", files.entity_record(F.col("value")).alias("r"))
    return record.select("o_orderkey", "r.judge_name", F.size("r.parties").alias("n_parties"), F.size("r.attorneys").alias("n_attorneys"))


# health and lists


@query("SELECT user_id AS scraper_id, COUNT(*) AS runs, COUNT(*) FILTER (WHERE value >= 10) AS successes, CAST(coalesce(SUM(CASE WHEN value >= 10 THEN event_id % 9 END), 0) AS BIGINT) AS records, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS last_run FROM events GROUP BY 1")
def scraper_run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a run, successful if its value is 10 or more."""
    e = read_table(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("scraper_id"), (F.col("value") >= 10).alias("success"), (F.col("event_id") % 9).alias("records_captured"), F.col("value").alias("response_time_seconds"), F.col("ts").alias("run_timestamp"))
    return analytics.run_health(runs).select("scraper_id", "runs", "successes", "records", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query(
    "SELECT source, round(score, 6) AS score, rank() OVER (ORDER BY round(score, 9)) AS place FROM (SELECT source, (0.5 * ran + 0.3 * valid + 0.2 * coalesce(checked, 0)) / (0.8 + CASE WHEN checked IS NULL THEN 0 ELSE 0.2 END) AS score FROM "
    "(SELECT user_id % 50 AS source, AVG(CASE WHEN value >= 10 THEN 1.0 ELSE 0.0 END) AS ran, AVG(CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 1.0 ELSE 0.0 END) AS valid, "
    "AVG(CASE WHEN event_type = 'purchase' THEN CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END END) AS checked FROM events GROUP BY 1))"
)
def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, validated records and spot checks in one score; the unhealthiest source first."""
    e = read_table(spark, sf_dir, "events")
    share = lambda hit: F.avg(F.when(hit, 1.0).otherwise(0.0))
    checked = F.avg(F.when(F.col("event_type") == "purchase", F.when(F.col("value") >= 50, 1.0).otherwise(0.0)))
    parts = e.groupBy((F.col("user_id") % 50).alias("source")).agg(share(F.col("value") >= 10).alias("ran"), share(F.get_json_object("props", "$.k").isNotNull()).alias("valid"), checked.alias("checked"))
    out = analytics.health_scores(parts, {"ran": 0.5, "valid": 0.3, "checked": 0.2})
    return out.select("source", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01'")
def unexpired_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's date is when it expires."""
    rows = read_table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "expires_at")
    return paging.unexpired(rows, now=F.lit("1997-06-01").cast("timestamp")).select("o_orderkey")


# search


@query(
    f"WITH {_TOKENS}, d AS (SELECT doc_id, list(DISTINCT term) AS terms FROM tokens GROUP BY doc_id) "
    "SELECT doc_id FROM d WHERE list_contains(terms, 'thing') AND (list_contains(terms, 'reou') OR list_contains(terms, 'time')) AND NOT list_contains(terms, 'people')"
)
def search_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thing AND (reou OR time) NOT people."""
    found = search.boolean_match(_index(spark, sf_dir), must=["thing"], some=["reou", "time"], without=["people"])
    return found.select(F.col("document_id").alias("doc_id"))


@query(
    "WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id IN (1, 2)) SELECT query, vec_id, round(cosine, 6) AS cosine FROM (SELECT query, vec_id, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS k FROM "
    "(SELECT query, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS cosine FROM embeddings, q WHERE label < 5)) WHERE k <= 10"
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors closest to each of two, among those with some labels."""
    e = read_table(spark, sf_dir, "embeddings")
    wanted = e.where("vec_id in (1, 2)").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return search.most_similar(e.where("label < 5"), wanted, 10).select("query", "vec_id", F.round("cosine", 6).alias("cosine"))


@query(over("rulings", "cases", query="SELECT case_id, judge_id, seq FROM rulings WHERE case_id = 7"))
def rulings_of_one_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J02."""
    return relations.rulings_of_case_number(domain.rulings(spark, sf_dir), domain.cases(spark, sf_dir), 7).select("case_id", "judge_id", "seq")


@query(over("rulings", query="SELECT judge_id, case_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY judge_id ORDER BY hearing_date DESC, case_id DESC, seq DESC) AS k FROM rulings) WHERE k <= 3"))
def latest_rulings_of_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three of each judge."""
    order = [F.col(c).desc() for c in ("hearing_date", "case_id", "seq")]
    return relations.top_per_group(domain.rulings(spark, sf_dir), ["judge_id"], order, 3).select("judge_id", "case_id", "seq")


_AMENDED = "(SELECT doc_id, CASE WHEN lang = 'en' THEN text || ' amended' ELSE text END AS text FROM documents)"


@query(f"WITH {_TOKENS.replace('FROM documents', 'FROM ' + _AMENDED)} SELECT term, COUNT(DISTINCT doc_id) AS df FROM tokens GROUP BY term")
def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies after English texts were amended; documents of equal content are skipped."""
    index, content = _index(spark, sf_dir), F.md5("text").alias("content_hash")
    index.docs = index.docs.select("*", content)
    amended = F.when(F.col("lang") == "en", F.concat("text", F.lit(" amended"))).otherwise(F.col("text")).alias("text")
    batch = index.docs.select("document_id", "lang", "source", "hearing_date", amended).select("*", content)
    return search.refresh_index(index, batch, "text").terms


@query(
    "SELECT event_id AS id, user_id AS scraper_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started, strftime(ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS completed, "
    "CASE WHEN value >= 10 THEN 'success' WHEN event_id % 9 > 0 THEN 'partial' ELSE 'failure' END AS status, event_id % 9 AS records_captured FROM events"
)
def scraper_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a run, sent twice here."""
    e = read_table(spark, sf_dir, "events")
    sent = e.select("event_id", F.col("user_id").alias("scraper_id"), (F.col("value") >= 10).alias("success"), (F.col("event_id") % 9).alias("records_captured"), F.col("value").alias("response_time_seconds"), F.lit(None).cast("string").alias("error_message"), F.col("ts").alias("run_timestamp"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return health.run_rows(sent.unionByName(sent)).select("id", "scraper_id", at("started_at").alias("started"), at("completed_at").alias("completed"), "status", "records_captured")
