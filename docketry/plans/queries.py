"""The registered queries: each applies operators to whole tables; SQL for DuckDB says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions import classify, courts, display, keys, replies, text, titles
from docketry.operators import analytics, merge, paging, relations, search
from docketry.plans.sql import first_match, over
from docketry.session import read_table
from docketry.sources import domain, files
from docketry.streaming import health

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: "Today" of the queries that leave the future out.
TODAY = "1996-06-30"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_PARTLY = "'granted_in_part', 'denied_in_part'"
_MOTIONS = (
    "SELECT judge_id, motion_type, COUNT(*) AS total, COUNT(*) FILTER (WHERE outcome = 'granted') AS granted, "
    "COUNT(*) FILTER (WHERE outcome = 'denied') AS denied, "
    f"COUNT(*) FILTER (WHERE outcome IN ({_PARTLY})) AS granted_in_part, "
    f"COUNT(*) FILTER (WHERE outcome IS NOT NULL AND outcome NOT IN ('granted', 'denied', {_PARTLY})) AS other "
    "FROM rulings WHERE motion_type IS NOT NULL GROUP BY judge_id, motion_type"
)
_RATE = "CASE WHEN granted + denied + granted_in_part = 0 THEN 0.0::DOUBLE ELSE granted::DOUBLE / (granted + denied + granted_in_part)::DOUBLE END"


# analytics


@query(over("rulings", query=f"SELECT *, {_RATE} AS grant_rate FROM ({_MOTIONS})"))
def judge_motion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03, A04."""
    return analytics.motion_stats(domain.rulings(spark, sf_dir), "judge_id")


@query(over("rulings", query="SELECT judge_id, COUNT(*) AS total_rulings FROM rulings GROUP BY judge_id"))
def judge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01."""
    return analytics.judge_totals(domain.rulings(spark, sf_dir)).select("judge_id", "total_rulings")


@query(over("rulings", query="SELECT judge_id, outcome, COUNT(*) AS n FROM rulings WHERE outcome IS NOT NULL GROUP BY ALL"))
def judge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02."""
    return analytics.judge_outcomes(domain.rulings(spark, sf_dir))


@query(over("rulings", query="SELECT judge_id, strftime(MIN(hearing_date), '%Y-%m-%d') AS earliest, strftime(MAX(hearing_date), '%Y-%m-%d') AS latest FROM rulings GROUP BY judge_id"))
def judge_date_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05."""
    spans = analytics.judge_totals(domain.rulings(spark, sf_dir))
    return spans.select("judge_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("earliest", "latest")])


@query(
    over(
        "judges", "rulings", more=f"m AS ({_MOTIONS})",
        query="SELECT j.id AS judge_id, j.canonical_name, (SELECT COUNT(*) FROM rulings r WHERE r.judge_id = j.id) AS total_rulings, "
        "coalesce((SELECT string_agg(outcome || '=' || n, ',' ORDER BY outcome) FROM (SELECT outcome, COUNT(*) AS n FROM rulings r WHERE r.judge_id = j.id AND outcome IS NOT NULL GROUP BY outcome)), '') AS outcomes, "
        "coalesce((SELECT string_agg(motion_type || '=' || total || '/' || granted || '/' || other, ',' ORDER BY total DESC, motion_type) FROM m WHERE m.judge_id = j.id), '') AS motions, "
        "(SELECT strftime(MIN(hearing_date), '%Y-%m-%d') FROM rulings r WHERE r.judge_id = j.id) AS earliest, "
        "(SELECT strftime(MAX(hearing_date), '%Y-%m-%d') FROM rulings r WHERE r.judge_id = j.id) AS latest FROM judges j",
    )
)
def judge_analytics_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06."""
    out = analytics.judge_analytics(domain.judges(spark, sf_dir), domain.rulings(spark, sf_dir))
    outcomes = F.array_join(F.transform("by_outcome", lambda x: F.concat_ws("=", x["outcome"], x["n"])), ",")
    motions = F.array_join(F.transform("by_motion_type", lambda x: F.concat(x["motion_type"], F.lit("="), F.concat_ws("/", x["total"], x["granted"], x["other"]))), ",")
    return out.select("judge_id", "canonical_name", "total_rulings", outcomes.alias("outcomes"), motions.alias("motions"), "earliest", "latest")


@query(
    "WITH days AS (SELECT CAST(unnest(generate_series(MIN(CAST(ts AS DATE)), MAX(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM events), "
    "runs AS (SELECT user_id AS source, CAST(ts AS DATE) AS day, COUNT(*) AS runs, COUNT(*) FILTER (WHERE value >= 10) AS successes FROM events GROUP BY ALL) "
    "SELECT source, day, coalesce(runs, 0) AS runs, coalesce(successes, 0) AS successes, coalesce(successes, 0) <= 0 AS breach "
    "FROM (SELECT DISTINCT user_id AS source FROM events) CROSS JOIN days LEFT JOIN runs USING (source, day)"
)
def health_daily_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a run, successful if its value is 10 or more; days without any alarm too."""
    events = read_table(spark, sf_dir, "events")
    runs = events.select(F.col("user_id").alias("source"), F.col("ts").alias("run_timestamp"), (F.col("value") >= 10).alias("success"))
    span = runs.agg(F.min(F.col("run_timestamp").cast("date")).alias("a"), F.max(F.col("run_timestamp").cast("date")).alias("b"))
    sources = runs.select("source").distinct()
    calendar = sources.join(F.broadcast(span)).select("source", F.explode(F.sequence("a", "b")).alias("day"))
    return analytics.daily_alarm(runs, calendar)


# lists and pages


def _stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    over("cases", query="SELECT id, case_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM cases WHERE case_status = 'O' ORDER BY cases.created_at DESC, id DESC LIMIT 21")
)
def cases_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of open cases and one row more."""
    open_cases = paging.equal_filters(domain.cases(spark, sf_dir), case_status="O", case_type="")
    return paging.page(open_cases, ["created_at", "id"], descending=True).rows.select("id", "case_type", _stamp("created_at"))


_MARK = ("1997-01-15 00:00:00", 3000)


@query(
    over(
        "cases",
        query=f"SELECT id, case_status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM cases WHERE (cases.created_at, id) < (TIMESTAMP '{_MARK[0]}', {_MARK[1]}) "
        "ORDER BY cases.created_at DESC, id DESC LIMIT 51",
    )
)
def cases_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 50 behind a cursor."""
    got = paging.page(domain.cases(spark, sf_dir), ["created_at", "id"], descending=True, first=50, after=paging.encode_cursor(list(_MARK)))
    return got.rows.select("id", "case_status", _stamp("created_at"))


@query(over("judges", query="SELECT id, canonical_name FROM judges WHERE (canonical_name, id) > ('Supplier#000000004', 4) ORDER BY canonical_name, id LIMIT 101"))
def judges_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascending, with a page size held to the largest."""
    got = paging.page(domain.judges(spark, sf_dir), ["canonical_name", "id"], descending=False, first=500, after=paging.encode_cursor(["Supplier#000000004", 4]))
    return got.rows.select("id", "canonical_name")


@query(over("rulings", "cases", "courts", query="SELECT outcome, COUNT(*) AS n FROM rulings JOIN cases ON cases.id = case_id JOIN courts ON courts.id = court_id WHERE county = 'NATION_3' GROUP BY outcome"))
def rulings_by_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a county's rulings."""
    found = relations.rulings_of_county(domain.rulings(spark, sf_dir), domain.cases(spark, sf_dir), domain.courts(spark, sf_dir), "NATION_3")
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    over(
        "rulings",
        query="SELECT case_id, judge_id, seq, CAST(hearing_date AS VARCHAR) AS hearing_date FROM rulings WHERE outcome = 'granted' AND judge_id = 3 "
        f"AND hearing_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND hearing_date <= DATE '{TODAY}'",
    )
)
def rulings_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters at once; both upper bounds hold."""
    rows = paging.equal_filters(domain.rulings(spark, sf_dir), outcome="granted", judge_id=3, motion_type=None)
    rows = paging.date_range(rows, "hearing_date", "1995-01-01", "1997-12-31", not_after=TODAY)
    return rows.select("case_id", "judge_id", "seq", F.col("hearing_date").cast("string").alias("hearing_date"))


@query(over("rulings", query=f"SELECT motion_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE hearing_date <= DATE '{TODAY}') AS shown FROM rulings GROUP BY motion_type"))
def rulings_exclude_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P04, T12."""
    shown = F.count_if(F.col("hearing_date") <= F.lit(TODAY).cast("date")).alias("shown")
    return domain.rulings(spark, sf_dir).groupBy("motion_type").agg(F.count(F.lit(1)).alias("n"), shown)


@query(over("rulings", query="SELECT case_id, judge_id, seq, CAST(hearing_date AS VARCHAR) AS hearing_date FROM rulings WHERE hearing_date >= DATE '1998-06-01' AND hearing_date <= DATE '1998-06-30'"))
def rulings_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P03."""
    rows = paging.date_range(domain.rulings(spark, sf_dir), "hearing_date", "1998-06-01", "1998-06-30")
    return rows.select("case_id", "judge_id", "seq", F.col("hearing_date").cast("string").alias("hearing_date"))


@query(over("cases", query="SELECT id, court_id, CAST(ceil(row_number() OVER (PARTITION BY court_id ORDER BY created_at DESC, id DESC) / 20.0) AS INTEGER) AS page_no FROM cases"))
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of every court at once."""
    rows = paging.all_pages(domain.cases(spark, sf_dir), ["court_id"], [F.col("created_at").desc(), F.col("id").desc()], 20)
    return rows.select("id", "court_id", "page_no")


@query(over("cases", query="SELECT DISTINCT ON (id) w.ordinal, w.id, cases.case_type FROM (SELECT unnest([5, 999999999, 1, 34]) AS id, unnest([0, 1, 2, 3]) AS ordinal) w LEFT JOIN cases USING (id)"))
def batched_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order asked for; what isn't there is null."""
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate([5, 999999999, 1, 34])], "ordinal int, id bigint")
    return relations.lookup(domain.cases(spark, sf_dir), wanted).select("ordinal", "id", "case_type")


# relations

_LINKS = "links AS (SELECT DISTINCT case_id, judge_id FROM rulings WHERE outcome = 'granted')"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges are linked to a case by what they granted; a case without such a ruling has no link."""
    return domain.rulings(spark, sf_dir).where("outcome = 'granted'").select("case_id", "judge_id").distinct()


@query(over("judges", "rulings", more=_LINKS, query="SELECT case_id, judge_id, canonical_name FROM links JOIN judges ON judges.id = judge_id"))
def case_judges_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J03."""
    judges = domain.judges(spark, sf_dir).select(F.col("id").alias("judge_id"), "canonical_name")
    return _links(spark, sf_dir).join(judges, "judge_id").select("case_id", "judge_id", "canonical_name")


@query(
    over(
        "rulings", more=_LINKS,
        query="SELECT case_id, judge_id FROM links UNION ALL SELECT DISTINCT case_id, judge_id FROM rulings WHERE case_id NOT IN (SELECT case_id FROM links) AND judge_id IS NOT NULL",
    )
)
def case_judges_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04, J05."""
    return relations.judges_of_cases(_links(spark, sf_dir), domain.rulings(spark, sf_dir))


@query(over("judges", "rulings", query="SELECT id, canonical_name FROM judges WHERE id IN (SELECT judge_id FROM rulings WHERE outcome = 'moot')"))
def judges_with_moot_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04, U01."""
    moot = domain.rulings(spark, sf_dir).where(F.col("outcome") == "moot")
    return relations.judges_with_rulings(domain.judges(spark, sf_dir), moot).select("id", "canonical_name")


@query(over("cases", "parties", query="SELECT cases.id AS case_id, party_id, name, party_type FROM cases JOIN parties ON parties.id = party_id"))
def case_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J06."""
    links = domain.cases(spark, sf_dir).select(F.col("id").alias("case_id"), "party_id")
    return relations.parties_of_cases(domain.parties(spark, sf_dir), links).select("case_id", "party_id", "name", "party_type")


@query(
    over(
        "cases", "parties",
        query="SELECT court_id AS case_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE party_type = 'BUILDING'), '') AS plaintiffs, "
        "coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE party_type = 'MACHINERY'), '') AS defendants, "
        "coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE party_type NOT IN ('BUILDING', 'MACHINERY')), '') AS others "
        "FROM (SELECT DISTINCT court_id, party_id FROM cases) JOIN parties ON parties.id = party_id GROUP BY court_id",
    )
)
def party_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parties of each court, by role."""
    links = domain.cases(spark, sf_dir).select(F.col("court_id").alias("case_id"), "party_id").distinct()
    rows = relations.parties_of_cases(domain.parties(spark, sf_dir), links)
    role = F.when(F.col("party_type") == "BUILDING", "Plaintiff").when(F.col("party_type") == "MACHINERY", "RESPONDENT").otherwise(F.col("party_type"))
    out = relations.party_groups(rows.withColumn("party_type", role))
    return out.select("case_id", *[F.array_join(c, ",").alias(c) for c in ("plaintiffs", "defendants", "others")])


@query(
    over(
        "rulings", "cases", "courts", "judges",
        query="SELECT case_id, seq, CAST(hearing_date AS VARCHAR) AS hearing_date, case_type, county, canonical_name FROM "
        "(SELECT * FROM rulings ORDER BY hearing_date DESC, case_id DESC, seq DESC LIMIT 50) r LEFT JOIN cases ON cases.id = case_id "
        "LEFT JOIN courts ON courts.id = cases.court_id LEFT JOIN judges ON judges.id = judge_id",
    )
)
def ruling_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, J12, J16, O03."""
    rows = relations.ruling_feed(domain.rulings(spark, sf_dir), domain.cases(spark, sf_dir), domain.courts(spark, sf_dir), domain.judges(spark, sf_dir), 50)
    return rows.select("case_id", "seq", F.col("hearing_date").cast("string").alias("hearing_date"), "case_type", "county", "canonical_name")


@query(
    over(
        "cases", "rulings", "courts",
        query="SELECT cases.id AS case_id, county, COUNT(DISTINCT judge_id) AS n_judges, COUNT(seq) AS n_rulings FROM cases JOIN courts ON courts.id = court_id "
        "LEFT JOIN rulings ON case_id = cases.id GROUP BY cases.id, county",
    )
)
def case_detail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a case's page shows; cases without rulings too."""
    counts = domain.rulings(spark, sf_dir).groupBy("case_id").agg(F.countDistinct("judge_id").alias("n_judges"), F.count(F.lit(1)).alias("n_rulings"))
    out = domain.cases(spark, sf_dir).select(F.col("id").alias("case_id"), "court_id")
    out = out.join(domain.courts(spark, sf_dir).select(F.col("id").alias("court_id"), "county"), "court_id").join(counts, "case_id", "left")
    return out.select("case_id", "county", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_judges", "n_rulings")])


@query("SELECT o_orderkey AS document_id, coalesce(CAST(m AS VARCHAR), CAST(o_orderkey AS VARCHAR)) AS ruling_id FROM orders LEFT JOIN (SELECT l_orderkey, MAX(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def hit_ruling_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, P23."""
    hits = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    rulings = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("bigint").alias("ruling_id"))
    return relations.ruling_ids_of_hits(hits, rulings).select("document_id", F.col("ruling_id").cast("string").alias("ruling_id"))


@query(over("cases", "rulings", query="SELECT id FROM cases WHERE NOT EXISTS (SELECT 1 FROM rulings WHERE case_id = cases.id)"))
def cases_without_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J09, P11."""
    return merge.delete_keys(domain.cases(spark, sf_dir), domain.rulings(spark, sf_dir).select(F.col("case_id").alias("id")), ["id"]).select("id")


@query("SELECT s_nationkey AS court_id, arg_min(s_name, s_suppkey) AS canonical_name, CAST(MIN(s_suppkey) AS BIGINT) AS position FROM supplier GROUP BY 1")
def first_judge_per_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first by position wins."""
    judges = domain.judges(spark, sf_dir).withColumnRenamed("id", "position")
    return relations.first_by_position(judges, "court_id", "position", "canonical_name")


# classifiers: sentences are put together from columns, in Spark and in SQL alike

_SENTENCES = [
    "The motion for summary judgment is GRANTED.", "Demurrer: denied in  part, granted in part.", "Motion to compel is Denied as moot", "OFF CALENDAR. Petition for writ of mandate",
    "Motion for partial summary judgment continued", "ex parte application submitted", "The petition is grantedly odd", "anti-SLAPP motion", "Order to show cause: off-calendar", "nothing here",
    "Motion to set aside the default granted", "MOTION FOR ATTORNEYS FEES",
]
_SENTENCE_SQL = "[" + ", ".join("'" + s + "'" for s in _SENTENCES) + f"][CAST((l_partkey + l_linenumber) % {len(_SENTENCES)} AS INTEGER) + 1] || ' (' || l_returnflag || ')'"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    pick = F.element_at(F.array(*[F.lit(s) for s in _SENTENCES]), ((F.col("l_partkey") + F.col("l_linenumber")) % len(_SENTENCES) + 1).cast("int"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(pick, F.lit(" ("), F.col("l_returnflag"), F.lit(")")).alias("text"))


@query(f"SELECT l_orderkey, l_linenumber, {first_match('t', classify.OUTCOMES)} AS outcome FROM (SELECT l_orderkey, l_linenumber, {_SENTENCE_SQL} AS t FROM lineitem)")
def classify_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1."""
    return _sentences(spark, sf_dir).select("l_orderkey", "l_linenumber", classify.outcome(F.col("text")).alias("outcome"))


@query(f"SELECT l_orderkey, l_linenumber, {first_match('t', classify.MOTION_TYPES)} AS motion_type FROM (SELECT l_orderkey, l_linenumber, {_SENTENCE_SQL} AS t FROM lineitem)")
def classify_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2."""
    return _sentences(spark, sf_dir).select("l_orderkey", "l_linenumber", classify.motion_type(F.col("text")).alias("motion_type"))


@query(
    "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN regexp_extract(s_name, '[^#]+') || ' Ann ' || s_suppkey WHEN 1 THEN 'JOE ' || s_suppkey WHEN 2 THEN 'Lee ' || s_suppkey ELSE NULL END AS judge_name FROM supplier"
)
def judge_name_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 over headings of four kinds."""
    n = F.col("s_suppkey").cast("string")
    family = F.regexp_extract("s_name", "[^#]+", 0)
    heading = (
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Hearing\n"), family, F.lit("  Ann "), n, F.lit(" JUDGE OF THE SUPERIOR COURT\nrest")))
        .when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("BEFORE THE HONORABLE  JOE  "), n, F.lit("\nDepartment 3")))
        .when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("Department S22- Judge Lee "), n)).otherwise(F.lit("The judge ruled."))
    )
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", classify.judge_name(heading).alias("judge_name"))


@query(
    "SELECT c_custkey, 'Mary ' || upper(substr(w, 1, 1)) || lower(substr(w, 2)) || '-' || upper(substr(w, 1, 1)) || lower(substr(w, 2)) || ' O''' || upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS judge_name "
    "FROM (SELECT c_custkey, c_mktsegment AS w FROM customer)"
)
def normalize_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family name first, in capitals, with hyphen and apostrophe."""
    w = F.col("c_mktsegment")
    raw = F.concat(F.lit("  o'"), w, F.lit(",   MARY  "), w, F.lit("-"), w)
    return read_table(spark, sf_dir, "customer").select("c_custkey", keys.normalize_judge(raw).alias("judge_name"))


_NUMBERED = "'No. ' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || ' and 24CV' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || ', 24CV' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '; CVPS' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')"


@query(
    "SELECT o_orderkey, array_to_string(list_distinct(regexp_extract_all(t, '\\b\\d{2,4}-\\d{8}\\b')), ',') AS oc_civil, "
    "regexp_extract(t, '\\b\\d{2}CV\\d{6}\\b') AS santa_clara, len(regexp_extract_all(t, '\\bCV[A-Z]{2,4}\\d{6,8}\\b')) AS n_riverside "
    f"FROM (SELECT o_orderkey, {_NUMBERED} AS t FROM orders)"
)
def case_number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R04 to R11, A13."""
    eight, six, seven = (F.lpad(F.col("o_orderkey").cast("string"), n, "0") for n in (8, 6, 7))
    t = F.concat(F.lit("No. "), F.lpad(F.col("o_custkey").cast("string"), 4, "0"), F.lit("-"), eight, F.lit(" and 24CV"), six, F.lit(", 24CV"), six, F.lit("; CVPS"), seven)
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    number = lambda s: courts.case_numbers(F.col("t"), s)
    return rows.select("o_orderkey", F.array_join(number("oc_civil"), ",").alias("oc_civil"), F.try_element_at(number("santa_clara"), F.lit(1)).alias("santa_clara"), F.size(number("riverside")).cast("long").alias("n_riverside"))


@query(
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS long_date, CAST(o_orderdate AS DATE) AS bare_date, CAST(o_orderdate AS DATE) AS short_date, CAST(o_orderdate AS DATE) AS iso_date, CAST(NULL AS DATE) AS bad_date FROM orders"
)
def multi_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each date written five ways and read back."""
    d = F.col("o_orderdate")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", keys.parse_long_date(F.date_format(d, "MMMM  d, yyyy")).alias("long_date"), keys.parse_long_date(F.date_format(d, "MMMM d yyyy")).alias("bare_date"),
        keys.parse_short_date(F.date_format(d, "MM/dd/yy")).alias("short_date"), keys.parse_date(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).alias("iso_date"),
        keys.parse_long_date(F.concat(F.lit("Smarch 40, "), F.date_format(d, "yyyy"))).alias("bad_date"),
    )


_DEPT = "['CX101', 'cm7', 'N12', 'W1', 'C20'][CAST(c_custkey % 5 AS INTEGER) + 1]"


@query(
    f"SELECT c_custkey, CASE WHEN upper({_DEPT}) LIKE 'CX%' THEN 'Complex Civil Department' WHEN upper({_DEPT}) LIKE 'CM%' THEN 'Costa Mesa Justice Center' WHEN {_DEPT} LIKE 'N%' THEN 'North Justice Center' "
    f"WHEN {_DEPT} LIKE 'W%' THEN 'West Justice Center' ELSE 'Central Justice Center' END AS oc_civil, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'Hall of Justice' WHEN c_custkey % 3 = 1 THEN 'Moreno Valley Courthouse' END AS riverside FROM customer"
)
def courthouse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes in order; departments of numbers; others null."""
    dept = F.element_at(F.array(*[F.lit(x) for x in ("CX101", "cm7", "N12", "W1", "C20")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(x) for x in ("07", "MV3", "X9")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", courts.courthouse("oc_civil", dept).alias("oc_civil"), courts.courthouse("riverside", other).alias("riverside"))


@query("SELECT o_orderkey, 'Order' || o_orderkey || ' Ltd. v. Customer ' || o_custkey AS case_title FROM orders")
def case_title_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4b."""
    t = F.concat(F.lit("intro\nCASE NAME:  Order"), F.col("o_orderkey"), F.lit("  Ltd. v. Customer "), F.col("o_custkey"), F.lit(".,; \nCASE NUMBER: 1"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", titles.title_from_field(t).alias("case_title"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'Acme' || o_orderkey || ' v. Jane Doe' || o_custkey END AS case_title FROM orders")
def case_title_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4c, E4d: without an opponent there is no title."""
    other = F.when(F.col("o_custkey") % 5 == 0, F.lit("Unopposed")).otherwise(F.concat(F.lit("Plaintiffs JANE DOE"), F.col("o_custkey"), F.lit(", et al")))
    t = F.concat(F.lit("MOVING PARTY: Defendant ACME"), F.col("o_orderkey"), F.lit(", an individual\nRESPONDING PARTY: "), other)
    return read_table(spark, sf_dir, "orders").select("o_orderkey", titles.title_from_parties(t).alias("case_title"))


@query("SELECT o_orderkey, 'Order' || o_orderkey || ' Trading v. City Of ' || o_custkey AS case_title FROM orders")
def case_title_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4a."""
    t = F.concat(F.lit("SUPERIOR COURT OF CALIFORNIA\nCOUNTY OF X\n\nORDER"), F.col("o_orderkey"), F.lit(" TRADING,\n   Plaintiff,\n  vs.\n CITY OF "), F.col("o_custkey"), F.lit(", et al.,\n  Defendants.\nThe motion"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", titles.case_title(t).alias("case_title"))


# cleanup, display and keys


@query("SELECT o_orderkey, 'Ruling ' || o_orderkey || chr(10) || chr(10) || chr(10) || 'It''s final' AS cleaned FROM orders")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C01 to C05."""
    n = F.col("o_orderkey")
    raw = F.concat(F.lit("SUPERIOR COURT OF CALIFORNIA\n\nRuling "), n, F.lit("   \n\n\n\n\n- 3 -\n Page 2 of 5 \nCounty of Kern\nIt¿s final\t\n12\nDept. 4\nunless the clerk notifies all\n\n"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", text.clean_ruling_text(raw).alias("cleaned"))


@query("SELECT c_custkey, '“' || c_name || '” § 5 – it''s  a' AS mended FROM customer")
def fix_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C01."""
    raw = F.concat(F.lit("â\u0080\u009c"), F.col("c_name"), F.lit("â\u0080\u009d Â§ 5 â\u0080\u0093 it¿s  a"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", text.fix_encoding(raw).alias("mended"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 999 THEN 'a' || chr(10) || 'b' ELSE 'a' || chr(10) || p_size || chr(10) || 'b' END AS stripped FROM part")
def strip_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C02."""
    raw = F.concat(F.lit("a\n"), F.col("p_size"), F.lit("\nb"))
    return read_table(spark, sf_dir, "part").select("p_partkey", text.strip_page_numbers(raw).alias("stripped"))


_LABEL_CODES = ["granted_in_part", "off_calendar", "motion_to_set_aside_default", "anti_slapp", "msj"]
_LABELS = {
    "outcome_label": ["Granted In Part", "Off Calendar", "Motion To Set Aside Default", "Anti Slapp", "Msj"],
    "motion_label": ["Granted in Part", "Off Calendar", "Motion to Set Aside Default", "Anti-SLAPP", "MSJ"],
    "plain_label": ["Granted In Part", "Off Calendar", "Motion To Set Aside Default", "Anti Slapp", "MSJ"],
}


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%b ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS day_label, "
    + ", ".join(f"CASE WHEN o_custkey % 6 = 5 THEN '{n}' ELSE {v}[CAST(o_custkey % 6 AS INTEGER) + 1] END AS {k}" for (k, v), n in zip(_LABELS.items(), ("Not classified", "Not classified", "—")))
    + " FROM orders"
)
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C08 to C11."""
    code = F.try_element_at(F.array(*[F.lit(x) for x in _LABEL_CODES]), (F.col("o_custkey") % 6 + 1).cast("int"))
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", display.format_date(F.col("o_orderdate")).alias("day_label"), display.format_outcome(code).alias("outcome_label"),
        display.format_motion_type(code).alias("motion_label"), display.format_label(code).alias("plain_label"),
    )


@query(
    "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN strpos(reverse(substr(text, 1, 80)), ' ') > 0 AND 80 - strpos(reverse(substr(text, 1, 80)), ' ') > 40 "
    "THEN substr(text, 1, 80 - strpos(reverse(substr(text, 1, 80)), ' ')) || '…' ELSE substr(text, 1, 80) || '…' END AS short FROM documents"
)
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C07."""
    return read_table(spark, sf_dir, "documents").select("doc_id", text.truncate_text(F.col("text"), 80).alias("short"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(text) <> sha256(lang) AS changed FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14, C15."""
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").select("doc_id", keys.content_hash(t).alias("content_hash"), keys.content_changed(t, keys.content_hash(F.col("lang"))).alias("changed"))


@query(
    "SELECT o_orderkey, 'ca/los_angeles/superior_court/raw/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || o_orderkey || CASE o_orderstatus WHEN 'F' THEN '.html' WHEN 'O' THEN '.txt' ELSE '.bin' END AS archive_key, "
    "'ca-los-angeles' AS court_code, 'ab' || o_orderkey AS case_key FROM orders"
)
def archive_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16 and derived keys."""
    kind = F.when(F.col("o_orderstatus") == "F", "html").when(F.col("o_orderstatus") == "O", "text").otherwise("odd")
    ca, la, court = F.lit("CA"), F.lit("Los Angeles"), F.lit("Superior Court")
    n = F.col("o_orderkey").cast("string")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", keys.archive_key(ca, la, court, F.col("o_orderdate"), n, kind).alias("archive_key"), keys.court_code(ca, la).alias("court_code"), keys.case_key(F.concat(F.lit(" A-B "), n)).alias("case_key")
    )


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'q=' || lang || '&outcome=granted%2Cmoot' ELSE 'q=' || lang END AS address, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_outcomes, lang AS q FROM documents")
def search_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build and read back."""
    docs = read_table(spark, sf_dir, "documents")
    address = display.search_address(q=F.col("lang"), county=F.lit(""), outcome=F.when(F.col("doc_id") % 2 == 0, "granted,moot"))
    docs = docs.select("doc_id", address.alias("address"))
    state = display.search_state(F.col("address"))
    return docs.select("doc_id", "address", F.size(state["outcome"]).alias("n_outcomes"), state["q"].alias("q"))


# load and merge

_SEQ = "lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(l_partkey AS VARCHAR), 9, '0')"


def _case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of events about the cases of suppliers: titles that are null two times in three."""
    line = read_table(spark, sf_dir, "lineitem")
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    title = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("T"), F.col("l_orderkey").cast("string")))
    return line.select(F.col("l_suppkey").alias("case_id"), F.concat(pad("l_orderkey", 12), pad("l_linenumber", 3), pad("l_partkey", 9)).alias("seq"), title.alias("title"), F.col("l_orderkey").alias("last_event"))


_CASE_EVENTS = f"SELECT l_suppkey AS case_id, {_SEQ} AS seq, CASE WHEN l_orderkey % 3 = 0 THEN 'T' || l_orderkey END AS title, l_orderkey AS last_event FROM lineitem"


@query(
    f"WITH e AS ({_CASE_EVENTS}), n AS (SELECT case_id, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title, arg_max(last_event, seq) AS last_event FROM e GROUP BY case_id), "
    "t AS (SELECT s_suppkey AS case_id, 'old' AS title, -1 AS last_event FROM supplier WHERE s_acctbal >= 0) "
    "SELECT case_id, coalesce(n.title, t.title) AS title, coalesce(n.last_event, t.last_event) AS last_event FROM t FULL JOIN n USING (case_id)"
)
def upsert_case_last_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last title that isn't null, over the old one; the target has the suppliers out of debt."""
    target = read_table(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    target = target.select(F.col("s_suppkey").alias("case_id"), F.lit("old").alias("title"), F.lit(-1).cast("bigint").alias("last_event"))
    return merge.upsert(target, _case_events(spark, sf_dir), ["case_id"], overwrite=["last_event"], fill=["title"])


@query(
    "SELECT s_name AS raw_name, s_nationkey AS court_id, CASE WHEN s_nationkey < 8 THEN CAST(s_suppkey AS VARCHAR) ELSE sha256(s_nationkey || '|' || s_name) END AS judge_id, s_nationkey >= 8 AS is_new FROM supplier"
)
def resolve_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of some courts are known; each comes twice."""
    judges = domain.judges(spark, sf_dir)
    aliases = judges.where("court_id < 8").select(F.col("canonical_name").alias("raw_name"), "court_id", F.col("id").alias("judge_id"))
    names = judges.select(F.col("canonical_name").alias("raw_name"), "court_id")
    return merge.resolve_judges(aliases, names.unionAll(names))


@query(f"WITH e AS ({_CASE_EVENTS}) SELECT case_id, MIN(seq) AS seq, arg_min(last_event, seq) AS last_event FROM e WHERE case_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY case_id")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt are there already; of the rest the first event counts."""
    target = read_table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("case_id"))
    return merge.insert_absent(target, _case_events(spark, sf_dir).drop("title"), ["case_id"])


@query(
    over(
        "rulings",
        query="SELECT case_id, CAST(hearing_date AS VARCHAR) AS hearing_date, motion_type AS ruling_text FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY hearing_date DESC, seq DESC, motion_type DESC) AS k "
        "FROM rulings WHERE outcome IS NOT NULL) WHERE k = 1",
    )
)
def latest_text_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings without an outcome have no text here."""
    rows = domain.rulings(spark, sf_dir).withColumn("ruling_text", F.when(F.col("outcome").isNotNull(), F.col("motion_type")))
    found = relations.latest_text(rows)
    return found.select("case_id", F.col("hearing_date").cast("string").alias("hearing_date"), "ruling_text")


@query(
    f"SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'R' THEN 'kept' END, {first_match('t', classify.OUTCOMES)}) AS outcome, {first_match('t', classify.MOTION_TYPES)} AS motion_type "
    f"FROM (SELECT l_orderkey, l_linenumber, l_returnflag, {_SENTENCE_SQL} AS t FROM lineitem)"
)
def backfill_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there stays; what is null comes from the text.  All rows in one pass."""
    t, key = F.col("text"), ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = _sentences(spark, sf_dir)
    target = rows.select(*key, F.when(t.endswith("(R)"), "kept").alias("outcome"), F.lit(None).cast("string").alias("motion_type"))
    values = rows.select(*key, classify.outcome(t).alias("outcome"), classify.motion_type(t).alias("motion_type")).dropDuplicates(key)
    return merge.fill_nulls(target, values, key, ["outcome", "motion_type"]).drop("l_partkey")


@query(
    "SELECT doc_id, source, version, previous_version_id FROM (SELECT doc_id, source, row_number() OVER w AS version, lag(doc_id) OVER w AS previous_version_id FROM "
    "(SELECT doc_id, source, lang, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) WHERE b IS NULL OR b <> lang WINDOW w AS (PARTITION BY source ORDER BY doc_id))"
)
def content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's captures in order; a run of equal content is one version."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("captured_at"), "source", F.col("lang").alias("content_hash"))
    return merge.content_versions(docs, ["source"]).select(F.col("document_id").alias("doc_id"), "source", "version", "previous_version_id")


@query("SELECT sha256(text) AS content_hash, MIN(doc_id) AS doc_id, COUNT(*) AS captures FROM documents GROUP BY 1")
def dedupe_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T08."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", keys.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("captures"))


@query(over("rulings", "cases", query="SELECT COUNT(*) AS orphans FROM rulings WHERE case_id NOT IN (SELECT id FROM cases WHERE case_status <> 'P')"))
def foreign_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings whose case isn't there (pending ones count as gone)."""
    gone = relations.orphans(domain.rulings(spark, sf_dir), domain.cases(spark, sf_dir).where("case_status <> 'P'"), "case_id")
    return gone.agg(F.count(F.lit(1)).alias("orphans"))


# search

_TOKENS = "tokens AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + "))) AS term FROM documents)"
_BM25 = (
    _TOKENS + ", tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM tokens GROUP BY ALL), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term), "
    "dl AS (SELECT d.doc_id, COUNT(t.doc_id) AS dl FROM documents d LEFT JOIN tokens t ON t.doc_id = d.doc_id GROUP BY d.doc_id), s AS (SELECT COUNT(*) AS n, AVG(dl) AS avgdl FROM dl), "
    "hits AS (SELECT doc_id, round(SUM(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score, COUNT(*) AS k "
    "FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN s WHERE term IN ('thing', 'reou') GROUP BY doc_id HAVING COUNT(*) = 2)"
)


def _index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> search.SearchIndex:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", "lang", "source", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("hearing_date"))
    return search.build_index(docs, "text", stemmed)


@query(f"WITH {_BM25} SELECT doc_id, score FROM hits")
def search_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with both words, and its score."""
    index = _index(spark, sf_dir)
    found = search.match_all_terms(index, search.analyze_query(index, "the Thing, reou"))
    return found.select(F.col("document_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    f"WITH {_BM25} SELECT doc_id, score, source FROM hits JOIN documents USING (doc_id) WHERE lang = 'en' AND DATE '1996-01-01' + CAST(doc_id % 365 AS INTEGER) <= DATE '{TODAY}' "
    "ORDER BY score DESC, DATE '1996-01-01' + CAST(doc_id % 365 AS INTEGER) DESC, doc_id DESC LIMIT 21"
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered page of hits; frequencies are those of all documents."""
    index = _index(spark, sf_dir)
    index.docs = index.docs.withColumn("court", F.col("lang"))
    got, _ = search.search(index, "thing reou", court="en", today=TODAY, text="text")
    return got.rows.select(F.col("document_id").alias("doc_id"), F.round("score", 6).alias("score"), "source")


@query(f"WITH {_BM25} SELECT lang, COUNT(*) AS hits FROM hits JOIN documents USING (doc_id) GROUP BY lang")
def search_total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all matches, by language."""
    index = _index(spark, sf_dir)
    _, matches = search.search(index, "thing reou", include_future=True, text="text")
    return matches.groupBy("lang").agg(F.count(F.lit(1)).alias("hits"))


@query(f"WITH {_TOKENS} SELECT term, COUNT(DISTINCT doc_id) AS df FROM tokens GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies."""
    return _index(spark, sf_dir).terms.select("term", "df")


@query(
    "SELECT doc_id, source FROM documents WHERE source LIKE 'src1%' AND (DATE '1996-01-01' + CAST(doc_id % 365 AS INTEGER), doc_id) < (DATE '1996-05-01', 500) "
    "ORDER BY DATE '1996-01-01' + CAST(doc_id % 365 AS INTEGER) DESC, doc_id DESC LIMIT 31"
)
def search_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No query, a beginning as filter, a page behind a cursor."""
    index = _index(spark, sf_dir)
    index.docs = index.docs.withColumn("case_number", F.col("source"))
    got, _ = search.search(index, case_number="src1", include_future=True, first=30, after=paging.encode_cursor([0.0, "1996-05-01", 500]), text="text")
    return got.rows.select(F.col("document_id").alias("doc_id"), "source")


@query()
def search_stemmed_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed terms and a marked excerpt."""
    got, _ = search.search(_index(spark, sf_dir, stemmed=True), "things reou", include_future=True, text="text")
    return got.rows.select(F.col("document_id").alias("doc_id"), "score", "excerpt")


@query("SELECT 'lang' AS facet, lang AS value, COUNT(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, COUNT(*) FROM documents GROUP BY source")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D07."""
    return search.facets(read_table(spark, sf_dir, "documents"), "lang", "source")


# sources and streams


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages, each address once a page."""
    return files.page_links(read_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of all pages."""
    return read_table(spark, sf_dir, "pages").select("page_id", files.html_text("html").alias("text"))


@query(
    "SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"
)
def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON payload by schema; rows without the field are left out."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k int").alias("p"))
    return rows.where(F.col("p.k").isNotNull()).select("event_id", "user_id", "event_type", F.col("p.k").alias("k"))


@query(
    "WITH RECURSIVE w AS (SELECT user_id, MIN(ts) AS s FROM events GROUP BY user_id UNION ALL SELECT w.user_id, (SELECT MIN(e.ts) FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 15 MINUTE) "
    "FROM w WHERE w.s IS NOT NULL), n AS (SELECT e.event_id, e.user_id, MAX(w.s) AS s, e.ts FROM events e JOIN w ON w.user_id = e.user_id AND w.s <= e.ts GROUP BY ALL) "
    "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS INTEGER) AS attempt, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 2 AS ok FROM n"
)
def fixed_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each user in windows of 15 minutes from the first; two are allowed."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return health.number_attempts(rows, "user_id", "ts", "event_id", allowed=2).select("event_id", "user_id", "attempt", "ok")


@query(
    "WITH RECURSIVE w AS (SELECT event_type, MIN(ts) AS s FROM events GROUP BY event_type UNION ALL SELECT w.event_type, (SELECT MIN(e.ts) FROM events e WHERE e.event_type = w.event_type AND e.ts >= w.s + INTERVAL 1 DAY) "
    "FROM w WHERE w.s IS NOT NULL), n AS (SELECT e.event_id, e.event_type, w.s, e.ts FROM events e ASOF JOIN (SELECT * FROM w WHERE s IS NOT NULL) w ON w.event_type = e.event_type AND w.s <= e.ts) "
    "SELECT event_id, event_type, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS window_start, CAST(row_number() OVER o AS INTEGER) AS attempt, row_number() OVER o <= 100 AS ok FROM n WINDOW o AS (PARTITION BY event_type, s ORDER BY ts, event_id)"
)
def hot_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 for few keys of many attempts: each kind of event in windows of a day from the first, a hundred allowed; every
    key is split over tasks."""
    rows = read_table(spark, sf_dir, "events").where("event_type is not null and ts is not null").select("event_id", "event_type", "ts")
    out = health.split_attempts(rows, "event_type", "ts", "event_id", seconds=86_400, allowed=100)
    return out.select("event_id", "event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"), "attempt", "ok")


# declared by the model and computed here


@query(
    "SELECT source, day, n, round(n - mean, 6) AS off, n > mean + 2 * dev AS anomaly FROM (SELECT user_id % 10 AS source, CAST(ts AS DATE) AS day, COUNT(*) AS n, "
    "AVG(COUNT(*)) OVER w AS mean, coalesce(stddev_samp(COUNT(*)) OVER w, 0) AS dev FROM events GROUP BY 1, 2 WINDOW w AS (PARTITION BY user_id % 10 ORDER BY CAST(ts AS DATE) ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE mean IS NOT NULL"
)
def volume_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's events against the seven days before."""
    days = read_table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("source"), F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("day").rowsBetween(-7, -1)
    days = days.withColumn("mean", F.avg("n").over(before)).withColumn("dev", F.coalesce(F.stddev_samp("n").over(before), F.lit(0.0)))
    return days.where("mean is not null").select("source", "day", "n", F.round(F.col("n") - F.col("mean"), 6).alias("off"), (F.col("n") > F.col("mean") + 2 * F.col("dev")).alias("anomaly"))


@query(
    over(
        "rulings", "judges",
        query="SELECT judge_id, CAST(COUNT(*) AS BIGINT) AS alerts, MIN(case_id) AS first_case FROM rulings JOIN judges ON judges.id = judge_id WHERE (court_id < 12 AND outcome = 'granted') OR (court_id >= 12 AND motion_type IN (SELECT MIN(motion_type) FROM rulings)) GROUP BY judge_id",
    )
)
def alerts_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions to what a judge grants, or, in some courts, to their rulings on a motion type, and a digest for each."""
    rulings = domain.rulings(spark, sf_dir)
    least = rulings.agg(F.min("motion_type").alias("wanted"))
    subscriptions = domain.judges(spark, sf_dir).join(F.broadcast(least)).select(
        F.col("id").alias("judge_id"), F.when(F.col("court_id") < 12, "granted").alias("want_outcome"), F.when(F.col("court_id") >= 12, F.col("wanted")).alias("want_motion")
    )
    hit = (F.col("outcome") == F.col("want_outcome")) | (F.col("motion_type") == F.col("want_motion"))
    return rulings.join(subscriptions, "judge_id").where(hit).groupBy("judge_id").agg(F.count(F.lit(1)).alias("alerts"), F.min("case_id").alias("first_case"))


@query(over("cases", "courts", query="SELECT state, case_type, CAST(created_at AS DATE) AS day, COUNT(*) AS filings FROM cases JOIN courts ON courts.id = court_id GROUP BY ALL"))
def daily_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11."""
    rows = domain.cases(spark, sf_dir).join(domain.courts(spark, sf_dir).withColumnRenamed("id", "court_id"), "court_id")
    return rows.groupBy("state", "case_type", F.col("created_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("filings"))


@query(
    over("rulings", query=f"SELECT judge_id, motion_type, total, {_RATE} AS grant_rate, total < 120 AS provisional, rank() OVER (PARTITION BY motion_type ORDER BY {_RATE} DESC) AS place FROM ({_MOTIONS})")
)
def judge_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges ranked within a motion type, with the sample's size; few rulings are provisional."""
    stats = analytics.motion_stats(domain.rulings(spark, sf_dir), "judge_id")
    place = F.rank().over(W.partitionBy("motion_type").orderBy(F.col("grant_rate").desc()))
    return stats.select("judge_id", "motion_type", "total", "grant_rate", (F.col("total") < 120).alias("provisional"), place.cast("long").alias("place"))


@query(
    over(
        "rulings",
        query="SELECT judge_id, strftime(q, '%Y-%m-%d') AS period, rulings, granted, decided, span_decided, round(span_rate, 9) AS span_rate, round(span_rate - earlier, 9) AS change, span_decided < 30 AS provisional FROM ("
        "SELECT *, SUM(decided) OVER s AS span_decided, SUM(granted) OVER s / nullif(SUM(decided) OVER s, 0) AS span_rate, SUM(granted) OVER e / nullif(SUM(decided) OVER e, 0) AS earlier FROM ("
        "SELECT judge_id, date_trunc('quarter', hearing_date) AS q, COUNT(*) AS rulings, COUNT(*) FILTER (WHERE outcome = 'granted') AS granted, COUNT(*) FILTER (WHERE outcome IS NOT NULL AND outcome <> 'moot') AS decided FROM rulings "
        "WHERE hearing_date IS NOT NULL GROUP BY 1, 2) WINDOW s AS (PARTITION BY judge_id ORDER BY q RANGE BETWEEN INTERVAL 9 MONTH PRECEDING AND CURRENT ROW), "
        "e AS (PARTITION BY judge_id ORDER BY q RANGE BETWEEN INTERVAL 21 MONTH PRECEDING AND INTERVAL 12 MONTH PRECEDING))",
    )
)
def judge_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each judge's grant rate by quarter, over a year, and against the year before."""
    out = analytics.rate_trends(domain.rulings(spark, sf_dir), "judge_id")
    rounded = [F.round(c, 9).alias(c) for c in ("span_rate", "change")]
    return out.select("judge_id", F.date_format("period", "yyyy-MM-dd").alias("period"), "rulings", "granted", "decided", "span_decided", *rounded, "provisional")


_COUNSEL = (
    "SELECT level, firm, counsel, COUNT(*) AS cases, SUM(n) AS rulings, SUM(g) AS granted, SUM(d) AS denied, SUM(p) AS granted_in_part FROM ("
    "SELECT a.*, coalesce(n, 0) AS n, coalesce(g, 0) AS g, coalesce(d, 0) AS d, coalesce(p, 0) AS p FROM (SELECT 'counsel' AS level, case_id, firm, counsel FROM a UNION ALL SELECT DISTINCT 'firm', case_id, firm, NULL FROM a) a "
    "LEFT JOIN (SELECT case_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE outcome = 'granted') AS g, COUNT(*) FILTER (WHERE outcome = 'denied') AS d, "
    f"COUNT(*) FILTER (WHERE outcome IN ({_PARTLY})) AS p FROM rulings GROUP BY case_id) r ON r.case_id = a.case_id) GROUP BY ALL"
)


@query(
    over(
        "rulings", "cases", "parties", more="a AS (SELECT cases.id AS case_id, party_type AS firm, name AS counsel FROM cases JOIN parties ON parties.id = party_id)",
        query=f"SELECT level, firm, counsel, cases, CAST(rulings AS BIGINT) AS rulings, CAST(granted AS BIGINT) AS granted, round({_RATE}, 9) AS grant_rate, granted + denied + granted_in_part < 30 AS provisional FROM ({_COUNSEL})",
    )
)
def counsel_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attorneys and firms by cases, rulings and grant rate."""
    parties = domain.parties(spark, sf_dir).select(F.col("id").alias("party_id"), F.col("party_type").alias("firm"), F.col("name").alias("counsel"))
    appearances = domain.cases(spark, sf_dir).select(F.col("id").alias("case_id"), "party_id").join(parties, "party_id")
    out = analytics.counsel_stats(appearances, domain.rulings(spark, sf_dir))
    return out.select("level", "firm", "counsel", "cases", "rulings", "granted", F.round("grant_rate", 9).alias("grant_rate"), "provisional")


@query(
    "WITH t AS (SELECT l_orderkey AS case_id, l_linenumber AS line, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'granted' WHEN 'AO' THEN 'denied' WHEN 'NF' THEN 'granted_in_part' "
    "WHEN 'NO' THEN 'denied_in_part' WHEN 'RF' THEN 'moot' END AS o, CASE l_linenumber % 5 WHEN 1 THEN 'msj' WHEN 2 THEN 'demurrer' WHEN 3 THEN 'mtd' WHEN 4 THEN 'osc' ELSE 'other' END AS m, "
    "CAST(l_quantity AS INTEGER) AS q FROM lineitem) "
    "SELECT reason, coalesce(o, '') AS outcome, m AS motion_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE reason IS NOT NULL OR q < 34) AS reviews FROM (SELECT *, CASE WHEN q % 11 = 3 THEN 'malformed_json' "
    "WHEN o IS NULL THEN 'missing_key' WHEN m = 'osc' THEN 'bad_motion_type' WHEN q > 48 THEN 'bad_confidence' END AS reason FROM t) GROUP BY ALL"
)
def classifier_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of the lines of orders, counted by what is wrong with them and by what a person must look at."""
    line = read_table(spark, sf_dir, "lineitem")
    outcome = F.create_map(*[F.lit(x) for (a, b), v in domain.OUTCOME_OF.items() for x in (a + b, v)])[F.concat("l_returnflag", "l_linestatus")]
    motion = F.element_at(F.array(*map(F.lit, ("other", "msj", "demurrer", "mtd", "osc"))), F.col("l_linenumber") % 5 + 1)
    quantity = F.col("l_quantity").cast("int")
    confidence = F.when(quantity > 48, quantity / 10.0).otherwise((quantity * 2 + 2) / 100.0)
    told = F.to_json(F.struct(outcome.alias("outcome"), motion.alias("motion_type"), confidence.cast("double").alias("confidence")))
    rows = line.select(F.lit("text").alias("ruling_text"), F.when(quantity % 11 == 3, F.concat(told, F.lit(" !"))).otherwise(told).alias("reply"), outcome.alias("o"), motion.alias("m"))
    out = replies.read_replies(rows)
    return out.groupBy("reason", F.coalesce("o", F.lit("")).alias("outcome"), F.col("m").alias("motion_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_review").alias("reviews"))
