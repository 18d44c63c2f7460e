"""Registered queries of alerts and of changes between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import alerts, analytics, changes
from docketry.plans.queries import query
from docketry.plans.sql import over
from docketry.session import read_table, scratch_folder
from docketry.sources import domain

_ITEMS = "i AS (SELECT case_id || '-' || seq AS document_id, case_id, judge_id, party_id, county, outcome, motion_type FROM rulings JOIN cases ON cases.id = case_id JOIN courts ON courts.id = cases.court_id)"
_EVENTS = (
    "e AS (SELECT 'case-' || cases.id AS subscription_id, document_id FROM i JOIN cases ON cases.id = i.case_id WHERE case_status = 'P' UNION ALL "
    "SELECT 'judge-' || judge_id, document_id FROM i WHERE outcome = 'granted' AND judge_id IS NOT NULL UNION ALL "
    "SELECT 'word-' || county, document_id FROM i WHERE motion_type = 'PROMO' UNION ALL "
    "SELECT 'party-' || i.party_id, document_id FROM i JOIN parties ON parties.id = i.party_id WHERE party_type = 'BUILDING' AND outcome = 'moot')"
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four kinds of subscriptions say to all rulings."""
    cases, courts = domain.cases(spark, sf_dir), domain.courts(spark, sf_dir)
    of_case = cases.join(courts.select(F.col("id").alias("court_id"), "county"), "court_id").select(F.col("id").alias("case_id"), "court_id", "county", F.array(F.col("party_id").cast("string")).alias("party_ids"))
    rulings = domain.rulings(spark, sf_dir).join(of_case, "case_id")
    text = F.concat(F.lit("Motion of the kind "), "motion_type").alias("ruling_text")
    items = rulings.select(F.concat_ws("-", F.col("case_id").cast("string"), "seq").alias("document_id"), "case_id", "judge_id", "court_id", "county", "outcome", "motion_type", "party_ids", text, F.col("hearing_date").cast("timestamp").alias("captured_at"))

    def wants(rows: DataFrame, label: str, name: str, kind: str, **fields) -> DataFrame:
        filters = F.to_json(F.struct(*[(F.lit(v) if not isinstance(v, type(F.lit(0))) else v.cast("string")).alias(n) for n, v in fields.items()]))
        return rows.select(F.concat(F.lit(f"{label}-"), F.col(name).cast("string")).alias("id"), F.lit("u").alias("user_id"), F.lit(kind).alias("alert_type"), filters.alias("filters"), F.lit(True).alias("is_active"))

    subs = wants(cases.where("case_status = 'P'"), "case", "id", "case_docket", case_id=F.col("id"))
    subs = subs.unionAll(wants(domain.judges(spark, sf_dir), "judge", "id", "judge_ruling", judge_id=F.col("id"), outcome="granted"))
    subs = subs.unionAll(wants(courts, "word", "county", "keyword", keyword="promo motion", county=F.col("county")))
    subs = subs.unionAll(wants(domain.parties(spark, sf_dir).where("party_type = 'BUILDING'"), "party", "id", "party_attorney", party_id=F.col("id"), outcome="moot"))
    # words of kinds of motions, by parts: enough to tell a rare word from one that all have
    kinds = read_table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("term")).agg(F.count(F.lit(1)).alias("df"))
    return alerts.triggered(items, alerts.waiting(alerts.subscriptions(subs), kinds.unionAll(kinds.agg(F.lit("motion"), F.sum("df")))))


@query(over("rulings", "cases", "courts", "parties", more=f"{_ITEMS}, {_EVENTS}", query="SELECT subscription_id, CAST(COUNT(DISTINCT document_id) AS BIGINT) AS events, MIN(document_id) AS first_document FROM e GROUP BY 1"))
def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each subscription, recorded twice and sent once."""
    log = alerts.AlertLog(spark, scratch_folder(spark, "alerts"))
    log.record(_events(spark, sf_dir), 0)
    log.record(log.batch(0), 1)
    return log.digest(0).groupBy("subscription_id").agg(F.count(F.lit(1)).alias("events"), F.min("document_id").alias("first_document"))


_NEW = (
    "CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', '  ') || '--' WHEN 1 THEN replace(text, 'people', 'peeople') WHEN 2 THEN text || '. Order 17 amended' ELSE text END"
)
_BLOCKS = "list_filter(list_transform(regexp_split_to_array(lower(coalesce({0}, '')), '[\\n.;:!?]+'), lambda b: trim(regexp_replace(b, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda b: b <> '')"


@query(
    f"WITH v AS (SELECT doc_id, text AS a, {_NEW} AS b FROM documents), s AS (SELECT *, {_BLOCKS.format('a')} AS x, {_BLOCKS.format('b')} AS y FROM v), "
    "d AS (SELECT *, list_filter(list_distinct_ordered_x, lambda z: NOT list_contains(y, z)) AS gone, list_filter(list_distinct_ordered_y, lambda z: NOT list_contains(x, z)) AS fresh FROM "
    "(SELECT *, list_filter(x, lambda z, i: list_position(x, z) = i) AS list_distinct_ordered_x, list_filter(y, lambda z, i: list_position(y, z) = i) AS list_distinct_ordered_y FROM s)) "
    "SELECT doc_id, CASE WHEN a IS NOT DISTINCT FROM b THEN 'none' WHEN x = y THEN 'formatting' WHEN len(gone) = len(fresh) AND len(gone) > 0 AND len(x) = len(y) AND len(list_filter(range(1, len(gone) + 1), lambda i: levenshtein(gone[i], fresh[i]) * 10 > greatest(length(gone[i]), length(fresh[i])) "
    "OR regexp_replace(gone[i], '[^\\p{N}]', '', 'g') <> regexp_replace(fresh[i], '[^\\p{N}]', '', 'g'))) = 0 THEN 'typo' ELSE 'substantive' END AS change FROM d"
)
def text_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves with other spaces, with a slip, or with an addition."""
    n, text = F.col("doc_id") % 4, F.col("text")
    new = F.when(n == 0, F.concat(F.replace(text, F.lit(" "), F.lit("  ")), F.lit("--"))).when(n == 1, F.replace(text, F.lit("people"), F.lit("peeople"))).when(n == 2, F.concat(text, F.lit(". Order 17 amended"))).otherwise(text)
    return read_table(spark, sf_dir, "documents").select("doc_id", changes.change(text, new)["kind"].alias("change"))


@query(
    "WITH c AS (SELECT CAST(unnest(generate_series(MIN(CAST(ts AS DATE)), MAX(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM events), s AS (SELECT DISTINCT user_id % 5 AS source FROM events), "
    "n AS (SELECT user_id % 5 AS source, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT source, day, coalesce(n, 0) AS n FROM s CROSS JOIN c LEFT JOIN n USING (source, day)), "
    "m AS (SELECT *, AVG(n) OVER w AS mean, greatest(coalesce(stddev_samp(n) OVER w, 0), 1.0::DOUBLE) AS dev FROM d WINDOW w AS (PARTITION BY source, isodow(day) ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) "
    "SELECT source, day, n, round(mean, 6) AS mean, CASE WHEN n - mean > 2 * dev THEN 'spike' WHEN n - mean < -2 * dev THEN 'drop' END AS anomaly FROM m"
)
def weekday_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's days against the same weekday of four weeks before, days without events too."""
    events = read_table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("source"), F.col("ts").cast("date").alias("day"))
    span = events.agg(F.min("day").alias("a"), F.max("day").alias("b"))  # one row
    calendar = events.select("source").distinct().join(F.broadcast(span)).select("source", F.explode(F.sequence("a", "b")).alias("day"))
    days = calendar.join(events.groupBy("source", "day").agg(F.count(F.lit(1)).alias("n")), ["source", "day"], "left").select("source", "day", F.coalesce("n", F.lit(0)).alias("n"))
    found = analytics.weekday_anomalies(days)
    return found.select("source", "day", "n", F.round("mean", 6).alias("mean"), "anomaly")
