"""Registered queries over staged captures (D02): a document is a capture, its language its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.staging import Check, Staging, rule_counts
from docketry.plans.queries import query
from docketry.session import read_table, scratch_folder

_SCHEMA = "id string, scraper_id string, origin string, text string, day date"
_RULES = [
    Check("has_text", "text", "required"), Check("text_length", "text", "length", (200, 40000)), Check("no_address", "text", "not_matches", (r"[a-z0-9.]+@[a-z0-9]+",), "flag"),
    Check("begins_with_letter", "text", "matches", ("^[A-Za-z]",), "flag", "en"), Check("volume", "day", "daily_count", (None, 9), "flag"),
]
_CHECKED = (
    "c AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, source, text, CAST(doc_id % 30 AS INTEGER) AS day FROM documents), v AS (SELECT *, COUNT(*) OVER (PARTITION BY lang, day) AS n FROM c), "
    "b AS (SELECT *, text IS NULL OR trim(text) = '' AS r1, coalesce(length(text) < 200 OR length(text) > 40000, FALSE) AS r2, coalesce(regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+'), FALSE) AS r3, "
    "coalesce(lang = 'en' AND NOT regexp_matches(text, '^[A-Za-z]'), FALSE) AS r4, n > 9 AS r5 FROM v), "
    "s AS (SELECT *, CASE WHEN r1 OR r2 THEN 'failed' WHEN r3 OR r4 OR r5 THEN 'flagged' ELSE 'passed' END AS status FROM b)"
)


def _staging(spark: SparkSession, sf_dir: str) -> Staging:
    docs = read_table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    captures = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("scraper_id"), F.col("source").alias("origin"), "text", day.alias("day"))
    store = Staging(spark, scratch_folder(spark, "staging"), _SCHEMA)
    store.stage(captures, 0, _RULES)
    return store


@query(f"WITH {_CHECKED} SELECT 'has_text' AS rule, COUNT(*) FILTER (WHERE r1) AS broken FROM s UNION ALL SELECT 'text_length', COUNT(*) FILTER (WHERE r2) FROM s UNION ALL SELECT 'no_address', COUNT(*) FILTER (WHERE r3) FROM s UNION ALL SELECT 'begins_with_letter', COUNT(*) FILTER (WHERE r4) FROM s UNION ALL SELECT 'volume', COUNT(*) FILTER (WHERE r5) FROM s")
def staging_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule was broken."""
    return rule_counts(_staging(spark, sf_dir).staged(), _RULES).select("rule", "broken")


@query(
    f"WITH {_CHECKED} SELECT id, status, (status = 'passed' AND lang IN ('en', 'de')) OR (status <> 'failed' AND lang = 'fr') OR (status = 'failed' AND lang = 'en' AND NOT n > 9) AS promoted FROM s"
)
def staging_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two languages promote by themselves, a third by approval, and failed English captures come back corrected."""
    store = _staging(spark, sf_dir)
    first = store.staged()
    store.promote(0, ["en", "de"])
    store.review(first.where("scraper_id = 'fr'").select("id", F.col("batch").alias("staged_batch"), F.lit("approve").alias("decision"), F.lit("human").alias("reviewer")), 0)
    failed = first.where("scraper_id = 'en' and validation_status = 'failed' and not exists(validation_notes, n -> n.rule = 'volume')")
    store.stage(failed.select("id", "scraper_id", "origin", F.rpad(F.lit("Corrected "), 300, "x").alias("text"), F.date_add("day", 365).alias("day")), 1, [r for r in _RULES if r.name != "volume"])
    store.promote(1, ["en", "de"])
    promoted = store.promoted().select("id", F.lit(True).alias("promoted"))
    return first.select("id", F.col("validation_status").alias("status")).join(promoted, "id", "left").select("id", "status", F.coalesce("promoted", F.lit(False)).alias("promoted"))
