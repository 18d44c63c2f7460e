"""Judge analytics (A01 to A06): all judges at once, in one pass over the rulings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Outcomes that count as granted in part.
PARTLY = ("granted_in_part", "denied_in_part")


def grant_rate(granted: Column, denied: Column, partly: Column) -> Column:
    """Share of granted among decided motions; 0 if none is decided."""
    return F.coalesce(F.try_divide(granted.cast("double"), (granted + denied + partly).cast("double")), F.lit(0.0))


def judge_totals(rulings: DataFrame) -> DataFrame:
    """Number of rulings and span of hearing dates."""
    return rulings.groupBy("judge_id").agg(F.count(F.lit(1)).alias("total_rulings"), F.min("hearing_date").alias("earliest"), F.max("hearing_date").alias("latest"))


def judge_outcomes(rulings: DataFrame) -> DataFrame:
    """Rulings by outcome; those without one are left out."""
    return rulings.where(F.col("outcome").isNotNull()).groupBy("judge_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def motion_stats(rulings: DataFrame, *by: str) -> DataFrame:
    """Counts and grant rate by motion type; rulings without one are left out."""
    hit = lambda *values: F.count_if(F.col("outcome").isin(*values))
    known = ("granted", "denied", *PARTLY)
    out = rulings.where(F.col("motion_type").isNotNull()).groupBy(*by, "motion_type").agg(
        F.count(F.lit(1)).alias("total"), hit("granted").alias("granted"), hit("denied").alias("denied"), hit(*PARTLY).alias("granted_in_part"),
        F.count_if(~F.col("outcome").isin(*known) & F.col("outcome").isNotNull()).alias("other"),
    )
    return out.withColumn("grant_rate", grant_rate(F.col("granted"), F.col("denied"), F.col("granted_in_part")))


def judge_analytics(judges: DataFrame, rulings: DataFrame) -> DataFrame:
    """One record for each judge, with lists of outcomes and of motion types (largest first).

    Rulings are first counted by judge, motion type and outcome; all else comes from these counts.
    """
    cells = rulings.groupBy("judge_id", "motion_type", "outcome").agg(F.count(F.lit(1)).alias("n"), F.min("hearing_date").alias("earliest"), F.max("hearing_date").alias("latest"))
    some = lambda *values: F.sum(F.when(F.col("outcome").isin(*values), F.col("n")).otherwise(0))
    known = ("granted", "denied", *PARTLY)
    motions = cells.where(F.col("motion_type").isNotNull()).groupBy("judge_id", "motion_type").agg(
        F.sum("n").alias("total"), some("granted").alias("granted"), some("denied").alias("denied"), some(*PARTLY).alias("granted_in_part"),
        F.sum(F.when(F.col("outcome").isNotNull() & ~F.col("outcome").isin(*known), F.col("n")).otherwise(0)).alias("other"),
    ).withColumn("grant_rate", grant_rate(F.col("granted"), F.col("denied"), F.col("granted_in_part")))
    fields = ("motion_type", "total", "granted", "denied", "granted_in_part", "other", "grant_rate")
    listed = motions.groupBy("judge_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("order"), *fields))).alias("m"))
    listed = listed.select("judge_id", F.transform("m", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("by_motion_type"))
    outcomes = cells.where(F.col("outcome").isNotNull()).groupBy("judge_id", "outcome").agg(F.sum("n").alias("n"))
    outcomes = outcomes.groupBy("judge_id").agg(F.array_sort(F.collect_list(F.struct("outcome", "n"))).alias("by_outcome"))
    totals = cells.groupBy("judge_id").agg(F.sum("n").alias("total_rulings"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))
    out = judges.select(F.col("id").alias("judge_id"), "canonical_name")
    for part in (totals, outcomes, listed):
        out = out.join(part, "judge_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(
        "judge_id", "canonical_name", F.coalesce("total_rulings", F.lit(0)).alias("total_rulings"), empty("by_outcome"), empty("by_motion_type"),
        F.date_format("earliest", "yyyy-MM-dd").alias("earliest"), F.date_format("latest", "yyyy-MM-dd").alias("latest"),
    )


def daily_alarm(runs: DataFrame, calendar: DataFrame) -> DataFrame:
    """For each source and day of ``calendar (source, day)``, whether no run succeeded; no runs count as none."""
    seen = runs.groupBy("source", F.col("run_timestamp").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("successes"))
    out = calendar.join(seen, ["source", "day"], "left")
    runs_, ok = F.coalesce("runs", F.lit(0)), F.coalesce("successes", F.lit(0))
    return out.select("source", "day", runs_.alias("runs"), ok.alias("successes"), (ok <= 0).alias("breach"))


def health_scores(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``score`` from 0 to 1, the weighted mean of the named shares that a source has (null ones don't count),
    and ``place``, 1 for the unhealthiest."""
    given = [F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(0.0) for n, w in weights.items()]
    gained = [F.coalesce(F.col(n), F.lit(0.0)) * w for n, w in weights.items()]
    total = lambda columns: reduce(Column.__add__, columns)
    scored = parts.withColumn("score", F.try_divide(total(gained), total(given)))
    return scored.withColumn("place", F.rank().over(W.orderBy(F.col("score").asc_nulls_first())))


def run_health(events: DataFrame) -> DataFrame:
    """Runs, successes, captured records of successful runs and mean response time by source."""
    captured = F.sum(F.when(F.col("success"), F.col("records_captured")).otherwise(0))
    return events.groupBy("scraper_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("successes"), captured.alias("records"), F.avg("response_time_seconds").alias("seconds"), F.max("run_timestamp").alias("last_run")
    )


def weekday_anomalies(days: DataFrame, before: int = 4, deviations: float = 2.0, least: float = 1.0) -> DataFrame:
    """``source, day, n`` (a row a source and day, days without captures too) with the ``mean`` and ``dev`` of the
    same weekday in the ``before`` weeks that came first, and ``anomaly``: ``drop``, ``spike`` or null.

    Courts publish by weekday, so a Monday is held against Mondays; ``dev`` is at least ``least``, so that a steady
    source isn't odd for one capture more.  Days without a week before them are neither.
    """
    same = W.partitionBy("source", F.weekday("day")).orderBy("day").rowsBetween(-before, -1)
    out = days.withColumn("mean", F.avg("n").over(same)).withColumn("dev", F.greatest(F.coalesce(F.stddev_samp("n").over(same), F.lit(0.0)), F.lit(least)))
    off = F.col("n") - F.col("mean")
    kind = F.when(off > deviations * F.col("dev"), "spike").when(off < -deviations * F.col("dev"), "drop")
    return out.withColumn("anomaly", kind)


def rate_trends(rulings: DataFrame, *by: str, months: int = 3, steps: int = 4, least: int = 30) -> DataFrame:
    """Grant rates over time, a row for each group of ``by`` and period of ``months`` with a ruling in it.

    ``span_rate`` covers the last ``steps`` periods by the calendar, and ``change`` is how far it is from the ``steps``
    periods before those (null if nothing was decided then); ``provisional``: fewer than ``least`` decided motions.
    Rulings are counted by group and period first, so a window holds a group's periods and not its rulings.
    Rulings without a date are left out.
    """
    hit = lambda *values: F.count_if(F.col("outcome").isin(*values))
    number = F.floor((F.year("hearing_date") * 12 + F.month("hearing_date") - 1) / months).alias("__period")
    cells = rulings.where(F.col("hearing_date").isNotNull()).groupBy(*by, number).agg(
        F.count(F.lit(1)).alias("rulings"), hit("granted").alias("granted"), hit("granted", "denied", *PARTLY).alias("decided")
    )
    ordered = W.partitionBy(*by).orderBy("__period")
    span, earlier = ordered.rangeBetween(1 - steps, 0), ordered.rangeBetween(1 - 2 * steps, -steps)
    rate = lambda w: F.try_divide(F.sum("granted").over(w).cast("double"), F.sum("decided").over(w).cast("double"))
    out = cells.withColumns({"span_decided": F.sum("decided").over(span), "span_rate": rate(span), "__earlier": rate(earlier)})
    first = F.col("__period") * months
    period = F.make_date(F.floor(first / 12).cast("int"), (first % 12 + 1).cast("int"), F.lit(1)).alias("period")
    return out.select(
        *by, period, "rulings", "granted", "decided", "span_decided", "span_rate", (F.col("span_rate") - F.col("__earlier")).alias("change"),
        (F.col("span_decided") < least).alias("provisional"),
    )


def counsel_stats(appearances: DataFrame, rulings: DataFrame, least: int = 30) -> DataFrame:
    """Cases, rulings and grant rate of each attorney and, with a null ``counsel``, of each firm.

    ``appearances (case_id, firm, counsel)``: a case counts once for an attorney however often it is listed, and once for
    a firm however many of its attorneys appear.  Rulings are counted by case before they meet the appearances.
    Attorneys without a firm are a firm of their own, null; appearances without a case or an attorney are left out.
    """
    hit = lambda *values: F.count_if(F.col("outcome").isin(*values))
    by_case = rulings.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), hit("granted").alias("g"), hit("denied").alias("d"), hit(*PARTLY).alias("p"))
    seen = appearances.where(F.col("case_id").isNotNull() & F.col("counsel").isNotNull()).select("case_id", "firm", "counsel").distinct()
    firms = seen.select("case_id", "firm").distinct().withColumn("counsel", F.lit(None).cast(seen.schema["counsel"].dataType))
    each = seen.withColumn("level", F.lit("counsel")).unionByName(firms.withColumn("level", F.lit("firm")))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = each.join(by_case, "case_id", "left").groupBy("level", "firm", "counsel").agg(
        F.count(F.lit(1)).alias("cases"), some("n").alias("rulings"), some("g").alias("granted"), some("d").alias("denied"), some("p").alias("granted_in_part")
    )
    decided = F.col("granted") + F.col("denied") + F.col("granted_in_part")
    rate = grant_rate(F.col("granted"), F.col("denied"), F.col("granted_in_part"))
    return out.withColumns({"grant_rate": rate, "provisional": decided < least})
