"""Lookups between cases, judges, parties, courts and rulings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The row with an id."""
    return df.where(F.col(key) == F.lit(value))


def lookup(df: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """``wanted (ordinal, id)`` with the row of each id, null columns where there is none."""
    return wanted.join(df, key, "left")


def rulings_of_county(rulings: DataFrame, cases: DataFrame, courts: DataFrame, county: str | None) -> DataFrame:
    """Rulings of a county's courts; without a county no join takes place."""
    if not county:
        return rulings
    inside = cases.join(courts.where(F.col("county") == county).select(F.col("id").alias("court_id")), "court_id").select(F.col("id").alias("case_id"))
    return rulings.join(inside, "case_id", "left_semi")


def rulings_of_case_number(rulings: DataFrame, cases: DataFrame, case_number) -> DataFrame:
    """J02."""
    if case_number in (None, ""):
        return rulings
    return rulings.join(cases.where(F.col("id") == F.lit(case_number)).select(F.col("id").alias("case_id")), "case_id", "left_semi")


def judges_of_cases(links: DataFrame, rulings: DataFrame) -> DataFrame:
    """``(case_id, judge_id)`` from ``links``; for cases without any, the judges of their rulings."""
    linked = links.select("case_id", "judge_id").distinct()
    others = rulings.where(F.col("judge_id").isNotNull()).join(linked.select("case_id").distinct(), "case_id", "left_anti")
    return linked.unionByName(others.select("case_id", "judge_id").distinct())


def judges_with_rulings(judges: DataFrame, rulings: DataFrame) -> DataFrame:
    """Judges that have a ruling, each once."""
    return judges.join(rulings.select(F.col("judge_id").alias("id")), "id", "left_semi")


def parties_of_cases(parties: DataFrame, case_parties: DataFrame) -> DataFrame:
    """Parties with their role; one with two roles comes twice."""
    return case_parties.join(parties.withColumnRenamed("id", "party_id"), "party_id")


def party_groups(case_parties: DataFrame) -> DataFrame:
    """Plaintiffs, defendants and others of each case, by lower-cased role."""
    role = F.lower("party_type")
    names = lambda hit: F.array_sort(F.collect_list(F.when(hit, F.col("name"))))
    plaintiff, defendant = role.isin("plaintiff", "petitioner"), role.isin("defendant", "respondent")
    return case_parties.groupBy("case_id").agg(
        names(plaintiff).alias("plaintiffs"), names(defendant).alias("defendants"), names(~plaintiff & ~defendant | role.isNull()).alias("others")
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def latest_text(rulings: DataFrame, text: str = "ruling_text") -> DataFrame:
    """Each case's text of the latest hearing that has one; one row a case, by aggregation."""
    rows = rulings.where(F.col(text).isNotNull())
    return rows.groupBy("case_id").agg(F.max(F.struct("hearing_date", F.col("seq").alias("tie"), F.col(text).alias("text"))).alias("x")).select("case_id", "x.hearing_date", F.col("x.text").alias(text))


def ruling_ids_of_hits(hits: DataFrame, rulings: DataFrame) -> DataFrame:
    """Each hit with its document's ruling id (the largest), or the document id where there is none."""
    ids = rulings.groupBy("document_id").agg(F.max("ruling_id").alias("__ruling"))
    out = hits.join(ids, "document_id", "left")
    return out.withColumn("ruling_id", F.coalesce(F.col("__ruling"), F.col("document_id"))).drop("__ruling")


def ruling_feed(rulings: DataFrame, cases: DataFrame, courts: DataFrame, judges: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` rulings with case, court and judge; what is shown is chosen before anything is joined."""
    top = rulings.orderBy(F.col("hearing_date").desc(), F.col("case_id").desc(), F.col("seq").desc()).limit(n)
    out = top.join(cases.select(F.col("id").alias("case_id"), "case_type", "court_id"), "case_id", "left")
    out = out.join(courts.select(F.col("id").alias("court_id"), "county", "state"), "court_id", "left")
    return out.join(judges.select(F.col("id").alias("judge_id"), "canonical_name"), "judge_id", "left")


def first_by_position(df: DataFrame, key: str, position: str, *values: str) -> DataFrame:
    """For each key the values at its smallest position."""
    return df.groupBy(key).agg(F.min(position).alias(position), *[F.min_by(v, position).alias(v) for v in values])


def orphans(child: DataFrame, parent: DataFrame, foreign_key: str, key: str = "id") -> DataFrame:
    """Rows whose foreign key isn't null and has no parent."""
    return child.where(F.col(foreign_key).isNotNull()).join(parent.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")


def unknown_ids(requested: list[str], known: list[str]) -> list[str]:
    """Requested ids that aren't known, in order."""
    return [x for x in dict.fromkeys(requested) if x not in set(known)]
