"""Staging, validation and promotion of captures.

Captures are staged with what the rules said of them; nothing staged is in production.  Rules are data.  A promotion
writes the captures that passed (of sources that may promote by themselves) or were approved, and is visible once its
manifest row is there.  What failed waits until a corrected capture of the same id is staged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.merge import last_values

_NOTES = "array<struct<rule:string,severity:string>>"
_MANIFEST = "staged_upto long, reviews_upto long, rows long"
_REVIEWS = "id string, staged_batch long, decision string, reviewer string"


@dataclass(frozen=True)
class Check:
    """One rule: ``kind`` is ``required``, ``one_of`` (values), ``matches`` or ``not_matches`` (a pattern), ``between``
    (two bounds, either of them None), ``length`` (likewise) or ``daily_count`` (bounds of a source's captures a day, by
    the date ``column``).  ``severity`` is ``fail`` or ``flag``; with ``source`` the rule is that source's alone.  Null
    values break ``required`` only."""

    name: str
    column: str
    kind: str
    arguments: tuple = ()
    severity: str = "fail"
    source: str | None = None


# fixed values: rules for any source's rulings
GENERIC = (
    Check("has_text", "ruling_text", "required"), Check("text_length", "ruling_text", "length", (20, None), "flag"), Check("no_markup", "ruling_text", "not_matches", (r"</?[A-Za-z][^>]*>",)),
    Check("no_garbling", "ruling_text", "not_matches", ("�|Ã.|â€",), "flag"), Check("judge_is_a_name", "judge_name", "matches", (r"^[\p{L}.,'’ -]{3,80}$",), "flag"),
    Check("date_is_plausible", "hearing_date", "between", ("1990-01-01", "2100-01-01")),
)


def broken(check: Check, captures: DataFrame) -> Column:
    """Whether a row breaks a rule about itself."""
    c, args = F.col(check.column), check.arguments
    if check.kind == "required":
        out = c.isNull() | (F.trim(c.cast("string")) == "")
    elif check.kind == "one_of":
        out = ~c.isin(*args)
    elif check.kind == "matches":
        out = ~c.rlike(args[0])
    elif check.kind == "not_matches":
        out = c.rlike(args[0])
    elif check.kind in ("between", "length", "daily_count"):
        value = c if check.kind == "between" else F.length(c) if check.kind == "length" else F.col(f"__{check.name}")
        kind = captures.schema[check.column].dataType if check.kind == "between" else "long"
        low, high = (F.lit(a).cast(kind) if a is not None else None for a in args)
        out = F.lit(False)
        out = out | (value < low) if low is not None else out
        out = out | (value > high) if high is not None else out
    else:
        raise ValueError(f"no such kind of rule: {check.kind}")
    mine = F.col("scraper_id") == check.source if check.source else F.lit(True)
    return F.coalesce(mine & out, F.lit(False))


def validate(captures: DataFrame, rules: list[Check]) -> DataFrame:
    """``captures`` (with ``id`` and ``scraper_id``) with ``validation_status``: ``failed``, ``flagged`` or ``passed``, and
    ``validation_notes``: the rules that were broken."""
    rows = captures
    for r in (r for r in rules if r.kind == "daily_count"):
        day = F.col(r.column).cast("date")
        counts = captures.groupBy(F.col("scraper_id").alias("__s"), day.alias("__d")).agg(F.count(F.lit(1)).alias(f"__{r.name}"))
        rows = rows.join(counts, F.col("scraper_id").eqNullSafe(F.col("__s")) & day.eqNullSafe(F.col("__d")), "left").drop("__s", "__d")
    notes = F.array_compact(F.array(*[F.when(broken(r, captures), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules])).cast(_NOTES)
    rows = rows.select(*captures.columns, notes.alias("validation_notes"))
    worst = F.transform("validation_notes", lambda n: n["severity"])
    status = F.when(F.array_contains(worst, "fail"), "failed").when(F.array_contains(worst, "flag"), "flagged").otherwise("passed")
    return rows.withColumn("validation_status", status)


def rule_counts(validated: DataFrame, rules: list[Check]) -> DataFrame:
    """``rule, severity, broken``: how often each rule was broken, zeros too."""
    all_rules = validated.sparkSession.createDataFrame([(r.name, r.severity) for r in rules], "rule string, severity string")
    found = validated.select(F.explode("validation_notes").alias("n")).groupBy(F.col("n.rule").alias("rule")).agg(F.count(F.lit(1)).alias("broken"))
    return all_rules.join(found, "rule", "left").select("rule", "severity", F.coalesce("broken", F.lit(0)).alias("broken"))


@dataclass
class Staging:
    """Staged captures, reviews and promotions in folders under ``base``; ``schema`` is that of captures."""

    spark: SparkSession
    base: str
    schema: str

    def _read(self, name: str, schema: str, part: str) -> DataFrame:
        folder = f"{self.base}/{name}"
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{folder}/{part}=-1")
        return self.spark.read.schema(f"{schema}, {part} long").parquet(folder)

    def _put(self, df: DataFrame, name: str, part: str, n: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/{name}/{part}={n}")

    def stage(self, captures: DataFrame, batch: int, rules: list[Check]) -> None:
        """Validate and stage a batch; staged again, it replaces itself."""
        self._put(validate(captures, rules), "staged", "batch", batch)

    def staged(self) -> DataFrame:
        """All staged captures with their ``batch``."""
        return self._read("staged", f"{self.schema}, validation_notes {_NOTES}, validation_status string", "batch")

    def quarantine(self) -> DataFrame:
        """Captures that wait for a correction or a decision: those whose last staged version failed or is flagged, and
        which aren't promoted."""
        rows = self.staged()
        last = last_values(rows.withColumn("seq", F.col("batch")), ["id"], overwrite=[c for c in rows.columns if c != "id"])
        return last.where("validation_status <> 'passed'").join(self.promoted().select("id"), "id", "left_anti")

    def review(self, decisions: DataFrame, batch: int) -> None:
        """Decisions (``id, staged_batch, decision`` ``approve`` or ``reject``, ``reviewer``) about staged versions."""
        self._put(decisions.select(*[f.split()[0] for f in _REVIEWS.split(", ")]), "reviews", "batch", batch)

    def promote(self, promotion: int, automatic: list[str]) -> bool:
        """Promote what passed since the promotion before, of sources that may do so by themselves, and what was approved
        since then; failed captures can't be approved.  False if this promotion is there already.

        It reads the batches staged and reviewed since, and those that reviews refer to.  First the rows are written,
        then the manifest row; a promotion that died in between isn't visible and is done again as a whole.
        """
        manifest = self._read("promotions", _MANIFEST, "promotion").where("promotion >= 0")
        # one row a promotion, of which the last before this one counts
        before = manifest.where(F.col("promotion") <= promotion).orderBy(F.col("promotion").desc()).first()
        if before and before.promotion == promotion:
            return False
        staged_from, reviews_from = (before.staged_upto, before.reviews_upto) if before else (-1, -1)
        staged, reviews = self.staged(), self._read("reviews", _REVIEWS, "batch")
        upto = staged.agg(F.max("batch")).first()[0], reviews.agg(F.max("batch")).first()[0]
        staged_upto, reviews_upto = (-1 if n is None else n for n in upto)
        new = staged.where((F.col("batch") > staged_from) & (F.col("batch") <= staged_upto))
        passed = new.where((F.col("validation_status") == "passed") & F.col("scraper_id").isin(automatic))
        decided = reviews.where((F.col("batch") > reviews_from) & (F.col("batch") <= reviews_upto)).withColumnRenamed("batch", "review_batch")
        meant = [r.b for r in decided.select(F.col("staged_batch").alias("b")).distinct().collect()]
        last = decided.groupBy("id", "staged_batch").agg(F.max_by("decision", "review_batch").alias("decision")).withColumnRenamed("staged_batch", "batch")
        approved = staged.where(F.col("batch").isin(meant) & (F.col("validation_status") != "failed")).join(last.where("decision = 'approve'").drop("decision"), ["id", "batch"], "left_semi")
        rejected = last.where("decision = 'reject'").select("id", "batch")
        rows = passed.unionByName(approved).distinct().join(rejected, ["id", "batch"], "left_anti").withColumn("seq", F.col("batch"))
        fields = [c for c in staged.columns if c not in ("id", "validation_notes", "validation_status")]
        one = last_values(rows, ["id"], overwrite=fields).select("id", *fields).withColumnRenamed("batch", "staged_batch")
        self._put(one.withColumn("promoted_document_id", F.sha2(F.col("id").cast("string"), 256)), "promoted", "promotion", promotion)
        written = self.spark.read.parquet(f"{self.base}/promoted/promotion={promotion}")
        count = written.agg(F.lit(staged_upto).cast("long").alias("staged_upto"), F.lit(reviews_upto).cast("long").alias("reviews_upto"), F.count(F.lit(1)).alias("rows"))
        self._put(count, "promotions", "promotion", promotion)
        return True

    def promoted(self) -> DataFrame:
        """Production: each capture as it was first promoted, from promotions that are in the manifest."""
        done = self._read("promotions", _MANIFEST, "promotion").where("promotion >= 0").select("promotion")
        rows = self._read("promoted", f"{self.schema}, staged_batch long, promoted_document_id string", "promotion")
        rows = rows.join(F.broadcast(done), "promotion", "left_semi").withColumn("seq", F.col("promotion"))  # a row a promotion
        return last_values(rows, ["id"], first=[c for c in rows.columns if c not in ("id", "seq")]).select("id", *[c for c in rows.columns if c not in ("id", "seq")])
