"""Alerts (D01): subscriptions as a reverse index, events once a subscription, digests that are sent once.

Each subscription waits at one key: its case, its judge, its party, or the rarest word of its keywords.  New rulings
meet only the subscriptions that wait at one of their keys with all the values that the filter names, and are then
held against its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.stem import words_of

# fixed values: kinds of alerts, and the field that each wants
KINDS = {"case_docket": "case_id", "judge_ruling": "judge_id", "keyword": "keyword", "party_attorney": "party_id"}
_FILTERS = "case_id string, judge_id string, court_id string, county string, outcome string, motion_type string, keyword string, party_id string"
_EQUAL = ("case_id", "judge_id", "court_id", "county", "outcome", "motion_type")
_EVENT = "event_id string, subscription_id string, user_id string, alert_type string, document_id string, triggered_at timestamp"
_DIGEST = "user_id string, subscription_id string, event_id string, document_id string"
_MANIFEST = "events_upto long"
#: So many shapes of filters, or words that they want, are known to the driver at most; of more, each ruling says all.
FEW = 1000


def subscriptions(rows: DataFrame) -> DataFrame:
    """Usable subscriptions of ``rows`` (``id, user_id, alert_type, filters`` as JSON, ``is_active``): ``subscription_id,
    user_id, alert_type``, the filter's fields and ``words`` of its keywords.  Those that are inactive, of no known
    kind, or without the field that their kind wants are left out."""
    f = F.from_json("filters", _FILTERS)
    out = rows.where("is_active").select(F.col("id").cast("string").alias("subscription_id"), F.col("user_id").cast("string").alias("user_id"), "alert_type", f.alias("f"))
    out = out.select("subscription_id", "user_id", "alert_type", *[F.nullif(F.trim(F.col(f"f.{n.split()[0]}")), F.lit("")).alias(n.split()[0]) for n in _FILTERS.split(", ")])
    out = out.withColumn("words", F.array_distinct(F.coalesce(words_of(F.col("keyword")), F.array().cast("array<string>"))))
    wanted = F.lit(False)
    for kind, field in KINDS.items():
        wanted = wanted | ((F.col("alert_type") == kind) & (F.size("words") > 0 if field == "keyword" else F.col(field).isNotNull()))
    return out.where(wanted & (F.col("keyword").isNull() | (F.size("words") > 0)))


def waiting(subs: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """``subs`` with ``key``, where each waits.  ``frequencies`` (``term, df``, say of a search index) tell which of a
    keyword's words is rarest; without them it is the longest."""
    own = F.lit(None).cast("string")
    for kind, field in KINDS.items():
        if field != "keyword":
            own = F.when(F.col("alert_type") == kind, F.concat_ws(":", F.lit(field), F.col(field))).otherwise(own)
    words = subs.where("alert_type = 'keyword'").select("subscription_id", F.explode("words").alias("term"))
    if frequencies is not None:
        words = words.join(frequencies.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    else:
        words = words.withColumn("df", -F.length("term"))
    rarest = words.groupBy("subscription_id").agg(F.concat(F.lit("word:"), F.min(F.struct("df", "term"))["term"]).alias("__word"))
    return subs.join(rarest, "subscription_id", "left").withColumn("key", F.coalesce("__word", own)).drop("__word")


def _shape(at: Column) -> tuple[Column, Column]:
    """Of subscriptions: which fields a filter names besides the one at which it waits, as text; whether words or a party are left to look at."""
    fields = F.concat_ws(",", *[F.when(F.col(c).isNotNull() & (at != c), F.lit(c)) for c in _EQUAL])
    rest = (F.size("words") > F.when(at == "word", 1).otherwise(0)) | (F.col("party_id").isNotNull() & (at != "party_id"))
    return fields, rest


def _place(at: Column | str, fields: Column | str, own: Column, values: list[Column]) -> Column:
    """A key with values of fields, each after its length, so that no two are alike by chance; null values of the list are left out."""
    part = lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v)
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.concat(F.concat_ws("|", lit(at), lit(fields), *map(part, values)), F.lit("|"), own)


def _said(rows: DataFrame, subs: DataFrame) -> DataFrame:
    """``rows`` with those of their ``words`` that a subscription wants, and as ``waited`` those at which one waits."""
    wanted = subs.select(F.explode("words").alias("word"), F.col("key").eqNullSafe(F.concat(F.lit("word:"), "word")).alias("here")).groupBy("word").agg(F.max("here").alias("here"))
    few = wanted.limit(FEW + 1).collect()
    of = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    if len(few) <= FEW:
        return rows.withColumn("words", F.array_intersect("words", of([r.word for r in few]))).withColumn("waited", F.array_intersect("words", of([r.word for r in few if r.here])))
    said = rows.select("document_id", F.explode("words").alias("word")).distinct().join(wanted, "word").groupBy("document_id").agg(F.collect_list("word").alias("__said"), F.collect_list(F.when(F.col("here"), F.col("word"))).alias("__here"))
    rows = rows.join(said, "document_id", "left").withColumn("waited", F.array_intersect("words", F.coalesce("__here", of([]))))
    return rows.withColumn("words", F.array_intersect("words", F.coalesce("__said", of([])))).drop("__said", "__here")


def met(rows: DataFrame, subs: DataFrame) -> DataFrame:
    """Pairs of rulings and subscriptions that agree in every field that the filter names; ``rest`` tells whether its
    words or its party are to be looked at, for which ``words`` and ``parties`` come along.

    Subscriptions wait at their key and all values of their other fields; of what a ruling says, keys of the shapes
    that there are go out, and of outcomes and kinds of motions those that somebody wants.
    """
    at = F.substring_index("key", ":", 1)
    fields, rest = _shape(at)
    shaped = subs.select("*", at.alias("at"), fields.alias("fields"), rest.alias("rest"))
    by = ["at", "fields", "rest"]
    found = shaped.select(*by, "outcome", "motion_type").distinct().limit(FEW + 1).collect()
    narrow = len(found) <= FEW
    found = found if narrow else shaped.select(*by).distinct().collect()  # a row a shape: 2 to the power of the fields at most, for each kind
    shapes: dict[tuple, dict[str, set]] = {}
    for r in found:
        values = shapes.setdefault((r.at, r.fields), {"outcome": set(), "motion_type": set(), "rest": set()})
        for c in values if narrow else ("rest",):
            values[c].add(r[c])
    single, several = [], []
    for (name, named), values in sorted(shapes.items()):
        more, others = any(values.pop("rest")), [c for c in named.split(",") if c]
        here = F.lit(True)
        for c in others:
            here = here & (F.col(c).isin(*sorted(values[c])) if values.get(c) else F.col(c).isNotNull())

        def key(own: Column, name=name, named=named, others=others, more=more) -> Column:
            return F.struct(_place(name, named, own, [F.col(c) for c in others]).alias("key"), F.lit(more).alias("rest"))

        if name in ("party_id", "word"):
            several.append(F.when(here, F.transform("parties" if name == "party_id" else "waited", lambda own: key(own))))
        else:
            single.append(F.when(here & F.col(name).isNotNull(), key(F.col(name))))
    kind = "array<struct<key:string,rest:boolean>>"
    none = F.array().cast(kind)
    keys = F.concat(F.array_compact(F.array(*single)).cast(kind) if single else none, *[F.coalesce(c.cast(kind), none) for c in several])
    keyed = rows.select("document_id", "captured_at", "parties", "words", F.explode(keys).alias("k")).where("k.key is not null")
    keyed = keyed.select("k.key", "document_id", "captured_at", *[F.when(F.col("k.rest"), F.col(c)).alias(c) for c in ("parties", "words")])
    own = F.substr("key", F.length("at") + 2)
    waits = shaped.select(
        _place(F.col("at"), F.col("fields"), own, [F.when(F.col("at") != c, F.col(c)) for c in _EQUAL]).alias("key"), "subscription_id", "user_id", "alert_type", "rest",
        F.when(F.col("rest"), F.col("party_id")).alias("party_id"), F.when(F.col("rest"), F.col("words")).alias("wanted"),
    )
    return keyed.join(waits, "key").drop("key")


def triggered(rulings: DataFrame, subs: DataFrame) -> DataFrame:
    """``event_id, subscription_id, user_id, alert_type, document_id, triggered_at`` of new rulings: ``document_id,
    case_id, judge_id, court_id, county, outcome, motion_type, party_ids`` (an array), ``ruling_text, captured_at``.

    Every field that a filter names must fit, all words of its keywords must be in the text.  A subscription's id is its alone.
    """
    ids = [F.col(c).cast("string").alias(c) for c in ("document_id", *_EQUAL)]
    parties = F.array_distinct(F.transform(F.coalesce("party_ids", F.array()), lambda p: p.cast("string")))
    rows = rulings.select(*ids, "captured_at", parties.alias("parties"), F.array_distinct(F.coalesce(words_of(F.col("ruling_text")), F.array().cast("array<string>"))).alias("words"))
    fits = F.forall("wanted", lambda w: F.array_contains(F.col("words"), w)) & (F.col("party_id").isNull() | F.array_contains(F.col("parties"), F.col("party_id")))
    out = met(_said(rows, subs), subs).where(~F.col("rest") | fits)
    out = out.groupBy("subscription_id", "user_id", "alert_type", "document_id").agg(F.min("captured_at").alias("triggered_at"))
    return out.select(F.sha2(F.concat_ws("|", "subscription_id", "document_id"), 256).alias("event_id"), "subscription_id", "user_id", "alert_type", "document_id", "triggered_at")


@dataclass
class AlertLog:
    """Events by batch and digests by run under ``base``; each replaces itself when it is done again."""

    spark: SparkSession
    base: str

    def _read(self, name: str, schema: str, part: str) -> DataFrame:
        folder = f"{self.base}/{name}"
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{folder}/{part}=-1")
        return self.spark.read.schema(f"{schema}, {part} long").parquet(folder)

    def record(self, events: DataFrame, batch: int) -> None:
        events.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/events/batch={batch}")

    def batch(self, batch: int) -> DataFrame:
        """Events as a batch has them."""
        return self.spark.read.schema(_EVENT).parquet(f"{self.base}/events/batch={batch}")

    def events(self) -> DataFrame:
        """Each event once, as its first batch had it."""
        rows = self._read("events", _EVENT, "batch")
        rest = [c for c in rows.columns if c not in ("event_id", "batch")]
        return rows.groupBy("event_id").agg(F.min("batch").alias("batch"), F.min_by(F.struct(*rest), "batch").alias("e")).select("event_id", "e.*", "batch")

    def digest(self, run: int) -> DataFrame:
        """The digest of a run: events of batches recorded since the run before that no earlier digest holds.  A run
        that is there already is given as it was, so that sending it again can be told by its ``event_id``."""
        runs = self._read("digest_runs", _MANIFEST, "run").where("run >= 0")
        done = runs.where(F.col("run") <= run).orderBy(F.col("run").desc()).first()  # a row a run
        digests = self._read("digests", _DIGEST, "run")
        if not (done and done.run == run):
            since = done.events_upto if done else -1
            rows = self._read("events", _EVENT, "batch").where(F.col("batch") > since)
            upto = rows.agg(F.max("batch")).first()[0]
            own = F.sha2(F.concat_ws("|", "subscription_id", "document_id"), 256)  # as triggered() has it: worked out again, it isn't dealt out
            fresh = rows.select("user_id", "subscription_id", "document_id", F.when(F.col("event_id") != own, F.col("event_id")).alias("other")).distinct().withColumn("event_id", F.coalesce("other", own))
            sent = digests.join(F.broadcast(runs.where(F.col("run") < run).select("run")), "run", "left_semi").select("event_id")
            fresh.join(sent, "event_id", "left_anti").select(*[f.split()[0] for f in _DIGEST.split(", ")]).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/digests/run={run}")
            self.spark.createDataFrame([(since if upto is None else upto,)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/digest_runs/run={run}")
        return self.spark.read.schema(_DIGEST).parquet(f"{self.base}/digests/run={run}")
