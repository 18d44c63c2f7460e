"""Whether a new version of a text says something new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import classify
from docketry.operators.merge import content_versions

#: Letters in ten by which a block may differ and still be the same with a slip mended.
SLIP = 1


def blocks(text: Column) -> Column:
    """The sentences and lines of a text in lower case, without marks and with single spaces; empty ones are left out."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\n.;:!?]+")
    return F.filter(F.transform(found, lambda b: F.trim(F.regexp_replace(b, r"[^\p{L}\p{N}]+", " "))), lambda b: b != "")


def _words(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda n, b: n + F.size(F.split(b, " ")))


def change(before: Column, after: Column) -> Column:
    """``kind`` and ``share`` (of the words of ``after``, those in blocks that ``before`` lacks) of a change.

    ``none``: equal texts; ``formatting``: the same blocks in the same order; ``typo``: as many new blocks as gone ones,
    each but a slip away from its counterpart, the same figures in it, and the same outcome; ``substantive``: the rest.
    """
    let = lambda value, then: F.get(F.transform(F.array(value), then), 0)

    def judged(b: Column) -> Column:
        gone, new = F.array_except(b["old"], b["new"]), F.array_except(b["new"], b["old"])
        return let(F.struct(gone.alias("gone"), new.alias("new")), lambda d: F.struct(kind(b, d).alias("kind"), share(b, d).alias("share")))

    def share(b: Column, d: Column) -> Column:
        changed = F.filter(b["new"], lambda x: F.array_contains(d["new"], x))
        return F.coalesce(F.try_divide(_words(changed).cast("double"), _words(b["new"]).cast("double")), F.lit(0.0))

    def kind(b: Column, d: Column) -> Column:
        digits = lambda x: F.regexp_replace(x, r"[^\p{N}]", "")
        slip = lambda x, y: (F.levenshtein(x, y) * 10 <= F.greatest(F.length(x), F.length(y)) * SLIP) & (digits(x) == digits(y))
        slips = (F.size(d["gone"]) == F.size(d["new"])) & (F.size(d["gone"]) > 0) & (F.size(b["old"]) == F.size(b["new"])) & F.forall(F.zip_with(d["gone"], d["new"], slip), lambda ok: ok)
        same_outcome = classify.outcome(before).eqNullSafe(classify.outcome(after))
        return F.when(before.eqNullSafe(after), "none").when(b["old"] == b["new"], "formatting").when(slips & same_outcome, "typo").otherwise("substantive")

    return let(F.struct(blocks(before).alias("old"), blocks(after).alias("new")), judged)


def version_changes(documents: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The versions of :func:`content_versions` with ``change`` (``first`` for a first version) and ``changed_share``.

    Cosmetic ones (``none``, ``formatting``, ``typo``) stay linked to the version they replace and needn't be shown.
    Texts are met by document id, not by key, so a key with many versions is spread.
    """
    versions = content_versions(documents.drop(text), key)
    old = documents.select(F.col("document_id").alias("previous_version_id"), F.col(text).alias("__old"))
    both = versions.join(documents.select("document_id", F.col(text).alias("__new")), "document_id").join(old, "previous_version_id", "left")
    found = F.when(F.col("previous_version_id").isNotNull(), change(F.col("__old"), F.col("__new")))
    return both.withColumn("__c", found).select(*versions.columns, F.coalesce("__c.kind", F.lit("first")).alias("change"), F.coalesce("__c.share", F.lit(1.0)).alias("changed_share"))
