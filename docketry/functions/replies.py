"""Replies of a ruling classifier, read and validated as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.sources.model import OUTCOMES

# fixed values: motion types that a reply may name, and the confidence below which a person looks at it
REPLY_MOTIONS = ("msj", "msj_partial", "mtd", "mil", "demurrer", "motion_to_compel", "motion_to_strike", "anti_slapp", "preliminary_injunction", "other")
SURE = 0.7

_FIELDS = ("outcome", "motion_type", "confidence")


def read_replies(df: DataFrame, text: str = "ruling_text", reply: str = "reply") -> DataFrame:
    """``df`` with ``classified struct<outcome, motion_type, confidence>``, ``reason`` and ``needs_review``.

    A reply is one JSON object, white space around it aside.  ``reason`` is null for a usable reply, and else the first of: ``empty_text`` (the
    ruling is null or blank), ``malformed_json`` (null replies, anything but an object, keys that stand twice),
    ``missing_key`` (absent or JSON null), ``bad_outcome``, ``bad_motion_type`` (not among the values, case counts),
    ``bad_confidence`` (no number, or outside 0 to 1; numbers in quotes count).  Refused replies have a null
    ``classified``.  ``needs_review``: refused, or less sure than ``SURE``.  More keys in a reply are ignored.
    """
    # the parser passes over what follows a value, but not inside brackets; nothing closes both kinds
    listed, keyed = F.try_parse_json(F.concat(F.lit("["), reply, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"a":'), reply, F.lit("}")))
    parsed = F.try_variant_get(listed, "$[0]", "variant")
    whole = keyed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull() & F.schema_of_variant(parsed).startswith("OBJECT")
    value = lambda key, kind="string": F.try_variant_get(parsed, f"$.{key}", kind)
    missing = F.lit(False)
    for key in _FIELDS:
        missing = missing | value(key, "variant").isNull() | F.is_variant_null(value(key, "variant"))
    confidence = value("confidence", "double")
    reason = (
        F.when(F.coalesce(F.regexp_replace(F.col(text), r"\s", ""), F.lit("")) == "", "empty_text")
        .when(~F.coalesce(whole, F.lit(False)), "malformed_json").when(missing, "missing_key")
        .when(~F.coalesce(value("outcome").isin(*OUTCOMES), F.lit(False)), "bad_outcome")
        .when(~F.coalesce(value("motion_type").isin(*REPLY_MOTIONS), F.lit(False)), "bad_motion_type")
        .when(~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)), "bad_confidence")
    )
    told = F.struct(value("outcome").alias("outcome"), value("motion_type").alias("motion_type"), confidence.alias("confidence"))
    return df.withColumns({"reason": reason, "classified": F.when(reason.isNull(), told), "needs_review": needs_review(reason, confidence)})


def needs_review(reason: Column, confidence: Column) -> Column:
    return reason.isNotNull() | F.coalesce(confidence < SURE, F.lit(True))
