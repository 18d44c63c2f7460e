"""Upserts and guarded inserts as DataFrames (M01 to M12): each takes a target and a batch and returns new rows or a new target.

``seq`` orders a batch: events apply as if one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.ordering import number_in_groups


def last_values(batch: DataFrame, key: list[str], overwrite: list[str] = (), fill: list[str] = (), first: list[str] = ()) -> DataFrame:
    """One row a key: the last of ``overwrite`` columns, the last non-null of ``fill``, the first of ``first``."""
    last = [F.max_by(c, "seq").alias(c) for c in overwrite]
    filled = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fill]
    firsts = [F.min_by(c, "seq").alias(c) for c in first]
    return batch.groupBy(*key).agg(*last, *filled, *firsts)


def upsert(
    target: DataFrame, batch: DataFrame, key: list[str], overwrite: list[str] = (), fill: list[str] = (), first: list[str] = (), now: Column | None = None
) -> DataFrame:
    """Target with the batch's rows merged in by key; ``now`` goes into ``updated_at`` of the rows that
    the batch touches (M12).

    ``overwrite`` columns take the batch's value, ``fill`` columns take it unless it is null, ``first`` columns
    keep the target's value where the key is there already.
    """
    new = last_values(batch, list(key), overwrite, fill, first)
    here = F.col("t.__there").isNotNull()
    both = target.withColumn("__there", F.lit(True)).alias("t").join(new.withColumn("__new", F.lit(True)).alias("n"), list(key), "full")
    columns = [F.col(k) for k in key]
    for c in target.columns:
        if c in key:
            continue
        old, fresh = F.col(f"t.{c}"), F.col(f"n.{c}") if c in new.columns else None
        if c == "updated_at" and now is not None:
            columns.append(F.when(F.col("n.__new").isNotNull(), now).otherwise(old).alias(c))
        elif c in overwrite:
            columns.append(F.when(F.col("n.__new").isNotNull(), fresh).otherwise(old).alias(c))
        elif c in fill:
            columns.append(F.coalesce(fresh, old).alias(c))
        elif c in first:
            columns.append(F.when(here, old).otherwise(fresh).alias(c))
        else:
            columns.append(old.alias(c))
    return both.select(*columns).select(*target.columns)


def insert_absent(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch whose key the target lacks; the first by ``seq`` of each key."""
    rest = [c for c in batch.columns if c not in key]
    one = batch.groupBy(*key).agg(*[F.min_by(c, "seq").alias(c) for c in rest]).select(*batch.columns)
    return one.join(target.select(*key).distinct(), list(key), "left_anti")


def resolve_judges(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """``names (raw_name, court_id)`` with a judge for each: the alias's (the smallest id, if there
    are several), else a new one whose id follows from name and court."""
    known = aliases.groupBy("raw_name", "court_id").agg(F.min("judge_id").alias("known"))
    new = F.sha2(F.concat_ws("|", F.col("court_id").cast("string"), "raw_name"), 256)
    out = names.select("raw_name", "court_id").where("raw_name is not null").distinct().join(known, ["raw_name", "court_id"], "left")
    return out.select("raw_name", "court_id", F.coalesce(F.col("known").cast("string"), new).alias("judge_id"), F.col("known").isNull().alias("is_new"))


def fill_nulls(target: DataFrame, values: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Null fields take the values found for their key, of which ``values`` has one row each; others stay."""
    found = values.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = target.join(found, list(key), "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in target.columns])


def backfill(target: DataFrame, values: DataFrame, key: list[str], columns: list[str], limit: int | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The target after :func:`fill_nulls`, and one row of statistics ``processed, updated`` (and how
    many of each column were filled).

    Rows with a null among ``columns`` are processed, with ``limit`` the first of them by key; ``updated`` have a
    value found for one.  A dry run gives the target as it is, and the same statistics."""
    lacking = F.lit(False)
    for c in columns:
        lacking = lacking | F.col(c).isNull()
    wanted = target.where(lacking).select(*key, *columns)
    wanted = wanted.orderBy(*key).limit(limit) if limit is not None else wanted
    found = values.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    filled = wanted.join(found, list(key), "left")
    fills = [F.col(c).isNull() & F.col(f"__{c}").isNotNull() for c in columns]
    some = fills[0]
    for f in fills[1:]:
        some = some | f
    counts = [F.count_if(f).alias(f"filled_{c}") for f, c in zip(fills, columns)]
    statistics = filled.agg(F.count(F.lit(1)).alias("processed"), F.count_if(some).alias("updated"), *counts)
    if dry_run:
        return target, statistics
    chosen = values.join(wanted.select(*key), list(key), "left_semi") if limit is not None else values
    return fill_nulls(target, chosen, key, columns), statistics


def delete_keys(target: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Target without the rows of some keys."""
    return target.join(keys.select(*key).distinct(), list(key), "left_anti")


def content_versions(documents: DataFrame, key: list[str]) -> DataFrame:
    """Documents in order of capture with the version they replace; equal content is no new version.

    A key with many captures is many tasks."""
    order = [F.col("captured_at"), F.col("document_id")]
    out = number_in_groups(documents, key, order, "__no", carry=["content_hash"])
    out = out.where((F.col("__no") == 1) | (F.col("previous_content_hash") != F.col("content_hash"))).select(*documents.columns)
    return number_in_groups(out, key, order, "version", carry=["document_id"]).withColumnRenamed("previous_document_id", "previous_version_id").withColumn("version", F.col("version").cast("int"))
