"""Mixing sources to target weights (operator 10): exact block quotas split down a tree of output shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.common import materialize, require, unused, word_count
from docketry.llm.draws import multivariate_hypergeometric

#: Bits of a document's random number that name its bucket: prefix sums run over buckets, then within each.
BUCKET_BITS = 12
#: Rows of an output shard that one task sorts.
ROWS_PER_PART = 50_000


def split_quotas(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """``quota[source, shard]``: every source's blocks, dealt exactly and uniformly to shards of equal block
    counts (to one), by halving the shards again and again with multivariate hypergeometric draws."""
    rng = np.random.default_rng(seed)
    total = sum(blocks)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(blocks), shards), dtype=np.int64)

    def split(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = counts
            return
        middle = (first + last) // 2
        left = multivariate_hypergeometric(rng, counts, sum(sizes[first:middle]))
        split(left, first, middle)
        split(counts - left, middle, last)

    if blocks:
        split(np.array(blocks, dtype=np.int64), 0, shards)
    return out


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from ``(source, size)`` rows.

    Sources in code-point order, null last, take the weights in turn.  Targets share ``share`` times all
    sizes by weight; a target stops at ``most`` times its source's size and the excess is shared again by
    weight among the others, until none is above.  That fixed point is reached in one pass over the sources
    in order of cap per weight: each is capped if it is below the level that the rest would share.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    caps = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - (F.sum("cap").over(order) - F.col("cap"))) / (
        F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    )
    caps = caps.withColumn("level", level).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(whole)
    caps = caps.withColumn("free", first)
    target = F.when(F.col("ratio") > F.col("level"), F.col("w") * F.col("free.level")).otherwise(F.col("cap"))
    return caps.select("source", "source_size", "n_docs", target.alias("target"))


def mixing_plan(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    shards: int = 16, block_rows: int = 64, seed: int = 10, row: str | None = None,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, row, source, size, source_size, target, copies int, shards array<int>``.

    Documents are taken whole.  A source's documents stand in an order of random numbers (from doc_id, text
    and seed, so reruns agree); the mix takes the order as often as it fits into the target and then its
    beginning, up to the document whose middle passes the target.  What is taken is cut into blocks of
    ``block_rows``; :func:`split_quotas` deals each source's blocks to the output shards, a random order of
    the blocks says which, and ``shards`` names the shard of each copy.

    Null texts have size 0; null sources form the last source; an empty table gives an empty plan; repeated
    rows are documents of their own.  Only one row per source reaches the driver; prefix sums run over
    buckets of the random number, so a hot source is spread over ``2**BUCKET_BITS`` groups.
    """
    require(docs, "doc_id", "source", "text")
    number = F.xxhash64(F.lit(seed), "doc_id", "text", "source")
    row_number = F.col(row) if row else F.monotonically_increasing_id()
    slim = docs.select("doc_id", row_number.alias("row"), "source", word_count(F.col("text")).alias("size"), number.alias("u"))
    slim = slim.withColumn("bucket", F.shiftrightunsigned("u", 64 - BUCKET_BITS))
    slim = materialize(slim, "mix-sizes")
    targets = materialize(source_targets(slim, weights, share, most), "mix-targets")

    by_bucket = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_bucket.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    inner = W.partitionBy("source", "bucket").orderBy("u", "doc_id", "row")
    placed = slim.withColumn("cum", F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.withColumn("n", F.row_number().over(inner))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    middle = F.col("words_before") + F.col("cum") - F.col("size") / 2
    placed = placed.withColumn("whole", whole).withColumn("extra", (rest > 0) & (middle <= rest))
    placed = placed.select(
        "doc_id", "row", "source", "size", "source_size", "n_docs", "target",
        (F.col("rows_before") + F.col("n") - 1).alias("place"),
        (F.col("whole") + F.col("extra").cast("long")).cast("int").alias("copies"),
    )
    placed = materialize(placed, "mix-placed")

    taken = placed.groupBy("source").agg(F.sum("copies").alias("takes")).collect()
    blocks = [-(-int(r.takes) // block_rows) for r in taken]
    quotas = np.cumsum(split_quotas(blocks, shards, seed), axis=1).tolist()
    bounds = [(n, r.source, b, q) for n, (r, b, q) in enumerate(zip(taken, blocks, quotas))]
    kind = docs.schema["source"].dataType.simpleString()
    bounds = docs.sparkSession.createDataFrame(bounds, f"n int, s {kind}, blocks long, bounds array<long>")
    # disjoint blocks in random order: the first quota of them to shard 0, and so on
    cut = bounds.where("blocks > 0").select("n", "bounds", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    order = W.partitionBy("n").orderBy(F.xxhash64(F.lit(seed), "n", "block"), "block")
    cut = cut.withColumn("r", F.row_number().over(order) - 1)
    shard = F.aggregate("bounds", F.lit(0), lambda c, b: c + F.when(b <= F.col("r"), 1).otherwise(0))
    cut = cut.select("n", "block", shard.alias("shard"))
    each = placed.where("copies > 0").join(bounds.select("n", "s"), F.col("source").eqNullSafe(F.col("s")))
    each = each.select("row", "n", "n_docs", "place", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    each = each.withColumn("block", F.floor((F.col("copy") * F.col("n_docs") + F.col("place")) / block_rows))
    homes = each.join(cut, ["n", "block"]).groupBy(F.col("row").alias("taken_row"))
    homes = homes.agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    plan = placed.join(homes, F.col("row") == F.col("taken_row"), "left")
    return plan.select("doc_id", "row", "source", "size", "source_size", "target", "copies", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def mix_sources(docs: DataFrame, keep_shard: bool = False, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns unchanged, dealt to output
    shards and in random order within each; with ``mix_shard int`` if wanted.

    Rows meet the plan by a number that they get as they are written to the shared folder.  A column ``mix_shard``
    of the input stays, unless it is wanted from here; others may have any names.
    """
    seed = how.get("seed", 10)
    if keep_shard:
        docs = docs.drop("mix_shard")
    row, copy, shard = unused(docs, "mix_row", "mix_copy", "to_shard")
    tagged = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    plan = mixing_plan(tagged, row=row, **how).where("copies > 0")
    plan = plan.select(F.col("row").alias(row), F.posexplode("shards").alias(copy, shard))
    # a large shard comes in several parts, each a random share of it
    parts = max(1, tagged.count() // (how.get("shards", 16) * ROWS_PER_PART))
    part = [F.pmod(F.xxhash64(F.lit(seed + 1), row, copy), F.lit(parts))] if parts > 1 else []
    out = tagged.join(plan, row).repartition(shard, *part)
    out = out.sortWithinPartitions(shard, F.xxhash64(F.lit(seed), row, copy))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col(shard).alias("mix_shard")] if keep_shard else []))
