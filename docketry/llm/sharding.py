"""Sharding (operator 5): a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.common import discard, materialize, unused
from docketry.llm.draws import multivariate_hypergeometric

#: Rows that one task permutes.
ROWS_PER_BLOCK = 200_000


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """How many rows each block sends to each shard: rows and columns add up exactly, and the matrix has the
    law that a uniform permutation of all rows would give it, at every size."""
    rng = np.random.default_rng(seed)
    left, out = np.array(shard_rows, dtype=np.int64), []
    for n in block_rows:
        sent = multivariate_hypergeometric(rng, left, n)
        left = left - sent
        out.append(sent.tolist())
    return out


def shard_uniformly(rows: DataFrame, n_shards: int = 24, seed: int = 5, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``rows`` with ``shard int`` and ``slot long``: shard sizes differ by at most one (the first are larger),
    slots are gapless from 0 in each shard, and every order of the rows is equally likely.

    Only DataFrame operations touch rows.  Rows are numbered as they are written to the shared folder and
    dealt to blocks by that number, never by a value, so repeated rows, nulls and hot keys deal evenly.  The
    driver sees one count for each block (rows / ``rows_per_block`` of them) and draws the matrix of blocks
    times shards.  An empty table gives an empty table.  Columns ``shard`` and ``slot`` of the input are replaced.
    """
    rows = rows.drop("shard", "slot")
    row, block, bound, rank_, key, bucket, n, offset = unused(rows, "row", "block", "bound", "rank", "key", "bucket", "n", "offset")
    kept = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "shard-rows")
    total = kept.count()
    blocks = max(1, -(-total // rows_per_block))
    number = lambda salt: F.xxhash64(row, F.lit(seed), F.lit(salt))
    dealt = kept.withColumn(block, F.pmod(number("block"), F.lit(blocks)).cast("int"))
    counts = {r[0]: r[1] for r in dealt.groupBy(block).count().collect()}
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    bounds = [(b, np.cumsum(sent).tolist()) for b, sent in enumerate(matrix)]
    bounds = rows.sparkSession.createDataFrame(bounds, f"{block} int, {bound} array<long>")
    # the local permutation: a block's first rows in random order go to shard 0, the next to shard 1, ...
    rank = F.row_number().over(W.partitionBy(block).orderBy(number("first"), row)) - 1
    sent = dealt.withColumn(rank_, rank.cast("long")).join(bounds, block)
    shard = F.aggregate(bound, F.lit(0), lambda m, b: m + F.when(b <= F.col(rank_), 1).otherwise(0))
    sent = materialize(sent.withColumn("shard", shard).drop(bound, rank_, block), "shard-sent")
    discard(kept)
    # the second permutation, in buckets of a shard so that no task sorts a whole shard
    bits = max(1, int(np.ceil(np.log2(max(2, total / n_shards / rows_per_block)))))
    sent = sent.withColumn(key, number("second")).withColumn(bucket, F.shiftrightunsigned(key, 64 - bits))
    before = W.partitionBy("shard").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(n))
    offsets = offsets.withColumn(offset, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    place = F.row_number().over(W.partitionBy("shard", bucket).orderBy(key, row)) - 1
    out = sent.withColumn(rank_, place).join(offsets, ["shard", bucket])
    out = out.withColumn("slot", (F.col(offset) + F.col(rank_)).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", "slot")


def write_shards(rows: DataFrame, path: str, **how) -> None:
    """Write ``rows`` to one folder a shard, in slot order within each file."""
    placed = shard_uniformly(rows, **how)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
