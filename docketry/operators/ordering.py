"""Numbers of rows in an order over a table or its groups, without a task that sees a whole table or group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.session import scratch_folder

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def number_all(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """``df`` with ``name``: 1, 2, 3... by ``order``.

    Rows are dealt to sorted ranges, which are written once to the shared folder with each row's place in its range;
    the number of rows in the ranges before it makes that a place in the table.  The driver sees one count a range.
    Rows that are equal in ``order`` are numbered in some order.
    """
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, "numbered")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumn("__place", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(ranged.schema.add("__place", "long")).parquet(path).withColumn("__range", F.shiftright("__place", _PLACE_BITS))
    before, starts = 0, []
    for r in sorted(written.groupBy("__range").count().collect()):
        starts.append((r["__range"], before))
        before += r["count"]
    offsets = spark.createDataFrame(starts, "__range long, __before long")
    place = F.col("__place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return written.join(F.broadcast(offsets), "__range").select(*df.columns, (F.col("__before") + place + 1).alias(name))


def _numberer(names: list[str], group: list[str], carry: list[str]):
    """Numbers sorted rows within their groups as they stream through a task; no group is held."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    def differs(column: pa.Array, before: pa.Array) -> np.ndarray:
        """Where a column's value isn't that of the row before, nulls being equal."""
        last = pa.concat_arrays([before, column.slice(0, len(column) - 1)])
        apart = pc.fill_null(pc.not_equal(column, last), False)
        return np.asarray(pc.or_(apart, pc.xor(pc.is_null(column), pc.is_null(last))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail, count, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            before = {c: tail[c] if tail else batch.column(names.index(c)).slice(0, 1) for c in {*group, *carry}}
            new = np.zeros(n, dtype=bool)
            for c in group:
                new |= differs(batch.column(names.index(c)), before[c])
            new[0] |= tail is None
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            number = np.where(start >= 0, at - start + 1, at + count + 1)
            in_first = first & (np.cumsum(new) <= (1 if tail is None else 0)) if first else np.zeros(n, dtype=bool)
            lags = []
            for c in carry:
                column = batch.column(names.index(c))
                shifted = pa.concat_arrays([before[c], column.slice(0, n - 1)])
                lags.append(pc.if_else(pa.array(new), pa.scalar(None, column.type), shifted))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, dtype=np.int64)), pa.array(number.astype(np.int64)), pa.array(in_first), *lags],
                names=[*names, "__range", "__no", "__first", *(f"previous_{c}" for c in carry)],
            )
            tail = {c: batch.column(names.index(c)).slice(n - 1, 1) for c in {*group, *carry}}
            count, first = int(number[-1]), bool(in_first[-1])

    return run


def number_in_groups(df: DataFrame, group: list[str], order: list[Column], name: str = "row_no", carry: list[str] = ()) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3... by ``order`` within each ``group``, and ``previous_<c>`` of the row before for the
    columns to ``carry`` (null for the first).

    Rows are dealt to sorted ranges of group and order, so a hot group is many tasks; each range numbers its own
    as they stream by and is written once.  Only the group that a range begins with may have begun earlier: how many
    rows it has before, and the values to carry over, come from a table of two rows a range at most.
    """
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, "grouped")
    keys = [F.col(c) for c in group]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    extra = [f"`previous_{c}` {kinds[c]}" for c in carry]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kinds.items()), "__range long, __no long, __first boolean", *extra])
    ranged.mapInArrow(_numberer(df.columns, list(group), list(carry)), schema).write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group])
    begun = written.where("__first").select(*group).distinct()
    sizes = written.alias("w").join(F.broadcast(begun).alias("b"), same("w", "b"), "left_semi")
    tails = [F.max_by(F.struct(*carry), "__no").alias("__tail")] if carry else []
    sizes = sizes.groupBy("__range", *group).agg(F.max("__no").alias("__n"), *tails)
    earlier = W.partitionBy(*group).orderBy("__range")
    offsets = sizes.withColumn("__before", F.sum("__n").over(earlier.rowsBetween(W.unboundedPreceding, -1)))
    offsets = (offsets.withColumn("__tail", F.lag("__tail").over(earlier)) if carry else offsets).where("__before is not null")
    mine = ["__before", *(["__tail"] if carry else [])]
    offsets = offsets.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__g{k}") for k, c in enumerate(group)], *mine)
    here = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__g{k}")) for k, c in enumerate(group)])
    out = written.join(F.broadcast(offsets), F.col("__first") & (F.col("__range") == F.col("__r")) & here, "left")
    opening = F.col("__before").isNotNull() & (F.col("__no") == 1)
    lags = [F.when(opening, F.col(f"__tail.{c}")).otherwise(F.col(f"previous_{c}")).alias(f"previous_{c}") for c in carry]
    return out.select(*df.columns, (F.col("__no") + F.coalesce("__before", F.lit(0))).alias(name), *lags)
