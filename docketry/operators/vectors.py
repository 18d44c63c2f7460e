"""Vector search over clusters (D08): vectors stored by their nearest centre, of which a query reads the near ones."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Centres at most; their table goes to every task.
MOST_CENTRES = 1024
_STEP = 4096


def _units(column: pa.ListArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors (``d`` finite entries, not all zero) and these at length 1."""
    lengths, starts = np.diff(np.asarray(column.offsets)), np.asarray(column.offsets)[:-1]
    flat = np.asarray(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False))
    at = np.flatnonzero((lengths == d) & np.asarray(column.is_valid()))
    x = flat[starts[at][:, None] + np.arange(d)] if len(at) else np.empty((0, d))
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], x[good] / norm[good, None]


@dataclass
class VectorIndex:
    """Vectors under ``root``, one folder a cluster, and the clusters' centres and widest angles."""

    spark: SparkSession
    root: str
    key: str = "vec_id"
    vector: str = "embedding"

    def build(self, vectors: DataFrame, n_centres: int | None = None, rounds: int = 3) -> None:
        """Store ``vectors``, their other columns too, by nearest centre.

        Centres start as the vectors whose keys hash lowest (about the root of their number, ``MOST_CENTRES`` at most)
        and move ``rounds`` times to the mean direction of their cluster, over all vectors.  Vectors of another length
        than most, null, zero or not finite are like nothing and left out.  A large cluster is several files.
        """
        usable = vectors.where(F.size(self.vector) > 0)
        sizes = usable.groupBy(F.size(self.vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
        d, n = (sizes.d, sizes.n) if sizes else (0, 0)
        wanted = min(MOST_CENTRES, n_centres or max(1, int(n**0.5)))
        first = usable.where(F.size(self.vector) == d).orderBy(F.xxhash64(self.key), self.key).select(self.vector).limit(wanted).toArrow() if n else None
        centres = _units(first.column(0).combine_chunks(), d)[1] if n else np.empty((0, d))
        for _ in range(rounds if len(centres) else 0):
            sums = np.zeros_like(centres)
            for r in self._sums(usable, centres).collect():  # a row a cluster
                sums[r.cluster] = r.total
            norm = np.sqrt((sums * sums).sum(axis=1))
            centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
        placed = self._place(usable, centres)
        salt = F.pmod(F.xxhash64(self.key), F.lit(8))
        placed.repartition("cluster", salt).write.mode("overwrite").option("compression", "zstd").partitionBy("cluster").parquet(f"{self.root}/vectors")
        widest = self.spark.read.schema(placed.schema).parquet(f"{self.root}/vectors").groupBy("cluster").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n"))
        table = {r.cluster: (r.widest, r.n) for r in widest.collect()}
        rows = [(k, c.tolist(), *table[k]) for k, c in enumerate(centres) if k in table]
        self.spark.createDataFrame(rows, "cluster int, centre array<double>, widest double, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")
        self.spark.createDataFrame([(json.dumps(placed.schema.jsonValue()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/schema")

    def _sums(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        """Of each cluster the sum of its unit vectors; tasks add up their own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros_like(centres), np.zeros(len(centres), dtype=bool)
            for batch in batches:
                _, x = _units(batch.column(0), centres.shape[1])
                nearest = (x @ centres.T).argmax(axis=1)
                np.add.at(total, nearest, x)
                seen[nearest] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["cluster", "part"])

        parts = vectors.select(self.vector).mapInArrow(run, "cluster int, part array<double>").select("cluster", F.posexplode("part").alias("i", "x"))
        sums = parts.groupBy("cluster", "i").agg(F.sum("x").alias("x"))
        return sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))

    def _place(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        """Vectors with their cluster and the angle to its centre."""
        names, vector = vectors.columns, vectors.columns.index(self.vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = _units(batch.column(vector), centres.shape[1])
                if len(at):
                    near = x @ centres.T
                    nearest = near.argmax(axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(at)), nearest], -1, 1))
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(nearest.astype(np.int32)), pa.array(angle)], names=[*names, "cluster", "angle"])

        return vectors.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema), "cluster int, angle double"]))

    def search(self, wanted: dict, k: int, where: Column | str | None = None, probes: int = 4, exact: bool = True) -> tuple[DataFrame, int]:
        """``query`` (its id as text), ``<key>, cosine, place`` of the ``k`` vectors closest to each of a few ``wanted`` (id to vector), ties by
        key, among those that ``where`` admits; and how many clusters were read.

        The ``probes`` nearest clusters of each query are read first.  With ``exact``, so are then all that may hold
        something closer than the k-th found (their centre's angle less their widest); else only if less than ``k``
        were found, as behind a narrow filter, the others are read too.
        """
        centres = self.spark.read.parquet(f"{self.root}/centres").orderBy("cluster").collect()
        queries = {q: np.asarray(v, dtype=float) / np.linalg.norm(v) for q, v in wanted.items()}
        away = {q: {c.cluster: float(np.arccos(np.clip(np.dot(v, c.centre), -1, 1))) for c in centres} for q, v in queries.items()}
        near = {c for a in away.values() for c in sorted(a, key=a.get)[:probes]}
        found = self._closest(queries, k, near, where)
        got: dict = {}
        for r in found.collect():  # k rows a query
            got.setdefault(r.query, []).append(r.cosine)
        more = set()
        for q, a in away.items():
            least = min(got[str(q)]) if len(got.get(str(q), [])) >= k else None
            for c in centres:
                if least is None or exact and np.cos(max(0.0, a[c.cluster] - c.widest - 1e-7)) >= least - 1e-9:
                    more.add(c.cluster)
        read = near | more
        return (self._closest(queries, k, read, where) if read != near else found), len(read)

    def _closest(self, queries: dict, k: int, clusters: set[int], where: Column | str | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/schema").first().value))
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/vectors").where(F.col("cluster").isin(sorted(clusters)))
        rows = (rows.where(where) if where is not None else rows).select(self.key, self.vector)
        ids, matrix = list(queries), np.array(list(queries.values()))
        kind = rows.schema[self.key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, _STEP):
                    part = batch.slice(start, _STEP)
                    at, x = _units(part.column(1), matrix.shape[1])
                    cosine = x @ matrix.T
                    for j, q in enumerate(ids):
                        # all that reach the k-th best of the step, ties too
                        best = np.flatnonzero(cosine[:, j] >= np.partition(cosine[:, j], -k)[-k]) if len(at) > k else np.arange(len(at))
                        yield pa.RecordBatch.from_arrays([pa.array([str(q)] * len(best)), part.column(0).take(pa.array(at[best])), pa.array(cosine[best, j])], names=["query", "key", "cosine"])

        scored = rows.mapInArrow(run, f"query string, key {kind}, cosine double")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.col("cosine").desc(), "key"))
        return scored.withColumn("place", place).where(F.col("place") <= k).select("query", F.col("key").alias(self.key), "cosine", "place")
