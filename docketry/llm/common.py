"""Shared helpers: scratch tables in the cluster's shared folder, Arrow batches cut by bytes, text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a Java and as an RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; a longer single text is a step of its own.
STEP_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one of our own that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = "/tmp/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return base.rstrip("/")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Within it, the session has other settings."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_batches(rows: int, size: int) -> dict[str, str]:
    """Settings by which Arrow batches hold at most that many rows and about ``size`` bytes."""
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}


#: Shuffle files go when the job that wrote them is over.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    What the job shuffled is deleted when it is done; its result doesn't need that any more."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with settings(spark, _TIDY):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes together, so that memory doesn't follow batch size."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null texts are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """Apply ``fn`` to every step of every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                yield fn(part)

    return df.mapInArrow(run, schema)


class TextBlock:
    """Words and lines of several texts as flat numpy arrays, with 64-bit hashes of the bytes of each.

    ``word_doc`` and ``line_doc`` hold the index of the text that a word or line belongs to.  A hash is the
    sum of a random 64-bit value per byte times an odd base to the power of its place, scrambled at the end.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, texts: list[bytes], lines: bool = False) -> None:
        # one \n after every text ends its last line and word
        joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.n_docs, self.ends = len(texts), np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.bytes = joined
        self.space = (joined == 32) | ((joined >= 9) & (joined <= 13))
        edges = np.diff(np.concatenate(([True], self.space)).astype(np.int8))
        self.word_start = np.flatnonzero(edges == -1)
        self.word_end = np.flatnonzero(edges == 1)
        self.word_doc = np.searchsorted(self.ends, self.word_start, side="right")
        rng = np.random.default_rng(20240229)
        values = rng.integers(1, 2**63, size=256, dtype=np.uint64)
        powers = np.full(len(joined), self.BASE, dtype=np.uint64)
        powers[:1] = 1
        with np.errstate(over="ignore"):
            powers = np.cumprod(powers, dtype=np.uint64)
            self._sums = np.concatenate(([np.uint64(0)], np.cumsum(values[joined] * powers, dtype=np.uint64)))
        self._inverse = pow(int(self.BASE), -1, 2**64)
        self.word_hash = self.span_hash(self.word_start, self.word_end)
        if lines:
            self.line_end = np.flatnonzero(joined == 10)
            self.line_start = np.concatenate(([0], self.line_end[:-1] + 1)) if len(self.line_end) else self.line_end
            self.line_doc = np.searchsorted(self.ends, self.line_start, side="right")
            self.line_hash = self.span_hash(self.line_start, self.line_end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            back = np.full(len(self.bytes) + 1, self._inverse, dtype=np.uint64)
            back[:1] = 1
            back = np.cumprod(back, dtype=np.uint64)
            return scramble((self._sums[end] - self._sums[start]) * back[start] + (end - start).astype(np.uint64))

    def per_doc(self, docs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(docs, weights=weights, minlength=self.n_docs).astype(np.int64)[: self.n_docs]


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(32))


def window_hash(words: np.ndarray, n: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """Hash of every ``n`` consecutive entries, by doubling; windows that cross texts are the caller's to drop."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, done, width, block = None, 0, 1, words
        left = n
        while left:
            if left & 1:
                part = block[done : done + len(words) - n + 1]
                out = part.copy() if out is None else out + part * np.uint64(pow(base, done, 2**64))
                done += width
            left >>= 1
            if left:
                block = block[: len(block) - width] + block[width:] * np.uint64(pow(base, width, 2**64))
                width *= 2
        return scramble(out)


def inside(doc: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` words lie in one text."""
    return doc[: len(doc) - n + 1] == doc[n - 1 :] if len(doc) >= n else np.empty(0, dtype=bool)


def covered(flags: np.ndarray, n: int, length: int) -> np.ndarray:
    """Entries that lie in a flagged window of ``n``."""
    if not len(flags):
        return np.zeros(length, dtype=bool)
    count = np.concatenate((np.zeros(n, dtype=np.int64), np.cumsum(flags), np.full(n - 1, flags.sum())))
    return count[n:] > count[:-n]
