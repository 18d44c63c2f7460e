"""Token-ID output (operator 7): Parquet list columns with chosen encoding, row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.bpe import LibraryTokenizer, load_tokenizer
from docketry.llm.common import byte_texts, require, steps


def tokenize_sorted(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """``doc_id, part int, row long, n_tokens long, tokens array<int>`` in ascending doc_id order: parts hold
    disjoint ranges of doc_id and ascend with them, rows ascend in each part.

    Each text's ids end in ``end_id``.  Null texts are empty; null ids come first; rows of one doc_id stand
    in text order.  The text is ranged and sorted before it is encoded, so it is encoded once.
    """
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, row = load_tokenizer(tokenizer, LibraryTokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for some in steps(batch, "text"):
                ids = [x + end for x in words.ids(byte_texts(some.column("text")))]
                counts = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(row, row + n)), pa.array(counts), pa.ListArray.from_arrays(offsets, values)],
                    names=["doc_id", "part", "row", "n_tokens", "tokens"],
                )
                row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ranged.mapInArrow(run, f"doc_id {kind}, part int, row long, n_tokens long, tokens array<int>")


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, compression: str = "zstd",
) -> None:
    """Write token files.  ``encoding``: ``dictionary`` (ids index a dictionary page) or ``delta`` (binary-packed
    differences).  Row groups and pages have the given sizes; each file holds column and offset indexes, so a
    reader of some doc_id values or of the counts alone touches only their pages."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    writer = tokenize_sorted(docs, tokenizer, end_id).write.option("compression", compression)
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.page.row.count.limit", page_rows)
    writer = writer.option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
    writer.option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2").parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, tokens: bool = True) -> DataFrame:
    """Token rows, or with ``tokens=False`` their metadata alone; doc_id bounds (inclusive) reach the page index."""
    out = spark.read.parquet(path)
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    if last is not None:
        out = out.where(F.col("doc_id") <= last)
    return out if tokens else out.drop("tokens")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of token files: where each document starts in the stream of all
    ids, from prefix sums over parts and then within each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            counts = np.diff(offsets).astype(np.int64)
            names = ["doc_id", "part", "row"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counts), pa.array(crc, pa.int64())], names=[*names, "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "part", "row", "tokens").mapInArrow(run, f"doc_id {kind}, part int, row long, n_tokens long, ids_crc32 long")
    totals = read_tokens(spark, path, tokens=False).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.sum("n_tokens").over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    out = found.withColumn("inner", F.coalesce(inner, F.lit(0))).join(parts, "part")
    return out.select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
