"""Importance resampling towards a target distribution (operator 13): hashed word n-grams, counted by DuckDB in each partition.

Every partition cuts its texts into words and n-grams with SQL (lists unnested side by side), hashes distinct words with
zlib's CRC-32, joins words' checksums to those of n-grams, and leaves each document's bucket counts as Parquet in the shared folder.  Spark sums these into the counts of
the whole corpus and of the target, and a document's weight is the sum of its buckets' gains.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import STEP_BYTES, arrow_batches, byte_texts, discard, materialize, require, settings, steps
from docketry.operators.ordering import number_all

#: A word: a run of ASCII letters and digits and of everything beyond ASCII; as a RE2 pattern, and over UTF-8 bytes.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_APART = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Memory that one partition's DuckDB may take.
MEMORY = "400MB"


def _ngram_sql(longest: int, buckets: int) -> str:
    """Counts by text and bucket of a step's n-grams; those that end in a text's first ``carried`` words belong to the
    stretch before.

    Lists of each word's checksum, that of a blank and the word, and its bytes are unnested side by side, shifted by a
    word each, and an n-gram's checksum is its first words' joined with that of a blank and its last word."""
    shifted = [f"unnest(words[{k + 1}:]) AS w{k}" for k in range(longest)]
    grams = ["w0.alone"] + [f"join_crc(g{k - 1}, w{k}.behind, w{k}.size)" for k in range(1, longest)]
    steps, source = [], "u"
    for k, gram in enumerate(grams):
        steps.append(f"u{k} AS (SELECT *, {gram} AS g{k} FROM {source})")
        source = f"u{k}"
    return (
        f"WITH t AS (SELECT place, carried, word_crcs(regexp_extract_all(text, '{WORD}')) AS words FROM step), "
        f"u AS (SELECT place, carried, generate_subscripts(words, 1) AS i, {', '.join(shifted)} FROM t), "
        f"{', '.join(steps)}, f AS (SELECT place, carried, i, unnest([{', '.join(f'g{k}' for k in range(longest))}]) AS feature, unnest(range({longest})) AS k FROM {source}) "
        f"SELECT place, feature % {buckets} AS bucket, COUNT(*) AS n, COUNT(*) FILTER (WHERE k = 0) AS words "
        "FROM f WHERE feature IS NOT NULL AND i + k > carried GROUP BY ALL"
    )


def _shifts(table: np.ndarray) -> np.ndarray:
    """Of a linear map of 32 bits, given by its four tables of a byte each, the map done twice."""
    return _shifted(table, table.reshape(-1)).reshape(4, 256)


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def _zero_bytes() -> list[np.ndarray]:
    """What 1, 2, 4, ... 2^31 zero bytes behind a text do to its checksum without the inversions, as tables by byte."""
    one = np.zeros((4, 256), np.uint32)
    for at in range(4):
        for c in range(256):
            v = c << 8 * at
            for _ in range(8):
                v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
            one[at, c] = v
    out = [one]
    while len(out) < 32:
        out.append(_shifts(out[-1]))
    return out


_ZEROS = _zero_bytes()


def join_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of texts that begin with a text of checksum ``first`` and go on with one of ``second`` and ``size`` bytes."""
    out = first.astype(np.uint32)
    for bit in range(int(size.max(initial=0)).bit_length()):
        on = np.flatnonzero(size >> bit & 1)
        out[on] = _shifted(_ZEROS[bit], out[on])
    return out ^ second


def _connect():
    """A DuckDB in memory on one thread, without files, that knows zlib's CRC-32 of words and of what they make up."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    kind = pa.struct([("alone", pa.uint32()), ("behind", pa.uint32()), ("size", pa.uint32())])
    blank = zlib.crc32(b" ")

    def words(lists: pa.ChunkedArray) -> pa.Array:
        chunk = lists.combine_chunks()
        flat = chunk.flatten().cast(pa.binary())
        size = np.asarray(pc.binary_length(flat)).astype(np.int64) + 1
        each = flat.dictionary_encode()
        alone = np.fromiter(map(zlib.crc32, each.dictionary.to_pylist()), np.uint32, len(each.dictionary))[np.asarray(each.indices)]
        behind = join_crc(np.full(len(alone), blank, np.uint32), alone, size - 1)
        rows = pa.StructArray.from_arrays([pa.array(v.astype(np.uint32)) for v in (alone, behind, size)], fields=list(kind))
        offsets = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(chunk), 0))))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), rows)

    def joined(first: pa.ChunkedArray, second: pa.ChunkedArray, size: pa.ChunkedArray) -> pa.Array:
        # a row without a second part has no n-gram; its null stays
        none = np.asarray(pc.or_(pc.is_null(first), pc.is_null(second)))
        whole = lambda c: np.asarray(pc.fill_null(c, 0))
        return pa.array(join_crc(whole(first), whole(second), whole(size).astype(np.int64)), mask=none)

    con.create_function("word_crcs", words, ["VARCHAR[]"], "STRUCT(alone UINTEGER, behind UINTEGER, size UINTEGER)[]", type="arrow")
    con.create_function("join_crc", joined, ["UINTEGER", "UINTEGER", "UINTEGER"], "UINTEGER", type="arrow", null_handling="special")
    return con


def _stretches(text: bytes, longest: int, most: int = STEP_BYTES) -> Iterator[tuple[int, bytes]]:
    """A text in stretches of about ``most`` bytes, cut between words: how many words of the stretch before stand in
    front again, and the stretch."""
    carried: list[bytes] = []
    start = 0
    while True:
        found = _APART.search(text, start + most) if len(text) - start > most else None
        end = found.start() if found else len(text)
        own = text[start:end].lower()
        yield len(carried), b" ".join([*carried, own])
        if end == len(text):
            return
        carried = [*carried, *_WORD_BYTES.findall(own)][-(longest - 1) :] if longest > 1 else []
        start = end


def bucket_counts(docs: DataFrame, longest: int = 3, buckets: int = 10_000, key: str = "doc_id") -> DataFrame:
    """``<key>, n_words, n_features, bucket, n`` of each row: its words, its n-grams of up to ``longest`` words, and how
    many of these fall into each bucket (parallel arrays, by bucket).  Null texts have none."""
    sql = _ngram_sql(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        for batch in batches:
            for part in steps(batch, "text"):
                yield count(con, part)

    def count(con, part: pa.RecordBatch) -> pa.RecordBatch:
        rows, found, held, size = part.num_rows, [], [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                places, carried, texts = zip(*held)
                con.register("step", pa.table({"place": pa.array(places, pa.int32()), "carried": pa.array(carried, pa.int32()), "text": pa.array(texts, pa.binary()).cast(pa.string())}))
                found.append(con.execute(sql).fetchnumpy())
                con.unregister("step")
            held, size = [], 0

        for place, text in enumerate(byte_texts(part.column("text"))):
            for carried, stretch in _stretches(text, longest):
                # one stretch of a text at a time, for a step tells texts apart by their place
                if held and (carried or size + len(stretch) > STEP_BYTES):
                    flush()
                held.append((place, carried, stretch))
                size += len(stretch)
        flush()
        whole = lambda c, t=np.int64: np.concatenate([np.asarray(x[c]) for x in found]).astype(t) if found else np.empty(0, t)
        cells, where = np.unique(whole("place") * buckets + whole("bucket"), return_inverse=True)
        n = np.bincount(where, weights=whole("n"), minlength=len(cells)).astype(np.int64)
        of = cells // buckets
        per_row = lambda at, w: pa.array(np.bincount(at, weights=w, minlength=rows).astype(np.int64)[:rows])
        offsets = pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (cells % buckets, n)]
        return pa.RecordBatch.from_arrays([part.column("key"), per_row(whole("place"), whole("words")), per_row(of, n), *lists], names=["key", "n_words", "n_features", "bucket", "n"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, n_words long, n_features long, bucket array<int>, n array<int>")
    return out.withColumnRenamed("key", key)


def corpus_counts(spilled: DataFrame) -> DataFrame:
    """``bucket, n`` over all rows of :func:`bucket_counts`; tasks add up their own first."""
    cells = spilled.select(F.explode(F.arrays_zip("bucket", "n")).alias("c")).select("c.bucket", "c.n")
    return cells.groupBy("bucket").agg(F.sum("n").cast("long").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Of each bucket, ``floor(1000 ln(((t + 1)(S + buckets)) / ((s + 1)(T + buckets))))``; one number a bucket reaches
    the driver."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(target.select("bucket", F.lit(0).cast("long"), "n"))
    cells = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    all_s, all_t = sum(r.s for r in cells), sum(r.t for r in cells)
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in cells:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * float(all_s + buckets) / ((s + 1) * float(all_t + buckets)))).astype(np.int64)


def weigh(spilled: DataFrame, gains: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``<key>, n_words, n_features, weight`` of each row of :func:`bucket_counts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, n = batch.column("bucket"), batch.column("n")
            value = np.concatenate(([0], np.cumsum(gains[np.asarray(bucket.flatten())] * np.asarray(n.flatten()).astype(np.int64))))
            ends = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(bucket)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("n_words"), batch.column("n_features"), pa.array(value[ends[1:]] - value[ends[:-1]])], names=["key", "n_words", "n_features", "weight"])

    kind = spilled.schema[key].dataType.simpleString()
    out = spilled.select(F.col(key).alias("key"), "n_words", "n_features", "bucket", "n").mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("key", key)


def gumbel(key: Column, seed: int) -> Column:
    """A whole number by the Gumbel law times 1000, from a hash of seed and key: the largest ``weight + gumbel`` are a
    sample without replacement by weight."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, longest: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of each row of ``docs``: the share of ``percent`` with the
    highest scores among rows of ``least_words`` words is drawn and numbered, the rest has a null rank.

    Ties go to the smaller ``doc_id``; rows with the same one (null counts as largest, and hashes as an empty id) are
    in some order.  Null texts are empty: no features, weight 0.  With an empty ``target`` every text is weighed
    against a flat distribution.  Both tables need ``text``; other columns play no part.  A row for each row, so
    repeated rows are each counted, weighed and, if their score allows, drawn.  Counts are over all rows.
    """
    require(docs, "doc_id", "text")
    require(target, "text")
    # small batches: JVM and Python each hold some of them beside DuckDB
    with settings(docs.sparkSession, arrow_batches(2_000, 2 * STEP_BYTES)):
        spilled = materialize(bucket_counts(docs, longest, buckets), "bucket-counts")
    wanted = bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    gains = bucket_gains(corpus_counts(spilled), corpus_counts(wanted), buckets)
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    fit = F.col("n_words") >= least_words
    scored = weigh(spilled, gains).select("*", score.alias("score"))
    numbered = number_all(scored, [F.when(fit, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    drawn = numbered.where(fit).count() * percent // 100
    discard(spilled)
    return numbered.select("doc_id", "n_words", "n_features", "weight", "score", F.when(fit & (F.col("place") <= drawn), F.col("place")).alias("rank"))
