"""Substring dedup (operator 3): a log-structured index of window fingerprints, merged with each new batch.

The index is a few immutable runs, each the sorted fingerprints of one or more batches, cut into buckets by
their upper bits.  A new batch is fingerprinted where it lies, meets the runs bucket by bucket in a merge
join, has its matches verified by a second hash, and leaves a run of its own; with ``fanout`` runs there are,
the same merge writes them all as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import TextBlock, arrow_batches, byte_texts, covered, discard, inside, materialize, require, settings, steps, window_hash

_ENTRY = "bucket long, kind int, docs binary, prints binary, checks binary"
_CHECK_BASE = 0xD1342543DE82EF95
#: Text that one bucket's fingerprints come from, and that one group of documents holds, at most on average.
BUCKET_BYTES = 64 << 20
GROUP_BYTES = 8 << 20


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, so that sorted numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def unpack(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def fingerprints(block: TextBlock, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, check and place of every window of ``n`` words that lies in one text."""
    at = np.flatnonzero(inside(block.word_doc, n))
    checks = window_hash(block.word_hash, n, _CHECK_BASE) >> np.uint64(48)
    return window_hash(block.word_hash, n)[at], checks[at].astype("<u2"), at


def _runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal keys."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows with equal keys from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        for a, b in zip(*_runs_of(keys)):
            if held and keys[a] != last:
                yield last, held
                held = []
            last = int(keys[a])
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield last, held


def _group_rows(docs: np.ndarray, prints: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Matches dealt to groups of documents, as :func:`group_of` says."""
    if not len(docs):
        return
    group = ((docs ^ (docs >> 8) ^ (docs >> 16) ^ (docs >> 32)) & np.int64(0x7FFFFFFFFFFFFFFF)) % groups
    order = np.lexsort((prints, docs, group))
    docs, prints, group = docs[order], prints[order], group[order]
    for a, b in zip(*_runs_of(group)):
        yield int(group[a]), pack(docs[a:b]), pack(prints[a:b])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["bucket", "kind", "docs", "prints", "checks"])


class FingerprintIndex:
    """Windows of ``n_words`` words seen so far; ``ingest`` adds a batch and says what of it was seen before.

    ``buckets`` (a power of two) and ``groups`` set how finely fingerprints and documents are dealt; see
    :func:`index_for`.  Runs lie in the shared folder until :meth:`drop`.
    """

    def __init__(self, spark: SparkSession, n_words: int = 13, buckets: int = 256, groups: int = 256, fanout: int = 1) -> None:
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.spark, self.n, self.buckets, self.groups, self.fanout = spark, n_words, buckets, groups, fanout
        self.runs: list[DataFrame] = []

    def _entries(self, docs: DataFrame) -> DataFrame:
        """Each step's windows once, owned by the smallest doc_id; matches within the step come as kind 2."""
        n, buckets, groups = self.n, self.buckets, self.groups
        shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, "text", 2 << 20):
                    ids = np.asarray(part.column("doc_id")).astype(np.int64)
                    order = np.argsort(ids, kind="stable")
                    texts = byte_texts(part.column("text"))
                    block = TextBlock([texts[i] for i in order])
                    prints, checks, at = fingerprints(block, n)
                    docs_at = ids[order][block.word_doc[at]]
                    by = np.argsort(prints, kind="stable")
                    prints, checks, docs_at = prints[by], checks[by], docs_at[by]
                    if not len(prints):
                        continue
                    starts, ends = _runs_of(prints)
                    owner = np.repeat(starts, ends - starts)
                    same = checks == checks[owner]
                    rows = [(-1 - g, 2, d, p, b"") for g, d, p in _group_rows(*(x[same & (docs_at > docs_at[owner])] for x in (docs_at, prints)), groups)]
                    first = (np.arange(len(prints)) == owner) | ~same
                    prints, checks, docs_at = prints[first], checks[first], docs_at[first]
                    bucket = prints >> shift if shift is not None else np.zeros(len(prints), dtype=np.uint64)
                    rows += [(int(bucket[a]), 1, pack(docs_at[a:b]), pack(prints[a:b]), pack(checks[a:b])) for a, b in zip(*_runs_of(bucket))]
                    yield _rows(rows)

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENTRY)

    def ingest(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Add ``docs (doc_id, text)`` and return ``group, docs, prints``: packed pairs of a document and a
        fingerprint in it that a smaller doc_id of this batch, or any document of an earlier one, has too.

        With ``keep=False`` the batch is matched and leaves nothing behind, for when no other will follow."""
        groups, compact = self.groups, keep and len(self.runs) >= self.fanout
        rows = self._entries(docs.where("doc_id is not null"))
        for r in self.runs:
            rows = rows.unionByName(r)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, held in _groups(batches, "bucket"):
                if bucket < 0:
                    yield from held
                    continue
                kinds = np.concatenate([np.asarray(b.column("kind")) for b in held]).tolist()

                def column(name: str, dtype: str, kind: int) -> np.ndarray:
                    cells = (x for b in held for x in b.column(name).to_pylist())
                    parts = [unpack(x, dtype) for x, k in zip(cells, kinds) if k == kind]
                    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)

                old, old_checks = column("prints", "<u8", 0), column("checks", "<u2", 0)
                order = np.lexsort((old_checks, old))
                old, old_checks = old[order], old_checks[order]
                new, new_checks, owners = column("prints", "<u8", 1), column("checks", "<u2", 1), column("docs", "<i8", 1)
                order = np.lexsort((owners, new_checks, new))
                new, new_checks, owners = new[order], new_checks[order], owners[order]
                out = []
                if len(new):
                    fresh = np.concatenate(([True], (new[1:] != new[:-1]) | (new_checks[1:] != new_checks[:-1])))
                    start = np.maximum.accumulate(np.where(fresh, np.arange(len(new)), 0))
                    seen = np.zeros(len(new), dtype=bool)
                    place = np.searchsorted(old, new)
                    for step in (0, 1):
                        near = np.minimum(place + step, max(0, len(old) - 1))
                        if len(old):
                            seen |= (old[near] == new) & (old_checks[near] == new_checks)
                    hit = seen | (owners > owners[start])
                    out += [(-1 - g, 2, d, p, b"") for g, d, p in _group_rows(owners[hit], new[hit], groups)]
                    add = fresh & ~seen
                    new, new_checks = new[add], new_checks[add]
                if compact:
                    new, new_checks = np.concatenate((old, new)), np.concatenate((old_checks, new_checks))
                    order = np.lexsort((new_checks, new))
                    new, new_checks = new[order], new_checks[order]
                if keep and len(new):
                    out.append((bucket, 0, b"", pack(new), pack(new_checks)))
                yield _rows(out)

        merged = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _ENTRY)
        with settings(self.spark, arrow_batches(1000, 16 << 20)):  # a row of packed fingerprints is large
            merged = materialize(merged, "fingerprints", partition_by="kind")
        if compact:
            self.drop()
        if keep:
            fresh = merged.where("kind = 0")
            fresh._scratch_path = f"{merged._scratch_path}/kind=0"
            self.runs.append(fresh)
        return merged.where("kind = 2").select((-1 - F.col("bucket")).alias("group"), "docs", "prints")

    def drop(self) -> None:
        for r in self.runs:
            discard(r)
        self.runs = []


def index_for(docs: DataFrame, **how) -> FingerprintIndex:
    """An index for about as much text as ``docs`` hold."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(256, 1 << (size // BUCKET_BYTES).bit_length())
    return FingerprintIndex(docs.sparkSession, buckets=buckets, groups=max(256, size // GROUP_BYTES), **how)


def group_of(doc_id: Column, groups: int) -> Column:
    """A document's group: ids with a common stride spread too, for their upper bits count as well."""
    mixed = doc_id.bitwiseXOR(F.shiftright(doc_id, 8)).bitwiseXOR(F.shiftright(doc_id, 16)).bitwiseXOR(F.shiftright(doc_id, 32))
    return mixed.bitwiseAND(F.lit((1 << 63) - 1)) % F.lit(groups)


def remove_repeats(docs: DataFrame, hits: DataFrame, n_words: int, groups: int) -> DataFrame:
    """``doc_id, n_words long, n_removed long, kept_text string``: each text without the words of the windows in
    ``hits``; the words left are joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    group = group_of(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), groups)
    texts = docs.select(group.alias("group"), F.lit(1).alias("what"), "doc_id", "text", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("prints"))
    found = hits.select("group", F.lit(0).alias("what"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"), "docs", "prints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_docs, held_prints, ready = None, [], [], None
        for batch in batches:
            keys = list(zip(batch.column("group").to_pylist(), batch.column("what").to_pylist()))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for i, (g, what) in enumerate(keys):
                if g != at:
                    at, held_docs, held_prints, ready = g, [], [], None
                if not what:
                    held_docs.append(unpack(batch.column("docs")[i].as_py(), "<i8"))
                    held_prints.append(unpack(batch.column("prints")[i].as_py(), "<u8"))
                    continue
                if ready is None:
                    d = np.concatenate(held_docs) if held_docs else np.zeros(0, dtype=np.int64)
                    p = np.concatenate(held_prints) if held_prints else np.zeros(0, dtype=np.uint64)
                    order = np.argsort(d, kind="stable")
                    ready, held_docs, held_prints = (d[order], p[order]), [], []
                text = texts[i] or b""
                words = text.split()
                removed = 0
                if ids[i] is not None:
                    a, b = np.searchsorted(ready[0], [int(ids[i]), int(ids[i]) + 1])
                    if b > a:
                        block = TextBlock([text])
                        prints, _, where = fingerprints(block, n_words)
                        flags = np.zeros(max(0, len(words) - n_words + 1), dtype=bool)
                        flags[where] = np.isin(prints, ready[1][a:b])
                        gone = covered(flags, n_words, len(words))
                        removed = int(gone.sum())
                        words = [w for w, x in zip(words, gone.tolist()) if not x]
                out.append((ids[i], len(words) + removed, removed, b" ".join(words).decode()))
                if len(out) >= 256:
                    yield _kept(out, batch.schema.field("doc_id").type)
                    out = []
            if out:
                yield _kept(out, batch.schema.field("doc_id").type)

    rows = found.unionByName(texts).repartition("group").sortWithinPartitions("group", "what")
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def _kept(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, n_words: int = 13, batches: int = 3, fanout: int = 1) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept_text``.

    Every word goes that lies in a window of ``n_words`` words whose words also stand, as a window, in a document
    with a smaller doc_id.  The table comes in ``batches`` ranges of doc_id, smallest first, one after another
    into one index.  Null texts have no words.  Rows without a doc_id are left as they are and seen by no other.
    Rows with the same doc_id count as one document and get a row each.  An empty table gives an empty table.
    """
    require(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text")
    index = index_for(docs, n_words=n_words, fanout=fanout)
    number = docs.select(F.col("doc_id").cast("long").alias("n")).where("n is not null")
    cuts = number.approxQuantile("n", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    hits = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = docs.where(F.lit(True) if low is None else F.col("doc_id") > low).where(F.lit(True) if high is None else F.col("doc_id") <= high)
        found = index.ingest(part, keep=high is not None)
        hits = found if hits is None else hits.unionByName(found)
    index.drop()
    return remove_repeats(docs, hits, n_words, index.groups)
