"""SimHash near-dedup (operator 2): 64-bit fingerprints, BK-trees over shards, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import byte_texts, materialize, require, steps
from docketry.llm.graph import connected_components

#: Fingerprints that one tree holds; a routing key with more is dealt to several trees.
SHARD_ROWS = 4096


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits; each is set if it is set in over half of the shingles' XXH64 (seed 42).  No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    parts = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    count, total = len(parts), np.zeros(64, dtype=np.int64)
    for at in range(0, count, 1 << 16):
        some = parts[at : at + (1 << 16)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(42)), dtype="<u8", count=len(some))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        me = len(self.values)
        if me:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                down = self.edges[at].get(d)
                if down is None:
                    self.edges[at][d] = me
                    break
                at = down
        self.values.append(value)
        self.edges.append({})
        return me

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Nodes at most ``radius`` away; only edges within the radius of the distance to their parent are followed."""
        todo = [0] if self.values else []
        values, edges = self.values, self.edges
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            down = edges[at]
            if len(down) <= 2 * radius + 1:
                todo += [n for e, n in down.items() if d - radius <= e <= d + radius]
            else:
                todo += [down[e] for e in range(d - radius, d + radius + 1) if e in down]


def _links(values: list[int], ids: list[int], shards: list[int], mine: tuple[int, int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two shards, or within one; no more edges than values."""
    parent = list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, place, out = BKTree(), [], []
    left, right = mine
    for k in range(len(values)) if left == right else [k for k, s in enumerate(shards) if s == left]:
        if left == right:
            for hit in tree.within(values[k], radius):
                a, b = find(place[hit]), find(k)
                if a != b:
                    parent[b] = a
                    out.append((ids[place[hit]], ids[k]))
        tree.add(values[k])
        place.append(k)
    if left != right:
        for k in (k for k, s in enumerate(shards) if s == right):
            for hit in tree.within(values[k], radius):
                a, b = find(place[hit]), find(k)
                if a != b:
                    parent[b] = a
                    out.append((ids[place[hit]], ids[k]))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows]):
            key = tuple(int(c[a]) for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def fingerprint_links(prints: DataFrame, radius: int = 2, blocks: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(src, dst)`` edges that connect the ids of all fingerprints ``(fp, id)`` within ``radius`` bits.

    ``prints`` holds distinct fingerprints.  The 64 bits are cut into ``blocks``; two fingerprints within the
    radius agree on at least ``blocks - radius`` of them, so a fingerprint is routed by every choice of so
    many blocks and meets all its neighbours (with more blocks keys get longer, for larger inputs).  A key
    with over ``shard_rows`` fingerprints is dealt to shards by hash, and each pair of shards is one group of
    work: the tree of one shard, of bounded size, goes to the task that queries it with the other.  Only a
    spanning forest leaves a group, never all its pairs.
    """
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    keys = []
    for n, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.struct(F.lit(n).alias("way"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    routed = prints.select("fp", "id", F.explode(F.array(*keys)).alias("r")).select("fp", "id", "r.way", "r.key")
    routed = materialize(routed, "simhash-routes")
    crowded = routed.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = materialize(crowded.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int")), "simhash-keys")
    shard = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("shards")).cast("int")
    rows = routed.join(crowded.drop("n"), ["way", "key"]).withColumn("shard", shard)
    # each pair of shards (a <= b) is a group; a row takes part in all pairs with its shard
    others = F.transform(
        F.sequence(F.lit(0), F.col("shards") - 1),
        lambda o: F.struct(F.least(o, F.col("shard")).alias("a"), F.greatest(o, F.col("shard")).alias("b")),
    )
    rows = rows.withColumn("p", F.explode(others)).select("way", "key", "p.a", "p.b", "shard", "fp", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["way", "key", "a", "b"]):
            mine = (group.column("a")[0].as_py(), group.column("b")[0].as_py())
            values = np.asarray(group.column("fp")).view(np.uint64).tolist()
            found = _links(values, group.column("id").to_pylist(), group.column("shard").to_pylist(), mine, radius)
            if found:
                src, dst = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    by = ["way", "key", "a", "b"]
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "src long, dst long")


def simhash_components(docs: DataFrame, radius: int = 2, shingle: int = 3, blocks: int = 3) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fp long, component_id``, the smallest doc_id reachable by links.

    Equal fingerprints count as one node from the start, so large groups of copies cost a partial
    aggregation.  Null and empty texts have fingerprint 0 and link like any other.  Rows with a null doc_id
    link with nothing and have a null component.  Repeated rows get a row each.
    """
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                prints = np.array([fingerprint(t, shingle) for t in byte_texts(part.column("text"))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialize(source.mapInArrow(run, "doc_id long, fp long"), "simhash-prints")
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    roots = connected_components(fingerprint_links(nodes, radius, blocks))
    labels = nodes.join(roots, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("root", "id").alias("label"))
    labels = materialize(labels, "simhash-labels")
    component = F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("component_id")
    return prints.join(labels, "fp", "left").select("doc_id", "fp", component)


def keep_one_per_group(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest doc_id; all columns unchanged.

    Rows with a null doc_id stay.  Rows that repeat the kept doc_id stay too.
    """
    found = simhash_components(docs, **how)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return known.unionByName(docs.where("doc_id is null"))
