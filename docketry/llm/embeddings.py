"""Embedding near-dedup (operator 6): a pivot-permutation index with inverted pivot lists.

A vector is described by its nearest reference points in order.  It is listed under each of them; two vectors
on one list that share enough of theirs are compared in full.  A pair that meets on several lists counts on
the one of their lowest shared pivot alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import materialize, require
from docketry.llm.graph import connected_components
from docketry.llm.simhash import _grouped


def unit_rows(cells: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of some vectors can be compared (not null or zero, all components finite), and those, as doubles of
    length one."""
    good, out = np.zeros(len(cells), dtype=bool), []
    for i, c in enumerate(cells):
        if c is None or any(v is None for v in c):
            continue
        x = np.asarray(c, dtype=np.float64)
        if not len(x) or not np.isfinite(x).all() or not x.any():
            continue
        with np.errstate(over="ignore", under="ignore"):
            norm = np.linalg.norm(x)
        if not 1e-100 < norm < 1e100:  # squares too large or small for a double: scale by a power of two, which is exact
            x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
            norm = np.linalg.norm(x)
        good[i] = True
        out.append(x / norm)
    return good, out


def choose_pivots(vectors: DataFrame, n_pivots: int, sample_rows: int, seed: int) -> dict[int, np.ndarray]:
    """Reference points for each vector length: far apart ones among at most ``sample_rows`` vectors, which are
    those with the smallest hash of vec_id and label."""
    sample = vectors.where("embedding is not null").orderBy(F.xxhash64(F.lit(seed), "vec_id", "label"), "vec_id").limit(sample_rows)
    by_size: dict[int, list[np.ndarray]] = {}
    for x in unit_rows([r.embedding for r in sample.select("embedding").collect()])[1]:
        by_size.setdefault(len(x), []).append(x)
    out = {}
    for size, rows in by_size.items():
        x = np.stack(rows)
        chosen, nearest = [0], x @ x[0]
        while len(chosen) < min(n_pivots, len(x)):
            far = int(np.argmin(nearest))
            if nearest[far] > 1 - 1e-9:
                break
            chosen.append(far)
            nearest = np.maximum(nearest, x @ x[far])
        out[size] = x[chosen]
    return out


def spanning_pairs(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric relation."""
    open_, out = near.any(axis=1), []
    for start in np.flatnonzero(open_):
        if not open_[start]:
            continue
        open_[start], todo = False, [start]
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & open_)
            open_[found] = False
            todo += found.tolist()
            out += [(int(at), int(f)) for f in found]
    return out


def _reach(group: pa.Table, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Ids, weights of their partners and a forest of the links of one list, or of one shard of it with another."""
    ids = np.asarray(group.column("id").combine_chunks())
    masks = np.asarray(group.column("mask").combine_chunks()).view(np.uint64)
    weights = np.asarray(group.column("n").combine_chunks())
    shards = np.asarray(group.column("shard").combine_chunks())
    a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
    pivot = np.uint64(1) << np.uint64(group.column("pivot")[0].as_py())
    x = np.stack([np.frombuffer(v, dtype="<f8") for v in group.column("unit").to_pylist()])
    common = masks[:, None] & masks[None, :]
    shared = min(shared, int(np.bitwise_count(masks[0])))  # there may be fewer pivots than that
    near = (np.bitwise_count(common) >= shared) & ((common & (~common + np.uint64(1))) == pivot)
    if a != b:
        near &= shards[:, None] != shards[None, :]
    np.fill_diagonal(near, False)
    if near.any():
        near &= x @ x.T >= threshold
    return ids, near @ weights, [(int(ids[i]), int(ids[j])) for i, j in spanning_pairs(near)]


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, n_pivots: int = 64, depth: int = 8, shared: int = 4,
    sample_rows: int = 4096, shard_rows: int = 1024, seed: int = 6,
) -> DataFrame:
    """Per row of ``vectors (vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null and their cosine is ``threshold`` or more; those that
    are null or zero or hold a null or a non-finite component link with nothing, and so do rows without a vec_id
    or with vectors of another length than theirs.  Pivots come from at most ``sample_rows`` vectors; every vector
    is indexed.  Vectors of a length that the sample misses stand on one list for each label, where all are compared.  A vector is listed under its ``depth`` nearest of ``n_pivots`` (64 at most) pivots and
    compared with those on a list that have ``shared`` of these in common.

    Equal vectors of a label go through the index as one.  A list of over ``shard_rows`` vectors is dealt to
    shards and each pair of shards is a task of bounded size; only counts and a spanning forest leave it.
    Rows with one vec_id are vectors of their own that share its component.
    """
    require(vectors, "vec_id", "embedding", "label")
    if n_pivots > 64:
        raise ValueError("64 pivots at most")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    pivots = choose_pivots(vectors, n_pivots, sample_rows, seed)
    label_kind = vectors.schema["label"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, units = unit_rows(batch.column("embedding").to_pylist())
            at = iter(units)
            cells, masks = [], []
            for ok in good:
                x = next(at) if ok else None
                if not ok:
                    cells.append(None)
                    masks.append(None)
                    continue
                points = pivots.get(len(x))
                near = np.argsort(-(points @ x), kind="stable")[:depth] if points is not None else np.zeros(1, dtype=np.int64)
                mask = int(np.bitwise_or.reduce(np.uint64(1) << near.astype(np.uint64)))
                cells.append(x.tobytes())
                masks.append(mask - (mask >> 63 << 64))
            arrays = [batch.column("vec_id"), batch.column("label"), pa.array(cells, pa.binary()), pa.array(masks, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "unit", "mask"])

    known = vectors.select("vec_id", "label", "embedding").mapInArrow(describe, f"vec_id long, label {label_kind}, unit binary, mask long")
    known = materialize(known.withColumn("same", F.sha2("unit", 256)), "vectors")
    usable = known.where("vec_id is not null and label is not null and unit is not null")
    alike = usable.groupBy("label", "same").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"), F.first("mask").alias("mask"))
    alike = materialize(alike, "vector-kinds")
    listed = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.getbit("mask", p) == 1)
    posted = alike.select(F.xxhash64("label", F.octet_length("unit")).alias("list"), "id", "n", "unit", "mask", F.explode(listed).alias("pivot"))
    lists = posted.groupBy("list", "pivot").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    lists = lists.withColumn("shards", F.ceil(F.col("rows") / shard_rows).cast("int")).drop("rows")
    rows = posted.join(lists, ["list", "pivot"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.struct(F.least(o, F.col("shard")).alias("a"), F.greatest(o, F.col("shard")).alias("b")))
    rows = rows.withColumn("p", F.explode(others)).select("list", "pivot", "p.a", "p.b", "shard", "id", "n", "mask", "unit")
    by = ["list", "pivot", "a", "b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, by):
            ids, reached, pairs = _reach(group, threshold, shared)
            some = np.flatnonzero(reached)
            src, dst = [p for p, _ in pairs], [q for _, q in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids[some].tolist(), *src], pa.int64()), pa.array([None] * len(some) + dst, pa.int64()), pa.array([*reached[some].tolist(), *[0] * len(src)], pa.int64())],
                names=["src", "dst", "links"],
            )

    found = rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "src long, dst long, links long")
    found = materialize(found, "vector-links")
    roots = connected_components(found.where("dst is not null").select("src", "dst"))
    links = found.where("dst is null").groupBy("src").agg(F.sum("links").alias("links"))
    kinds = alike.select("label", "same", "id", "n").join(links, F.col("id") == F.col("src"), "left").drop("src")
    kinds = kinds.join(roots, F.col("id") == F.col("node"), "left")
    kinds = kinds.select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    kinds = materialize(kinds, "vector-classes")
    out = known.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), "same").join(kinds, ["label", "same"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
