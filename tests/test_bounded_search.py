"""Pages by blocks and vectors by clusters against scoring everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import search
from docketry.operators.topk import BlockIndex, top_documents
from docketry.operators.vectors import VectorIndex

WORDS = [f"w{k}" for k in range(12)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(f"d{k:04d}", " ".join(rng.choices(WORDS, weights=range(1, 13), k=rng.choice([3, 5, 9, 60, 200]))) if k % 50 else None, k % 4) for k in range(900)]
    built = search.build_index(spark.createDataFrame(rows, "document_id string, ruling_text string, part int"), stemmed=False)
    return built, BlockIndex.build(built, str(tmp_path_factory.mktemp("blocks")), size=16)


@pytest.mark.parametrize("terms", [["w0"], ["w11"], ["w0", "w1", "w2"], ["w3", "w11"], ["w1", "nowhere"]])
@pytest.mark.parametrize("k", [1, 7])
def test_pages(index, terms, k):
    built, blocks = index
    order = lambda df: [(r.document_id, round(r.score, 9)) for r in df.orderBy(F.round("score", 9).desc(), F.col("document_id").desc()).limit(k).collect()]
    top = top_documents(blocks, terms, k)
    assert [(r.document_id, round(r.score, 9)) for r in top.rows.collect()] == order(search.match_all_terms(built, terms)) and top.read <= top.blocks
    among = built.docs.where("part = 1")
    some = top_documents(blocks, terms, k, among)
    assert [(r.document_id, round(r.score, 9)) for r in some.rows.collect()] == order(search.match_all_terms(built, terms).join(among.select("document_id"), "document_id"))


def test_blocks_are_skipped(index):
    top = top_documents(index[1], ["w11"], 3)
    assert top.read < top.blocks / 2


def brute(rows, wanted, k):
    out = {}
    for q, v in wanted.items():
        v = np.asarray(v) / np.linalg.norm(v)
        found = sorted(((-float(np.dot(x, v) / np.linalg.norm(x)), i) for i, x, *_ in rows if x and len(x) == len(v) and any(x) and np.all(np.isfinite(x))))
        out[q] = [i for _, i in found[:k]]
    return out


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(25):
        centre = rng.normal(size=24)
        rows += [(len(rows) + j, (centre + rng.normal(size=24) * 0.25).tolist(), c % 5) for j in range(40)]
    rows += [(5000 + j, rows[0][1], 1) for j in range(6)]
    odd = [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] * 24, 1), (9003, [1.0, 2.0], 1), (9004, [], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(table)
    wanted = {i: rows[i][1] for i in (0, 333, 777)} | {-1: rng.normal(size=24).tolist()}
    found = lambda df: {q: [r.vec_id for r in sorted((r for r in df if r.query == str(q)), key=lambda r: r.place)] for q in wanted}
    got, _ = index.search(wanted, 8)
    assert found(got.collect()) == brute(rows, wanted, 8)
    near = {q: v for q, v in wanted.items() if q >= 0}
    _, read = index.search(near, 5)
    clusters = spark.read.parquet(str(tmp_path / "v/centres")).count()
    assert read < clusters
    # behind a filter that leaves little, all clusters are read
    narrow = [r for r in rows if r[2] == 3 and r[0] < 160]
    got, read = index.search(wanted, 50, "label = 3 and vec_id < 160", probes=1, exact=False)
    assert read == clusters and {q: sorted(v) for q, v in found(got.collect()).items()} == {q: sorted(v) for q, v in brute(narrow, wanted, 50).items()}
    # probes alone: recall over many queries
    many = {r[0]: r[1] for r in rows[::20]}
    got, read = index.search(many, 10, probes=2, exact=False)
    hits = {}
    for r in got.collect():
        hits.setdefault(int(r.query), set()).add(r.vec_id)
    truth = brute(rows, many, 10)
    assert sum(len(hits[q] & set(truth[q])) for q in many) >= 0.95 * sum(map(len, truth.values()))
    plan = index._closest({0: np.array(rows[0][1])}, 3, {1, 2}, None)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cluster" in plan.split("PartitionFilters")[1][:80]


def test_empty_vectors(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>"))
    got, read = index.search({1: [1.0, 0.0]}, 3)
    assert got.collect() == [] and read == 0
