"""Operator 6 against brute force: every link it reports is one, and it finds at least nine in ten."""

import math

import numpy as np

from docketry.llm import embeddings
from docketry.llm import queries as q
from docketry.llm.common import read_table


def brute(rows, threshold=0.93):
    good = [(v, lab, np.asarray(e, dtype=float)) for v, e, lab in rows if v is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links, parent = dict.fromkeys((v for v, *_ in good), 0), {v: v for v, *_ in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (v, lab, e) in enumerate(good):
        for w, other, f in good[:i]:
            if lab == other and len(e) == len(f) and e @ f / (np.linalg.norm(e) * np.linalg.norm(f)) >= threshold:
                links[v] += 1
                links[w] += 1
                a, b = sorted((find(v), find(w)))
                parent[b] = a
    return {v: (links.get(v, 0), find(v) if v in parent else v) for v, *_ in rows}


def check(rows, out, least):
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert set(got) == set(want)
    assert all(got[v][0] <= want[v][0] for v in want)
    assert sum(n for n, _ in got.values()) >= least * sum(n for n, _ in want.values())
    return got, want


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in read_table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    check(rows, q.op6_embedding_near_dedup(spark, sf), 0.9)


def test_recall_on_spread_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(60):
        centre = rng.normal(size=32)
        rows += [(len(rows) + k, (centre + rng.normal(size=32) * 0.27).tolist(), c % 2) for k in range(12)]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard_rows=50)
    check(rows, out, 0.9)


def test_odd_rows(spark):
    a = [1.0, 2.0, 3.0]
    rows = [
        (1, a, 0), (2, a, 0), (3, a, None), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 3.0], 0),
        (7, [1.0, float("nan"), 3.0], 0), (8, [float("inf"), 2.0, 3.0], 0), (9, [2.0, 4.0, 6.1], 0), (10, a, 1), (11, [1.0, 2.0], 0), (12, [], 0),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, unit string, mask int")
    got, want = check(rows, embeddings.near_vectors(table), 1.0)
    assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in embeddings.near_vectors(table).collect())
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    twice = embeddings.near_vectors(table.where("vec_id = 1").unionAll(table.where("vec_id = 1"))).collect()
    assert [(r.n_links, r.component_id) for r in twice] == [(1, 1), (1, 1)]
