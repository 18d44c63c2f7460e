"""Operator 3 against brute force."""

import hashlib
import re

import numpy as np
import pytest

from docketry.llm import queries as q
from docketry.llm import substring
from docketry.llm.common import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - n + 1) if d is not None and first[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    got = sorted((tuple(r) for r in q.op3_substring_dedup(spark, sf).collect()), key=str)
    want = brute(rows)
    assert got == want and any(r[2] for r in want)


@pytest.mark.parametrize("batches", [1, 4])
def test_odd_rows(spark, batches):
    rng = np.random.default_rng(5)
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(i, " ".join(f"x{v}" for v in rng.integers(0, 50, 30)) + "\n" + passage) for i in range(0, 60, 3)]
    rows += [(7, None), (8, ""), (None, passage), (None, passage), (9, passage), (9, passage), (10, "a " * 4000), (11, "a " * 13), (12, " ".join(passage.split()[:13]))]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, group string").repartition(5)
    out = substring.dedup_substrings(docs, batches=batches).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out), key=str)
    assert got == brute(rows)
    assert substring.dedup_substrings(docs.limit(0)).count() == 0
