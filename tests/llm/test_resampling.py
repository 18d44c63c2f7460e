"""Operator 13 against brute force; the registered query also against DuckDB."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from docketry.llm import queries as q
from docketry.llm import resampling
from docketry.llm.common import read_table
from docketry.operators.ordering import number_all

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5, least=20):
    count = lambda texts: np.bincount([b for t in texts for b in features(t)[1]], minlength=10_000)
    s, t = count(x for _, x in docs), count(target)
    gains = [math.floor(1000 * math.log((t[b] + 1) * float(s.sum() + 10_000) / ((s[b] + 1) * float(t.sum() + 10_000)))) for b in range(10_000)]
    out = []
    for d, text in docs:
        n, found = features(text)
        weight = sum(gains[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0]))
    places = {}
    for k, x in enumerate(fit):
        places.setdefault(x, []).append(k + 1 if k < percent * len(fit) // 100 else None)
    return sorted(((*x, places[x].pop(0) if x in places else None) for x in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    want = {x[0]: x[2:] for x in brute(docs, [r.text for r in read_table(spark, sf, "benchmark").collect()])}
    got = q.op13_resampling(spark, sf).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == want and len(got) == len(docs)


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = q.op13_resampling(spark, sf)
    assert sorted(map(str, con.sql(q.ORACLE_SQL["op13_resampling"]).fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977} Ünï{k % 31}" for k in range(150_000))
    docs = [(1, None), (2, ""), (3, "A-b\x00c 12_3 É"), (4, "x " * 25), (4, "x " * 25), (None, "y " * 30), (5, "z " * 19), (6, long), (7, "q" * 3_000_000 + " end"), *((10 + k, f"tie of words {k} " * 6) for k in range(90))]
    target = ["tie of words 7", "x x x", None]
    table = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, n int, bucket int")
    want = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows_of(resampling.resample(table, want)) == brute(docs, target)
    assert resampling.resample(table.limit(0), want).collect() == []
    none = resampling.resample(table.where("doc_id in (1, 2)"), want.limit(0))
    assert [(r.n_features, r.weight, r["rank"]) for r in none.collect()] == [(0, 0, None)] * 2


def test_stretches_of_a_long_text():
    text = b"one two THREE-four " * 200 + b"x" * 500 + b" tail"
    cut = list(resampling._stretches(text, 3, 64))
    assert len(cut) > 30
    whole = [w.lower() for w in resampling._WORD_BYTES.findall(text)]
    got = []
    for carried, stretch in cut:
        words = resampling._WORD_BYTES.findall(stretch)
        assert words[:carried] == (got[-carried:] if carried else [])
        got += words[carried:]
    assert got == whole


def test_numbers_of_all_rows(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5000 as v").repartition(6)
    got = number_all(df, [df.v.desc()]).collect()
    assert sorted((r.v, r.row_no) for r in got) == [(v, 5000 - v) for v in range(5000)]
    assert number_all(df.limit(0), [df.v.desc()]).collect() == []


def test_checksums_are_joined():
    """Only distinct words are hashed as strings; every n-gram once was."""
    texts = ["one two three one two three one two", "", "é ü one", "x" * 300 + " two " + "y" * 70_000, "- -"]
    calls = []
    con = resampling._connect()
    con.register("step", pa.table({"place": pa.array(range(len(texts)), pa.int32()), "carried": pa.array([0, 0, 1, 0, 0], pa.int32()), "text": texts}))
    crc32 = zlib.crc32
    try:
        resampling.zlib.crc32 = lambda x, *start: calls.append(x) or crc32(x, *start)
        got = con.execute(resampling._ngram_sql(3, 10_000)).fetchall()
    finally:
        resampling.zlib.crc32 = crc32
    assert len(calls) <= len({w for t in texts for w in WORD.findall(t)})
    want = {}
    for place, text in enumerate(texts):
        words = WORD.findall(text)
        for k in range(3):
            for i in range(len(words) - k):
                if i + k >= (place == 2):
                    cell = want.setdefault((place, crc32(" ".join(words[i : i + k + 1]).encode()) % 10_000), [0, 0])
                    cell[0], cell[1] = cell[0] + 1, cell[1] + (k == 0)
    assert sorted(got) == sorted((*at, *cell) for at, cell in want.items())


def test_joined_checksums_of_any_length():
    parts = [(b"", b""), (b"a", b""), (b"", b"bc"), (b"one ", b"two"), (b"x" * 999, b"\x00" * 70_001)]
    number = lambda of: np.array([zlib.crc32(x) for x in of], np.uint32)
    got = resampling.join_crc(number(a for a, _ in parts), number(b for _, b in parts), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts] and resampling.join_crc(number([]), number([]), np.array([], int)).tolist() == []
