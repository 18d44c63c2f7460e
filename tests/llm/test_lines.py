"""Operator 1 against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from docketry.llm import lines
from docketry.llm import queries as q
from docketry.llm.common import read_table

K = 8


def shingles(line):
    low = line.lower()
    return {low[i : i + K] for i in range(len(low) - K + 1)} if len(line) >= K else {line}


def brute(rows):
    """Removed lines of each document, and how many lines with a word it has."""
    places, kinds = [], {}
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            x = x.strip(" \t\r\f\v")
            if x:
                places.append((float("inf") if d is None else d, n, d, x))
                kinds.setdefault(x, len(kinds))
    names, parent = list(kinds), list(range(len(kinds)))
    sets = [shingles(x) for x in names]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in lists[g]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, shared in seen.items():
            short = len(names[i]) < K or len(names[j]) < K
            if not short and shared >= 0.8 * (len(s) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    first = {}
    for order, n, d, x in sorted(places, key=lambda p: p[:2]):
        first.setdefault(find(kinds[x]), (order, n))
    removed, count = {}, {}
    for order, n, d, x in places:
        count[d] = count.get(d, 0) + 1
        if first[find(kinds[x])] < (order, n):
            removed.setdefault(d, []).append(n)
    return {d: (count.get(d, 0), sorted(removed.get(d, []))) for d, _ in rows}


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_lines, set(r.removed_lines)) for r in q.op1_line_dedup(spark, sf).collect()}
    want = brute(rows)
    assert {d: n for d, (n, _) in got.items()} == {d: n for d, (n, _) in want.items()}
    assert all(lines_ <= set(want[d][1]) for d, (_, lines_) in got.items())  # nothing that isn't alike
    assert sum(len(x) for _, x in got.values()) >= 0.99 * sum(len(x) for _, x in want.values())


def test_near_copies_in_large_buckets(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(400)]
    base = rng.choices(words, k=40)
    rows = []
    for i in range(150):  # one word off the middle line each: all like it, few like each other
        w = list(base)
        w[i % 40] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(rng.choices(words, k=30))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, [x.line_no for x in r.removed]) for r in lines.repeated_lines(docs, small=8).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    long = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [
        (1, f"{long}\nshort\n\n  \n{long}!"), (2, None), (3, ""), (4, long.upper() + "\r\nSHORT\nshort\nhello there"),
        (None, f"{long}\nonly here, in a text without any number"), (5, "x" * 20000), (6, "x" * 30000), (7, long), (8, "a b\n" * 500),
    ]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, line string, n_chars int")
    got = {r.doc_id: (r.n_lines, [x.line_no for x in r.removed]) for r in lines.repeated_lines(docs).collect()}
    assert got == brute(rows)
    out = {r.doc_id: r for r in lines.drop_repeated_lines(docs).collect()}
    assert lines.drop_repeated_lines(docs).columns == docs.columns
    assert out[1].text == f"{long}\nshort\n\n  " and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "" and 7 not in out and out[8].text == "a b\n"
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


def test_chains_through_the_hub_of_a_large_bucket(spark):
    """Line a is like the hub and line b is like a but not like the hub, in buckets of more than ``small`` lines."""
    rng = random.Random(7)
    base = [chr(c) for c in rng.sample(range(0x4E00, 0x9000), 600)]

    def off(line, *places):
        return [chr(0x3400 + 8 * p + rng.randrange(8)) if i in places else c for i, c in enumerate(line) for p in [i]]

    rows = [(0, "".join(base))]
    for i in range(60):  # 7 of 593 shingles change with a place: a is 0.86 to the base, b 0.86 to a and 0.73 to the base
        a = off(base, *range(i % 8 + 10, 60, 9))
        rows += [(2 * i + 1, "".join(a)), (2 * i + 2, "".join(off(a, *range(i % 8 + 310, 360, 9))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, [x.line_no for x in r.removed]) for r in lines.repeated_lines(docs, small=4).collect()}
    assert got == brute(rows)


def test_blocks_hold_every_pair(spark):
    """But for those of one label, and those that their bitmaps tell apart: lines 5 and 6 share shingles with no other."""
    texts = [(i, f"line {i} is like no other line of these twenty here" if i in (5, 6) else "all the same words stand in this line") for i in range(20)]
    texts = spark.createDataFrame([(i, t if i != 6 else t.swapcase()[::-1]) for i, t in texts], "id long, line string")
    members = [(1, i, i % 3, 20, i < 12) for i in range(20)] + [(2, i, i, 5, False) for i in range(5)]
    members = spark.createDataFrame(members, "key long, id long, label long, n long, unlike boolean").join(lines.bitmaps(texts, K), "id")
    got = sorted((r.a, r.b) for r in lines.blocks(members, 0.8, 3).collect())
    apart = [(a, b) for a in range(20) for b in range(a + 1, 20) if a < 12 and a % 3 != b % 3]
    assert got == [(a, b) for a, b in apart if not {a, b} & {5, 6}]


def test_bitmaps_rule_out_no_pair_that_is_alike(spark):
    rng = random.Random(5)
    texts = near_pairs(rng, 200, "", 150, 2) + near_pairs(rng, 100, "", 3000, 40) + ["ab" * 40, "ab" * 50]
    maps = lines.bitmaps(spark.createDataFrame(list(enumerate(texts)), "id long, line string"), K)
    both = maps.select("id", *lines.map_columns("x")).join(maps.select((F.col("id") - 1).alias("id"), *lines.map_columns("y")), "id").where("id % 2 = 0")
    assert both.count() == len(texts) // 2 == both.where(lines.may_be_alike("x", "y", 0.8)).count()


def test_rows_with_one_id(spark):
    """Repeated rows get a row each; rows with one doc_id and different texts are told apart."""
    long = "The quick brown fox jumps over the lazy dog near the river bank today"
    docs = spark.createDataFrame([(1, long), (1, long), (1, f"{long}\nanother"), (2, long)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, len(r.removed)) for r in lines.repeated_lines(docs).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (1, 2, 0), (2, 1, 1)]


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one line here", "x", 1.5, None), (2, "one line here", "y", 2.5, 3)], "doc_id long, text string, of string, `gone.at` double, gone int")
    assert lines.drop_repeated_lines(docs).collect() == [docs.collect()[0]]


def test_recall_of_the_bands():
    """Pairs of similarity 0.8 whose independent minima share no band: a few in a thousand at each level."""
    draw = np.random.default_rng(1)
    for count, bands in [(lines.MINIMA, lines.BANDS), *((f[0], lines.finer_bands(n)) for n, f in enumerate(lines.FINER))]:
        same = draw.random((100_000, count)) < 0.8
        met = np.zeros(len(same), dtype=bool)
        for places in bands:
            met |= same[:, places].all(axis=1)
        assert (~met).mean() < 0.003


def near_pairs(rng, n, common, own, edits):
    """``n`` pairs of lines of similarity 0.80 to 0.85, one after the other; all lines share what is ``common``."""
    rows = []
    while len(rows) < 2 * n:
        a = [*common, *rng.choices("abcdefghijklmnopqrstuvwxyz", k=own)]
        b = [*a]
        for p in rng.sample(range(len(common) + 5, len(a) - 5), edits):
            b[p] = rng.choice("0123456789")
        x, y = shingles("".join(a)), shingles("".join(b))
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            rows += ["".join(a), "".join(b)]
    return rows


def recall(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    gone = {r.doc_id for r in lines.repeated_lines(docs).where("size(removed) > 0").collect()}
    return sum(i in gone for i in range(1, len(rows), 2)) / (len(rows) // 2)


def test_recall_of_near_copies(spark):
    assert recall(spark, near_pairs(random.Random(11), 3000, "", 150, 2)) >= 0.995


def test_recall_of_near_copies_in_large_buckets(spark):
    rng = random.Random(12)
    common = rng.choices("abcdefghijklmnopqrstuvwxyz", k=400)
    assert recall(spark, near_pairs(rng, 150, common, 100, 6)) >= 0.97


def test_minima_over_neighbours_are_those_over_single_shingles(spark):
    texts = ["x" * n for n in range(6, 20)] + ["The quick brown fox", "Äöü jumps over", "a" * 5000 + "b", ""]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    each = lines._hashed(table, K)
    order = [F.expr(f"hash({j}, 'order')") for j in range(5)]
    want = each.groupBy("id").agg(F.array(*[F.min(F.col("h").bitwiseXOR(o)) for o in order]).alias("m"))
    assert sorted(lines.minima(table, K, 0, 5).collect()) == sorted(want.collect())


def test_no_written_table_outgrows_the_lines(spark, monkeypatch):
    """Sets of shingles, eight bytes a character, once made up most of the disk that the query took."""
    rng, written = random.Random(13), {}
    rows = near_pairs(rng, 400, "", 600, 8)

    def noted(df, label, *how):
        out = materialize(df, label, *how)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(out._scratch_path)
        written[label] = max(written.get(label, 0), files.agg(F.sum("length")).first()[0] or 0)
        return out

    materialize = lines.materialize
    monkeypatch.setattr(lines, "materialize", noted)
    assert recall(spark, rows) >= 0.99
    assert written["line-edges"] and max(written.values()) < 1.5 * sum(map(len, rows)), written


def test_lines_compared_by_text_and_by_sets(spark):
    rng = random.Random(14)
    texts = near_pairs(rng, 60, "", 150, 2) + ["ab" * 40, "ab" * 50, "short", ""]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    pairs = [(a, b) for a in range(len(texts) - 2) for b in range(a + 1, min(a + 4, len(texts) - 2))]
    sets = [shingles(x) for x in texts]
    want = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    pairs = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(map(tuple, lines.alike_by_text(pairs, table, K, 0.8).collect())) == want and len(want) >= 60
    assert sorted(map(tuple, lines.alike(pairs, table, K, 0.8).collect())) == want


def test_buckets_are_the_same_in_parts(spark):
    rng = random.Random(15)
    rows = [(i, [rng.randrange(3) for _ in range(8)], i % 2) for i in range(40)] + [(50, [7] * 8, 0), (51, [7] * 8, 0)]
    signed, bands = spark.createDataFrame(rows, "id long, m array<int>, label long"), [[0, 1, 2], [3, 4, 5], [5, 6, 7]]
    for by_id in (True, False):
        want = []
        for places in bands:
            groups = {}
            for i, m, label in rows:
                groups.setdefault(tuple(m[p] for p in places), []).append((i, i if by_id else label, m))
            want += [(i, label, len(g)) for g in groups.values() if len({x[1] for x in g}) > 1 for i, label, _ in g]
        for parts in (1, 2):
            found = lines.buckets(signed.drop("label") if by_id else signed, bands, parts)
            assert len(found) == parts and sorted((r.id, r.label, r.n) for t in found for r in t.collect()) == sorted(want)
