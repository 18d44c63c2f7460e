"""What the operators promise of their methods: exact draws, file layout, tokenizer files, growing indexes, odd columns."""

import time

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docketry.llm import bpe, draws, embeddings, mixing, sharding, simhash, substring, tokens, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_draws_have_the_hypergeometric_law():
    rng = np.random.default_rng(3)
    for good, bad, n in [(30, 70, 20), (5, 3, 7), (1000, 9000, 400), (2, 100_000, 50_000)]:
        mine = [draws.hypergeometric(rng, good, bad, n) for _ in range(20_000)]
        theirs = rng.hypergeometric(good, bad, n, 20_000)
        top = max(*mine, *theirs) + 1
        a, b = np.cumsum(np.bincount(mine, minlength=top)), np.cumsum(np.bincount(theirs, minlength=top))
        assert np.abs(a - b).max() / 20_000 < 0.02
    assert draws.hypergeometric(rng, 0, 5, 3) == 0 and draws.hypergeometric(rng, 5, 0, 3) == 3


def test_draws_beyond_numpys_limit():
    rng = np.random.default_rng(4)
    counts = np.array([10**11, 3 * 10**11, 0, 10**9])
    sent = np.array([draws.multivariate_hypergeometric(rng, counts, 200_000) for _ in range(300)])
    want = 200_000 * counts / counts.sum()
    assert (sent.sum(axis=1) == 200_000).all() and (sent[:, 2] == 0).all()
    assert (np.abs(sent.mean(axis=0) - want) <= 5 * np.sqrt(want / 300) + 1e-9).all()
    matrix = np.array(sharding.communication_matrix([200_000] * 5 + [7 * 10**9 - 10**6], [7 * 10**9 // 24 + (s < 7 * 10**9 % 24) for s in range(24)], 1))
    assert (matrix.sum(axis=1)[:5] == 200_000).all() and matrix.sum() == 7 * 10**9


def test_sharding_is_uniform_and_replaces_columns(spark):
    rows = spark.range(4000).select("id", F.lit("old").alias("shard"), F.lit(1).alias("slot"), (F.col("id") % 3).alias("rank"), F.lit(None).cast("int").alias("block"))
    where = []
    for seed in range(3):
        out = sharding.shard_uniformly(rows, n_shards=8, seed=seed, rows_per_block=700)
        assert out.columns == ["id", "rank", "block", "shard", "slot"]
        found = out.select("id", "shard", "slot").collect()
        assert sorted((r.shard, r.slot) for r in found) == [(s, i) for s in range(8) for i in range(500)]
        where.append(found)
    # rows of the first, middle and last thousand stand in every shard, and early and late in it, about as often
    for found in where:
        for low in (0, 1500, 3000):
            part = [r for r in found if low <= r.id < low + 1000]
            per_shard = np.bincount([r.shard for r in part], minlength=8)
            assert abs(per_shard - 125).max() < 6 * 125**0.5
            assert abs(sum(r.slot < 250 for r in part) - 500) < 6 * 250**0.5


def test_write_shards(spark, tmp_path):
    sharding.write_shards(spark.range(100).withColumn("text", F.col("id").cast("string")), str(tmp_path / "s"), n_shards=4)
    out = spark.read.parquet(str(tmp_path / "s"))
    assert out.count() == 100 and {r.shard: r.n for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(4), 25)


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 5, "a" if i % 2 else "b", i, "x") for i in range(40)], "doc_id long, text string, source string, mix_row int, mix_shard string")
    out = mixing.mix_sources(docs, shards=2)
    assert out.columns == docs.columns and {r.mix_shard for r in out.collect()} == {"x"}
    assert {r.mix_shard for r in mixing.mix_sources(docs, keep_shard=True, shards=2).collect()} == {0, 1}
    empty = docs.limit(0)
    assert mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_layout_of_token_files(spark, tmp_path, encoding):
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 40) for i in range(3000)], "doc_id long, text string").coalesce(1)
    path = str(tmp_path / encoding)
    tokens.write_tokens(docs, TOKENIZER, path, encoding=encoding, row_group_bytes=1 << 16, page_bytes=16 << 10, page_rows=200)
    groups = pages = 0
    for file in sorted((tmp_path / encoding).glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            groups += 1
            column = next(group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema.startswith("tokens"))
            assert column.has_offset_index and next(group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == "doc_id").has_column_index
            wanted = {"dictionary": {"PLAIN_DICTIONARY", "RLE_DICTIONARY"}, "delta": {"DELTA_BINARY_PACKED"}}[encoding]
            assert wanted & set(column.encodings) and group.total_byte_size <= 8 << 20
            pages += group.num_rows > 200
    assert groups >= 3 and pages
    some = tokens.read_tokens(spark, path, first=100, last=120)
    assert some.count() == 21 and "tokens" not in tokens.read_tokens(spark, path, tokens=False).columns


def test_other_tokenizer_files_are_refused(tmp_path):
    for name in ("byte_bpe_50k.json",):
        for kind in (bpe.LibraryTokenizer, bpe.WordTokenizer):
            with pytest.raises(ValueError):
                kind(public_tokenizers.path(name))


def test_vectors_of_rare_lengths_and_sizes(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], 1) for i in range(60)]
    rows += [(100, [1.0, 2.0], 1), (101, [2.0, 4.0], 1), (102, [2.0, -1.0], 1), (103, [1e-200, 2e-200], 1), (104, [1e200, 2e200], 1), (105, [0.0, 0.0], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(docs, sample_rows=8).collect()}
    assert {got[v] for v in (100, 101, 103, 104)} == {(3, 100)} and got[102] == (0, 102) and got[105] == (0, 105)


def test_index_grows_by_runs(spark):
    """Four batches: runs pile up to the fan-out, are compacted with the next batch, and each batch meets all before it."""
    texts = [" ".join(f"t{b}w{i}" for i in range(60)) for b in range(4)]
    index = substring.FingerprintIndex(spark, n_words=13, buckets=16, groups=16, fanout=2)
    shared = " ".join(f"shared{i}" for i in range(30))
    seen, runs = [], []
    for b in range(4):
        docs = spark.createDataFrame([(10 * b, texts[b]), (10 * b + 1, shared)], "doc_id long, text string")
        hits = index.ingest(docs)
        seen.append(sorted({int(d) for r in hits.collect() for d in substring.unpack(bytes(r.docs), "<i8")}))
        runs.append(len(index.runs))
    index.drop()
    assert seen == [[], [11], [21], [31]] and runs == [1, 2, 1, 2]


def test_groups_of_documents_are_the_same_in_both_places(spark):
    ids = [0, 1, 5, 256, 1 << 20, (1 << 62) + 77, -3, -(1 << 40), *(1000 * i for i in range(200))]
    native = [r.g for r in spark.createDataFrame([(i,) for i in ids], "d long").select(substring.group_of(F.col("d"), 1000).alias("g")).collect()]
    for d, g in zip(ids, native):
        assert [x for x, *_ in substring._group_rows(np.array([d]), np.array([1], dtype=np.uint64), 1000)] == [g]
    assert len(set(native[8:])) > 100


def test_one_document_a_group_with_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (3, None)], "doc_id long, text string")
    kept = simhash.keep_one_per_group(docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 1, 3] and kept.columns == docs.columns
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0


def test_long_odd_tokens_take_time_in_proportion():
    restorer = toxicity.Restorer(np.ones(toxicity.SYMBOLS**3, dtype=np.int64))
    took = []
    for n in (2_000, 16_000):
        began = time.process_time()
        assert restorer.restore("ab4" * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def test_restore_against_all_readings():
    """Viterbi gives the cheapest readings, here against every way through the lattice."""
    rng = np.random.default_rng(6)
    restorer = toxicity.Restorer(rng.integers(0, 50, toxicity.SYMBOLS**3))

    def every(token):
        ways = [(0.0, "", (0, 0))]
        before = ""
        for char in token:
            ways = [
                (s + price + (restorer.cost[a, b, to] if to else 0.0), w + (toxicity.LETTERS[to - 1] if to else ""), (b, to) if to else (a, b))
                for s, w, (a, b) in ways for to, price in restorer.choices(char, before)
            ]
            before = char
        best = {}
        for s, w, (a, b) in ways:
            if w:
                best[w] = min(best.get(w, 1e9), s + restorer.cost[a, b, 0])
        return sorted(best, key=best.get)[:3]

    for token in ("b4d", "h3ll0", "ss!ck", "v1le1", "(00l", "6ood", "aab b4"):
        assert restorer.restore(token) == every(token)
