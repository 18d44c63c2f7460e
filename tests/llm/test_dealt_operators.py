"""Operators 2, 4, 5, 7, 8 and 10 against brute force, on whole tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from docketry.llm import bpe, common, mixing, quality, sharding, simhash, tokens
from docketry.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, " \n\t "),
    (5, "alpha beta gamma delta epsilon zeta eta theta"), (6, "ÀÉ İstanbul ǅ 漢字 <|endoftext|> it's 100% naïve space\x85next\x1cfs"),
    (7, "x " * 5000), (8, "line one\nline one\n\nline two\r\nline two\n" * 30), (9, "word"), (10, "á é ｆｕｌｌ don't WE'LL __ §§"),
    (11, None), (11, "repeated id"), (11, "repeated id"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, None if d % 3 == 0 else f"s{d % 2}", 7, "x") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard_hint int, n_words string")


def docs_of(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in common.read_table(spark, sf, "documents").collect()]


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def components(ids, prints, radius):
    """The smallest id reachable from each row."""
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    parent = list(range(len(ids)))  # places in the order

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[order[i]] ^ prints[order[j]]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    found = {row: ids[order[find(i)]] for i, row in enumerate(order)}
    return [found[i] for i in range(len(ids))]


def check_simhash(rows, out):
    prints = [fingerprint(t) for _, t, *_ in rows]
    want = components([d for d, *_ in rows], prints, 2)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in out.collect())
    assert got == sorted((r[0], f"{p:016x}", w) for r, p, w in zip(rows, prints, want))


def test_simhash_whole_table(spark, sf):
    check_simhash(docs_of(spark, sf), q.op2_simhash_near_dedup(spark, sf))


def test_simhash_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    out = simhash.simhash_components(odd).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    check_simhash(ODD, out)
    kept = [r.doc_id for r in simhash.keep_one_per_group(odd).collect()]
    assert set(kept) >= {r.component_id for r in out.collect()} and not {3, 4, 5} & set(kept)
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_simhash_splits_crowded_keys(spark):
    rng = np.random.default_rng(3)
    values = list({int(v) for v in rng.integers(0, 1 << 12, 600)} | {int(v) << 50 for v in rng.integers(0, 1 << 12, 200)})
    rows = [(v - (v >> 63 << 64), i) for i, v in enumerate(values)]
    from docketry.llm.graph import connected_components

    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, id long"), 2, 3, shard_rows=37)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    want = components(list(range(len(values))), values, 2)
    assert [roots.get(i, i) for i in range(len(values))] == want


def quality_row(text):
    words = WORD.findall(text or "")
    repeat = {}
    for n in (8, 4, 5, 6, 10):
        count = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = {j for i in range(len(words) - n + 1) if count[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        repeat[n] = (len(inside), sum(len(words[j]) for j in inside))
    seen, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, WORD.findall(line)))
            seen.add(line)
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 20 or 100 * repeat[8][0] > 30 * len(words)
    limits = quality.QualityRules().gram_limits
    kept = not failed and not any(repeat[n][1] > x * chars for n, x in limits.items()) and dup_chars <= 0.3 * chars and symbols <= 0.3 * len(words)
    return len(words), chars, symbols, dup, repeat[8][0], failed, kept


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_quality_whole_table(spark, sf):
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in q.op4_quality_rules(spark, sf).collect()}
    assert got == {d: quality_row(t) for d, t, _ in docs_of(spark, sf)}


def test_quality_odd_rows(spark, odd):
    got = sorted((r.doc_id, *(r[n] for n in NAMES)) for r in quality.score_quality(odd).collect())
    assert got == sorted((d, *quality_row(t)) for d, t in ODD)
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(odd.limit(0)).count() == 0


def check_shards(out, rows, n_shards):
    got = out.collect()
    assert len(got) == rows
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(n_shards)) <= 1
    for s in range(n_shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes.get(s, 0)))
    return got


def test_sharding_whole_table(spark, sf):
    got = check_shards(q.op5_sharding(spark, sf), 200, 24)
    text = {d: (t or "").encode() for d, t, _ in docs_of(spark, sf)}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id])) for r in got)


def test_sharding_odd_rows(spark, odd):
    check_shards(sharding.shard_uniformly(odd, n_shards=5, rows_per_block=4), len(ODD), 5)
    assert sharding.shard_uniformly(odd.limit(0)).count() == 0
    again = sharding.shard_uniformly(sharding.shard_uniformly(odd, n_shards=5), n_shards=3)  # columns of these names are replaced
    assert again.columns == [*odd.columns, "shard", "slot"]
    check_shards(again, len(ODD), 3)


def test_communication_matrix_adds_up():
    matrix = np.array(sharding.communication_matrix([5, 0, 17, 9], [8, 8, 8, 7], 1))
    assert matrix.sum(axis=1).tolist() == [5, 0, 17, 9] and matrix.sum(axis=0).tolist() == [8, 8, 8, 7]


def bpe_row(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, dtype="<u4").tobytes()
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def library():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_bpe_whole_table(spark, sf):
    t = library()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.op8_bpe(spark, sf).collect()}
    assert got == {d: bpe_row(t, x) for d, x, _ in docs_of(spark, sf)}


def test_bpe_odd_rows(spark, odd):
    t = library()
    out = bpe.encode_decode(odd, TOKENIZER, ("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    for r, (d, x) in zip(sorted(out, key=lambda r: (r.doc_id, r.ids_sha256)), sorted(ODD, key=lambda y: (y[0], bpe_row(t, y[1])[1]))):
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (d, *bpe_row(t, x)), x
    plain = bpe.encode_decode(odd, TOKENIZER).where("doc_id = 1").first()
    assert plain.ids == t.encode(ODD[0][1], add_special_tokens=False).ids and plain.decoded == t.decode(plain.ids)


def token_rows(rows):
    t, start, out = library(), 0, []
    for d, x, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_output_whole_table(spark, sf):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in q.op7_token_output(spark, sf).collect())
    assert got == token_rows(docs_of(spark, sf))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_selective_read(spark, odd, tmp_path, encoding):
    rows = odd.where("doc_id < 11")
    tokens.write_tokens(rows, TOKENIZER, str(tmp_path / "t"), encoding=encoding)
    got = [tuple(r) for r in tokens.token_digest(spark, str(tmp_path / "t")).orderBy("doc_id").collect()]
    assert got == token_rows([r for r in ODD if r[0] < 11])
    some = tokens.read_tokens(spark, str(tmp_path / "t"), first=3, last=4, tokens=False)
    assert sorted(r.doc_id for r in some.collect()) == [3, 4] and "tokens" not in some.columns
    tokens.write_tokens(rows.limit(0), TOKENIZER, str(tmp_path / "e"))
    assert tokens.token_digest(spark, str(tmp_path / "e")).count() == 0


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, total = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mixing_whole_table(spark, sf):
    rows = docs_of(spark, sf)
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    sizes = Counter()
    for d, _, s in rows:
        sizes[s] += size[d]
    want, source = targets(sizes), {d: s for d, _, s in rows}
    got = q.op10_mixing(spark, sf).collect()
    taken = Counter()
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    longest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    again = {(r.doc_id, r.taken) for r in q.op10_mixing(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mixing_odd_rows(spark, odd):
    plan = mixing.mixing_plan(odd, shards=3, block_rows=2).collect()
    assert len(plan) == len(ODD) and all(len(r.shards) == r.copies for r in plan)
    mix = mixing.mix_sources(odd, shards=3, block_rows=2)
    assert mix.columns == odd.columns and mix.count() == sum(r.copies for r in plan)
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_mixing_in_parts(spark, odd, monkeypatch):
    whole = mixing.mix_sources(odd, shards=1, keep_shard=True).collect()
    monkeypatch.setattr(mixing, "ROWS_PER_PART", 3)
    assert sorted(map(str, mixing.mix_sources(odd, shards=1, keep_shard=True).collect())) == sorted(map(str, whole))


def test_split_quotas_add_up():
    quota = mixing.split_quotas([10, 0, 3, 40], 7, 1)
    assert quota.sum(axis=1).tolist() == [10, 0, 3, 40] and quota.sum(axis=0).max() - quota.sum(axis=0).min() <= 1
