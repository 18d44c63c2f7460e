"""Operator 9 by held-out accuracy and by obfuscated words."""

import zlib

import numpy as np
import pytest

from docketry.llm import queries as q
from docketry.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    words = ["river", "stone", "window", "garden", "letter", "music", "market", "winter", "paper", "silver", "engine", "harbor"]
    rows, labels = [], []
    for i in range(600):
        text = [str(w) for w in rng.choice(words, 30)]
        bad = i % 6 == 0
        if bad:
            text.insert(int(rng.integers(30)), ["rotten", "vermin"][i // 6 % 2])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_restores_and_scores(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels)
    assert {"=rotten", "=vermin"} <= set(model.weights) | {"=" + f[1:] for f in model.weights}
    odd = ["r0tten stone", "v e r m i n", "v.e.r.m.i.n", "rottten river", "V3RM1N!!", "river stone", "", None, "77 11 !!", "a " * 9000 + "rotten"]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table, model).collect()}
    assert all(got[i] >= 0.5 for i in (0, 1, 2, 3, 4, 9)) and all(got[i] < 0.3 for i in (5, 6, 7, 8))
    assert toxicity.score_toxicity(table.limit(0), model).count() == 0


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels = corpus
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_toxicity(docs, labels).weights == toxicity.fit_toxicity(docs, turned).weights
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_no_labels(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels.limit(0))
    assert not model.weights and {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in q.op9_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hits = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert hits >= 0.8 * sum(labels[r.doc_id] for r in rows) and hits >= 0.85 * sum(r.predicted for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_form_of_the_channel(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels)
    bad = ["vverrminn", "v. e. r. m. i. n.", "(v) e, r, m i n", "ve rm in", "river ver min, stone", "r0 tt en", "rrotten"]
    fine = ["river stone", "a b", "77 11 !!", "2024 455 @$$", "in it is a"]
    table = spark.createDataFrame(list(enumerate([*bad, *fine])), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table, model).collect()}
    assert [t for i, t in enumerate(bad) if got[i] < 0.5] == [] and [t for i, t in enumerate(fine, len(bad)) if got[i] >= 0.3] == []


def test_tokens_without_a_letter():
    text = " ".join(["glass", "class", "assess", "boss", "ass"] * 50)
    counts = np.zeros(toxicity.SYMBOLS**3, dtype=np.int64)
    for w in text.split():
        x = [0, 0, *(toxicity.LETTERS.index(c) + 1 for c in w), 0]
        for a, b, c in zip(x, x[1:], x[2:]):
            counts[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    scorer = toxicity.Scorer(toxicity.ToxicityModel(counts))
    assert all("ass" in scorer.readings(w) for w in ("@$$", "455", "@$$!", "4$5."))


def test_tokens_without_room_have_no_features():
    """Leaving out tokens and joined fragments by their beginnings loses nothing: random writings of words of the
    features and of others have the same features with and without it."""
    rng = np.random.default_rng(5)
    words = ["vermin", "rotten", "rot", "verse", "bookish", "open", "in", "aab"]
    counts = np.zeros(toxicity.SYMBOLS**3, dtype=np.int64)
    for w in words * 20:
        x = [0, 0, *(toxicity.LETTERS.index(c) + 1 for c in w), 0]
        for a, b, c in zip(x, x[1:], x[2:]):
            counts[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    model = toxicity.ToxicityModel(counts)
    wanted = frozenset({"=vermin", "^verm", "=rotten", "^rotte", "=aab", "=bookish", "=in"})
    swaps = {"o": "0", "e": "3", "i": "1", "r": "rr", "t": "+", "v": "V", "s": "$", "b": "8"}
    plain, sifted = toxicity.Scorer(model), toxicity.Scorer(model, wanted)
    met = set()
    for _ in range(400):
        text = []
        for w in rng.choice(words, 4):
            letters = [swaps.get(c, c) if rng.random() < 0.25 else c for c in str(w)]
            cuts = [c + (" " if rng.random() < (0.5 if w != "in" else 0.1) else "") for c in letters]
            text.append(str(rng.choice(["", "(", "\"", "!"])) + "".join(cuts) + str(rng.choice(["", ".", "!!", ","])))
        got = sifted.features(" ".join(text))
        assert got == plain.features(" ".join(text)) & wanted
        met |= got
    assert met == wanted


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "rotten stone"), (1, "rotten stone"), (None, "river"), (None, None), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = q.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)


def test_marks_around_a_fragment_may_be_many(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels)
    table = spark.createDataFrame([(1, "((((((ve)))))) rm... in"), (2, "......v...... e r m i n")], "doc_id long, text string")
    assert all(r.score >= 0.5 for r in toxicity.score_toxicity(table, model).collect())
