"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import hashlib
from collections import Counter

import corpus_pipeline
from tests.llm.test_dealt_operators import WORD, bpe_row, components, fingerprint, library, quality_row, targets
from tests.llm.test_lines import brute

from docketry.llm.common import materialize, read_table


def test_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, d: materialize(stages[name](spark, d, sf), "test")
    rows = {r.doc_id: r for r in docs.collect()}

    good = run("quality_rules", docs)
    kept = {r.doc_id: r for r in good.collect()}
    assert good.columns == columns and set(kept) == {d for d, r in rows.items() if quality_row(r.text)[-1]}

    deduped = run("line_dedup", good)
    got = {r.doc_id: r for r in deduped.collect()}
    want = brute([(d, r.text) for d, r in kept.items()])
    assert deduped.columns == columns
    wrong = 0
    for d, r in kept.items():
        n, gone = want[d]
        text = None if len(gone) == n else "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in set(gone))
        wrong += text != (got[d].text if d in got else None)
    assert wrong <= 0.01 * len(kept) and all(r.n_chars == len(r.text) for d, r in got.items() if r.text != kept[d].text)

    single = run("simhash_near_dedup", deduped)
    ids = sorted(got)
    groups = components(ids, [fingerprint(got[d].text) for d in ids], 2)
    left = {r.doc_id: r for r in single.collect()}
    assert single.columns == columns and set(left) == set(groups) and left == {d: got[d] for d in left}

    mix = run("mixing", single)
    size = {d: len(WORD.findall(r.text)) for d, r in left.items()}
    sizes, taken = Counter(), Counter()
    for d, r in left.items():
        sizes[r.source] += size[d]
    times = Counter(r.doc_id for r in mix.collect())
    for d, n in times.items():
        assert n <= 2
        taken[left[d].source] += n * size[d]
    assert mix.columns == columns and all(abs(taken[s] - t) <= max(size.values()) for s, t in targets(sizes).items())

    tokens = run("bpe", mix).collect()
    assert Counter(r.doc_id for r in tokens) == times
    t = library()
    for r in tokens:
        assert (r.n_tokens, r.decoded_sha256) == bpe_row(t, left[r.doc_id].text)[::2]
        assert hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest() == bpe_row(t, left[r.doc_id].text)[1]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0
