"""Replies of a classifier: each reason, by hand."""

from docketry.functions.replies import read_replies

GOOD = '{"outcome": "granted", "motion_type": "msj", "confidence": 0.9}'


def test_each_reason(spark):
    reply = lambda o='"granted"', m='"msj"', c="0.9": f'{{"outcome": {o}, "motion_type": {m}, "confidence": {c}}}'
    cases = [
        ("t", GOOD, None, False), ("t", f"\n {GOOD}\t", None, False), ("t", reply(c="0.7"), None, False), ("t", reply(c="0.69"), None, True),
        ("t", reply(c='"0.8"'), None, False), ("t", reply(c="1"), None, False), ("t", reply(c="0"), None, True), ("t", GOOD[:-1] + ', "why": [1]}', None, False),
        (None, GOOD, "empty_text", True), (" \n", GOOD, "empty_text", True), ("t", None, "malformed_json", True), ("t", "", "malformed_json", True),
        ("t", "granted", "malformed_json", True), ("t", "[1]", "malformed_json", True), ("t", "null", "malformed_json", True), ("t", GOOD + "!", "malformed_json", True),
        ("t", GOOD + "," + GOOD, "malformed_json", True), ("t", GOOD + "] [1", "malformed_json", True), ("t", GOOD + "} {", "malformed_json", True), ("t", "{}", "missing_key", True), ("t", '{"outcome": "granted", "motion_type": "msj"}', "missing_key", True), ("t", reply(c="null"), "missing_key", True),
        ("t", reply(o='"Granted"'), "bad_outcome", True), ("t", reply(o="1"), "bad_outcome", True), ("t", reply(o="[]"), "bad_outcome", True), ("t", reply(m='"osc"'), "bad_motion_type", True),
        ("t", reply(c="1.01"), "bad_confidence", True), ("t", reply(c="-0.1"), "bad_confidence", True), ("t", reply(c='"high"'), "bad_confidence", True), ("t", reply(c="{}"), "bad_confidence", True),
    ]
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _, _) in enumerate(cases)], "id int, ruling_text string, reply string")
    got = {r.id: r for r in read_replies(df).collect()}
    wrong = [(cases[i], r.reason, r.needs_review) for i, r in got.items() if (r.reason, r.needs_review) != cases[i][2:]]
    assert wrong == []
    assert all((r.classified is None) == (r.reason is not None) for r in got.values()) and tuple(got[4].classified) == ("granted", "msj", 0.8)
    assert read_replies(df.limit(0)).count() == 0
