"""DuckDB SQL of operator 13: CRC-32 by its table, over the bytes of every distinct n-gram."""

from __future__ import annotations


def _table() -> list[int]:
    """CRC-32 of single bytes by the reflected polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def resampling_sql(percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    def grams(name: str, source: str) -> str:
        return (
            f"{name}w AS MATERIALIZED (SELECT id, ws, unnest(generate_series(1, len(ws))) AS i FROM {source}), "
            f"{name} AS MATERIALIZED (SELECT id, array_to_string(ws[i:i + k], ' ') AS gram, COUNT(*) AS n FROM {name}w, range(3) r(k) WHERE i + k <= len(ws) GROUP BY 1, 2)"
        )

    step = f"xor(c >> 8, {_table()}[(xor(c, b) & 255) + 1])"
    bytes_of = "list_transform(range(0, len(x), 2), lambda k: CAST('0x' || x[k + 1:k + 2] AS BIGINT))"
    crc = f"xor(list_reduce({bytes_of}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295) % {buckets}"
    gain = f"CAST(floor(1000 * ln((t + 1)::DOUBLE * (SUM(s) OVER () + {buckets})::DOUBLE / ((s + 1)::DOUBLE * (SUM(t) OVER () + {buckets})::DOUBLE))) AS BIGINT)"
    uniform = f"(('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE"
    return (
        f"WITH d AS MATERIALIZED (SELECT doc_id AS id, {words} AS ws FROM documents), q AS MATERIALIZED (SELECT item_id AS id, {words} AS ws FROM benchmark), "
        f"{grams('dg', 'd')}, {grams('qg', 'q')}, h AS MATERIALIZED (SELECT gram, hex(encode(gram)) AS x FROM (SELECT gram FROM dg UNION SELECT gram FROM qg)), "
        f"b AS MATERIALIZED (SELECT gram, {crc} AS bucket FROM h), "
        "c AS (SELECT bucket, SUM(s) AS s, SUM(t) AS t FROM (SELECT gram, n AS s, 0 AS t FROM dg UNION ALL SELECT gram, 0, n FROM qg) JOIN b USING (gram) GROUP BY 1), "
        f"all_b AS (SELECT r.bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range({buckets}) r(bucket) LEFT JOIN c USING (bucket)), "
        f"g AS MATERIALIZED (SELECT bucket, {gain} AS gain FROM all_b), "
        "f AS (SELECT id, SUM(n) AS n_features, SUM(n * gain) AS weight FROM dg JOIN b USING (gram) JOIN g USING (bucket) GROUP BY 1), "
        "v AS (SELECT d.id AS doc_id, len(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight FROM d LEFT JOIN f ON f.id = d.id), "
        f"p AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln({uniform}))) AS BIGINT) AS score FROM v), "
        f"k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, COUNT(*) OVER () AS n FROM p WHERE n_words >= {least_words}) "
        f"SELECT p.doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank FROM p LEFT JOIN k ON k.doc_id = p.doc_id"
    )
