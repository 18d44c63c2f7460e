"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from docketry.llm.quality import QualityRules

_WORDS = "w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)"
_PLACES = "p AS (SELECT doc_id, ws, len(ws) AS n, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w)"


def substring_sql(n: int = 13) -> str:
    """Operator 3: windows, the smallest document of each, and the words that flagged windows cover."""
    return (
        f"WITH {_WORDS}, {_PLACES}, "
        f"k AS (SELECT doc_id, i, word, CASE WHEN i + {n - 1} <= n THEN array_to_string(ws[i:i + {n - 1}], ' ') END AS gram FROM p), "
        "f AS (SELECT doc_id, i, word, gram IS NOT NULL AND MIN(doc_id) OVER (PARTITION BY gram) < doc_id AS flag FROM k), "
        f"c AS (SELECT doc_id, i, word, bool_or(flag) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS gone FROM f), "
        "d AS (SELECT doc_id, COUNT(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id) "
        "SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN d USING (doc_id)"
    )


def quality_sql(rules: QualityRules | None = None) -> str:
    """Operator 4: repeated windows of each length, repeated lines, and the verdict."""
    rules = rules or QualityRules()
    sizes = sorted({*rules.gram_limits, rules.repeat_window})
    twice = ", ".join(f"i + {n - 1} <= n AND COUNT(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {n - 1}], ' ')) > 1 AS r{n}" for n in sizes)
    inside = ", ".join(f"bool_or(r{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in sizes)
    sums = ", ".join(f"coalesce(SUM(len(word)) FILTER (WHERE c{n}), 0) AS chars{n}" for n in sizes)
    too_many = " OR ".join(f"n_words >= {rules.min_grams_words} AND chars{n} > {limit}::DOUBLE * word_chars" for n, limit in rules.gram_limits.items())
    window = rules.repeat_window
    return (
        f"WITH {_WORDS}, {_PLACES}, r AS (SELECT doc_id, i, word, {twice} FROM p), c AS (SELECT doc_id, word, {inside} FROM r), "
        f"g AS (SELECT doc_id, COUNT(*) FILTER (WHERE c{window}) AS repeats, SUM(len(word)) AS chars, {sums} FROM c GROUP BY doc_id), "
        "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM w), "
        "u AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')), "
        "d AS (SELECT doc_id, COUNT(*) AS dups, SUM(len(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_chars FROM u WHERE nth > 1 GROUP BY doc_id), "
        "a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, "
        f"coalesce(dups, 0) AS n_dup_lines, coalesce(repeats, 0) AS n_repeat_words, coalesce(dup_chars, 0) AS dup_chars, {', '.join(f'coalesce(chars{n}, 0) AS chars{n}' for n in sizes)} "
        "FROM w LEFT JOIN g USING (doc_id) LEFT JOIN d USING (doc_id)), "
        f"b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM a) "
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
        f"NOT (base_failed OR {too_many} OR dup_chars > {rules.line_chars_limit}::DOUBLE * word_chars OR n_symbols > {rules.symbols_per_word}::DOUBLE * n_words) AS kept FROM b"
    )


#: Operator 6: all pairs of a label by cosine, and the smallest vector that links reach.
EMBEDDINGS_SQL = (
    "WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL "
    "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93), "
    "c AS (SELECT vec_id AS src, vec_id AS dst FROM v UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst) "
    "SELECT vec_id, (SELECT COUNT(*) FROM e WHERE src = vec_id) AS n_links, coalesce((SELECT MIN(dst) FROM c WHERE src = vec_id), vec_id) AS component_id, "
    "coalesce((SELECT MIN(dst) FROM c WHERE src = vec_id), vec_id) = vec_id AS kept FROM embeddings"
)
