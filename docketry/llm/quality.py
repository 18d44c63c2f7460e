"""Quality rules (operator 4): how much of a text lies in repeated n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import TextBlock, byte_texts, covered, inside, require, scramble, steps, window_hash

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, "
    "dup_gram_chars array<long>, base_failed boolean, kept boolean"
)
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityRules:
    """Limits of the verdict.

    ``gram_limits``: for each n-gram length, the share of a text's word characters that may lie in n-grams
    found twice or more (first ones included); a gram counts only in texts of ``min_grams_words`` words or
    more.  ``line_chars_limit``: share of characters in lines that repeat an earlier line.
    ``symbols_per_word``: symbols ``#*$%&|<>`` for each word.
    """

    min_words: int = 20
    repeat_window: int = 8
    repeat_percent: int = 30
    gram_limits: dict[int, float] = field(default_factory=lambda: {4: 0.50, 5: 0.45, 6: 0.40, 8: 0.35, 10: 0.30})
    min_grams_words: int = 20
    line_chars_limit: float = 0.30
    symbols_per_word: float = 0.3


def _repeated(block: TextBlock, n: int) -> np.ndarray:
    """Words that lie in an ``n``-word window whose hash occurs twice or more in the same text."""
    grams, whole = window_hash(block.word_hash, n), inside(block.word_doc, n)
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(len(block.word_hash), dtype=bool)
    keys = grams[at] ^ scramble(block.word_doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    flags = np.zeros(len(grams), dtype=bool)
    flags[at[order[same]]] = True
    flags[at[order[same + 1]]] = True
    return covered(flags, n, len(block.word_hash))


def measure(texts: list[bytes], rules: QualityRules) -> dict[str, np.ndarray | list]:
    """The columns of ``SCHEMA`` for some texts."""
    block = TextBlock(texts, lines=True)
    n_words = block.per_doc(block.word_doc)
    # code points: bytes that don't continue one
    points = np.concatenate(([0], np.cumsum(((block.bytes & 0xC0) != 0x80) & ~block.space)))
    word_len = points[block.word_end] - points[block.word_start]
    word_chars = block.per_doc(block.word_doc, word_len)
    marks = np.concatenate(([0], np.cumsum(_SYMBOLS[block.bytes])))
    n_symbols = marks[block.ends] - marks[block.starts]

    # lines with a word that equal an earlier line of the text
    first_word = np.searchsorted(block.word_start, block.line_start)
    has_word = np.append(block.word_start, len(block.bytes))[first_word] < block.line_end
    at = np.flatnonzero(has_word)
    keys = block.line_hash[at] ^ scramble(block.line_doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    later = at[order[np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1]]
    n_dup_lines = block.per_doc(block.line_doc[later])
    dup_line_chars = block.per_doc(block.line_doc[later], points[block.line_end[later]] - points[block.line_start[later]])

    repeat = _repeated(block, rules.repeat_window)
    n_repeat = block.per_doc(block.word_doc[repeat])
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    kept, gram_chars = ~failed, []
    for n, limit in rules.gram_limits.items():
        inside_gram = repeat if n == rules.repeat_window else _repeated(block, n)
        gram_chars.append(chars := block.per_doc(block.word_doc[inside_gram], word_len[inside_gram]))
        kept &= ~((n_words >= rules.min_grams_words) & (chars > limit * word_chars))
    kept &= ~(dup_line_chars > rules.line_chars_limit * word_chars)
    kept &= ~(n_symbols > rules.symbols_per_word * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat, "dup_line_chars": dup_line_chars,
        "dup_gram_chars": np.stack(gram_chars, axis=1).tolist() if gram_chars else [[]] * len(texts),
        "base_failed": failed, "kept": kept,
    }


def score_quality(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and the measures of ``SCHEMA``; no shuffle, one pass over whole texts.

    Null and empty texts have no words and fail.  Repeated rows get a row each; other columns are ignored.
    """
    require(docs, "doc_id", "text")
    rules = rules or QualityRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                found = measure(byte_texts(part.column("text")), rules)
                grams = pa.array(found.pop("dup_gram_chars"), pa.list_(pa.int64()))
                cols = {k: pa.array(v) for k, v in found.items()}
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                arrays = [part.column("doc_id"), *(grams if k == "dup_gram_chars" else cols[k] for k in names)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text the rules keep."""
    require(docs, "text")
    rules = rules or QualityRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                yield part.filter(pa.array(measure(byte_texts(part.column("text")), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
