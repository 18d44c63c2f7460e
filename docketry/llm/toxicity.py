"""Toxicity (operator 9): noisy-channel deobfuscation by Viterbi decoding, then scoring of the restored words.

A written token is taken as a word that went through a channel which swaps letters for look-alike marks,
spreads them out with spaces or dots, and repeats them.  Each token that looks so is a lattice: every
character stands for one of some letters, or for none, at a cost.  The best ways through it under a character
trigram model, gathered from all documents, are the restored words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, materialize, require, steps

#: Letters of the model: a to z and the accented ones of Latin-1; symbol 0 is the edge of a word.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SYMBOLS = len(LETTERS) + 1
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x250, dtype=np.int64)
for _c, _i in _INDEX.items():
    _TABLE[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _TABLE[ord(_c.upper())] = _i

#: Letters that a mark or foreign letter can stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "#": "h", "%": "x", "€": "e", "£": "l",
    "¡": "i", "¢": "c", "§": "s", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "у": "y", "ѕ": "s",
    "ο": "o", "α": "a", "ι": "i", "ε": "e", "*": "abcdefghijklmnopqrstuvwxyz",
}
_SENTENCE_MARKS = ".,;:?\"'()[]«»“”‘’…"
_EDGE_MARKS = _SENTENCE_MARKS + "!#$%&*+-/<=>@\\^_`{|}~0123456789"
_TWICE = re.compile(r"(.)\1")
#: Plain letters up to the first that is repeated.
_PLAIN = re.compile(r"(?:([a-z])(?!\1))*[a-z]?")
#: Characters of a fragment of a word at most, and fragments that are joined at most.
FRAGMENT, FRAGMENTS = 3, 8
_CACHE_WORDS = 400_000
_PRIME = (1 << 61) - 1


def letter_counts(docs: DataFrame) -> DataFrame:
    """``tri int, n long``: how often each three symbols follow each other in all words of all texts.

    At a word's start the symbol before its edge counts as an edge too.  Each task adds its counts up first.
    """
    require(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for part in steps(batch, "text"):
                text = "\n\n".join(["", *(t or "" for t in part.column("text").to_pylist()), ""])
                codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
                x = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
                if len(x) < 3:
                    continue
                a, b, c = np.where(x[1:-1] == 0, 0, x[:-2]), x[1:-1], x[2:]
                some = (b > 0) | (c > 0)
                total += np.bincount(((a * SYMBOLS + b) * SYMBOLS + c)[some], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["tri", "n"])

    return docs.select("text").mapInArrow(run, "tri int, n long").groupBy("tri").agg(F.sum("n").alias("n"))


class Restorer:
    """Restores written tokens to likely words."""

    def __init__(self, counts: np.ndarray, ways: int = 3) -> None:
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        uni = (tri.sum(axis=(0, 1)) + 1) / (tri.sum() + SYMBOLS)
        bi = tri.sum(axis=0)
        bi = (bi + 5 * uni) / (bi.sum(axis=1, keepdims=True) + 5)
        self.cost = (-np.log((tri + 5 * bi[None]) / (tri.sum(axis=2, keepdims=True) + 5))).astype(np.float32)
        self.ways = ways
        self.rows: dict[tuple[int, int], list[float]] = {}

    def _row(self, a: int, b: int) -> list[float]:
        row = self.rows.get((a, b))
        if row is None:
            row = self.rows[a, b] = self.cost[a, b].tolist()
        return row

    def choices(self, char: str, before: str) -> list[tuple[int, float]]:
        """What a character may stand for, with costs; 0 is no letter at all."""
        if own := _INDEX.get(char):
            return [(own, 0.0), (0, 0.5)] if char == before else [(own, 0.0)]
        if swapped := LOOK_ALIKES.get(char):
            found = [(_INDEX[c], 2.5 if len(swapped) > 9 else 0.7) for c in swapped]
            return [*found, (0, 0.5 if char == before else 2.0 if char in "*!|+(<" else 5.0)]
        return [(0, 0.3 if not char.isalpha() else 8.0)]

    def restore(self, token: str) -> list[str]:
        """The best ``ways`` words that ``token`` may have been, best first; time follows the token's length.

        A step keeps the 48 cheapest states (last two symbols), which all tokens but those with many ``*`` have fewer of.
        """
        # (last two symbols) -> best ways to get there: cost, a number for the word so far, and its letters from the last back
        states: dict[tuple[int, int], list[tuple]] = {(0, 0): [(0.0, 0, None)]}
        before = ""
        for char in token.lower():
            after: dict[tuple[int, int], list[tuple]] = {}
            for (a, b), ways in states.items():
                row = self._row(a, b)
                for to, price in self.choices(char, before):
                    if to:
                        price += row[to]
                        after.setdefault((b, to), []).extend((s + price, (w * 1_000_003 + to) % _PRIME, (letters, to)) for s, w, letters in ways)
                    else:
                        after.setdefault((a, b), []).extend((s + price, w, letters) for s, w, letters in ways)
            before = char
            states = {k: self._cheapest(v) for k, v in after.items()}
            if len(states) > 48:
                states = dict(sorted(states.items(), key=lambda x: x[1][0][0])[:48])
        ends = [(s + self._row(a, b)[0], _spell(letters)) for (a, b), ways in states.items() for s, _, letters in ways if letters]
        return [w for _, w in sorted(ends)[: self.ways]]

    def _cheapest(self, found: list[tuple]) -> list[tuple]:
        """The cheapest way to each of the best words."""
        if len(found) > 1:
            found.sort(key=lambda x: x[:2])
        out: list[tuple] = []
        for way in found:
            if all(way[1] != kept[1] for kept in out):
                out.append(way)
                if len(out) == self.ways:
                    break
        return out


def _spell(letters: tuple | None) -> str:
    out = []
    while letters:
        letters, to = letters
        out.append(LETTERS[to - 1])
    return "".join(reversed(out))


def core_of(token: str) -> str:
    """A token without sentence marks at its ends, and without marks that stand twice or more at its end."""
    core = token.strip(_SENTENCE_MARKS)
    if not any(c.isalpha() for c in core) and any(c not in "!*-+|<{#%" for c in core):
        return core
    core = core.rstrip("!")
    while len(core) > 1 and core[-1] == core[-2] and not core[-1].isalnum():
        core = core.rstrip(core[-1]).rstrip(_SENTENCE_MARKS)
    return core


def odd_token(core: str) -> bool:
    """Whether a token has letters among other marks, look-alike marks alone, a letter twice in a row, or letters of another script."""
    if not core.isalpha():
        return any(c.isalpha() or c in LOOK_ALIKES for c in core)
    return _TWICE.search(core.lower()) is not None or not core.isascii() and any(c in LOOK_ALIKES for c in core.lower())


def short_of(word: str) -> str:
    """A word of up to ``FRAGMENT`` characters between sentence marks, without them; "" for a longer one."""
    bare = word if len(word) == 1 else word.strip(_SENTENCE_MARKS)
    return bare if len(bare) <= FRAGMENT else ""


class Lookup(dict):
    """A function's results, kept for as many arguments as a worker may hold."""

    def __init__(self, work: Callable[[str], object]) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, key: str) -> object:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        found = self[key] = self.work(key)
        return found


def spaced_runs(shorts: list[str], least: int = 3) -> Iterator[str]:
    """Runs of words of one character, joined; sentence marks around the character don't count (:func:`short_of`)."""
    if sum(len(s) == 1 for s in shorts) < least:
        return
    run: list[str] = []
    for s in [*shorts, ""]:
        if len(s) == 1:
            run.append(s)
        else:
            if len(run) >= least:
                yield "".join(run)
            run = []


class Beginnings:
    """Which starts of a joined string leave room for a word of some features.

    Plain letters stand for themselves, but for the second of two equal ones; so every reading of a string begins with
    its plain letters up to the first other character or repeated letter.  If no word of the features begins so
    (or is a beginning of it, for features that are beginnings), no reading has any of them.
    """

    def __init__(self, features: Iterable[str]) -> None:
        self.starts = {f[1:n] for f in features for n in range(1, len(f) + 1)}
        self.heads = {f[1:] for f in features if f[0] == "^"}
        self.open = Lookup(self.leaves_room)

    def leaves_room(self, joined: str) -> bool:
        sure = _PLAIN.match(joined.lower())[0]
        return not sure or sure in self.starts or any(sure[:n] in self.heads for n in range(4, min(8, len(sure)) + 1))


def joined_fragments(shorts: list[str], known: Beginnings | None = None) -> set[str]:
    """Neighbouring words of up to ``FRAGMENT`` characters, not each of one, joined: from each on, up to ``FRAGMENTS``.

    With ``known``, strings that can't read as one of its features are left out, most of them at their first fragment.
    """
    out: set[str] = set()
    room = known.open if known else None
    for i, (first, second) in enumerate(zip(shorts, shorts[1:])):
        if not (first and second) or room is not None and not room[first]:
            continue
        joined = ""
        for n, s in enumerate(shorts[i : i + FRAGMENTS], 1):
            if not s or s in _SENTENCE_MARKS:
                break
            joined += s
            if n > 1 and room is not None and not room[joined]:
                break
            if 1 < n < len(joined) and len(joined) >= 4:
                out.add(joined)
    return out


def word_features(word: str) -> list[str]:
    """A word and its beginnings of four letters and more."""
    return ["=" + word, *("^" + word[:n] for n in range(4, min(8, len(word)) + 1))] if word else []


@dataclass
class ToxicityModel:
    """``weights``: how likely a text with the feature is toxic.  ``floor``: how likely one without any is."""

    counts: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    floor: float = 0.0


class Scorer:
    """Looks words up, restores the odd ones, and keeps what it has found.

    ``wanted``: the features that count (all, if none are named).
    """

    def __init__(self, model: ToxicityModel, wanted: frozenset | None = None) -> None:
        self.model, self.restorer, self.wanted = model, Restorer(model.counts), wanted
        self.known = None if wanted is None else Beginnings(wanted)
        self.longest = None if wanted is None else max(map(len, wanted), default=0)
        self.short = Lookup(short_of)
        self.kept = Lookup(self._of_word)

    def readings(self, token: str) -> list[str]:
        """What a token may mean: itself without marks at its ends, and what it is restored to."""
        plain, core = token.strip(_EDGE_MARKS).lower(), core_of(token)
        return [plain, *self.restorer.restore(core)] if odd_token(core) else [plain]

    def _of_word(self, token: str) -> tuple[str, ...]:
        """The features of a token that count; most tokens leave no room for any and needn't be restored."""
        if self.known and not (self.known.leaves_room(token) and self.known.leaves_room(core_of(token))):
            return ()
        return self._kept(f for r in self.readings(token) for f in word_features(r))

    def _kept(self, features: Iterator[str]) -> tuple[str, ...]:
        return tuple(features if self.wanted is None else (f for f in features if f in self.wanted))

    def _tails(self, run: str) -> Iterator[str]:
        """Features of the words that a run of single characters may end in, from each character on.  The words
        themselves are left out where they are longer than every feature."""
        for r in self.restorer.restore(run):
            for k in range(len(r)):
                whole = self.longest is None or len(r) - k < self.longest
                yield from word_features(r[k:]) if whole else ("^" + r[k : k + n] for n in range(4, 9) if k + n <= len(r))

    def features(self, text: str) -> set[str]:
        """The features of a text that count."""
        words, out, kept = text.split(), set(), self.kept
        shorts = list(map(self.short.__getitem__, words))
        for w in {*words, *joined_fragments(shorts, self.known)}:
            if found := kept[w]:
                out.update(found)
        for run in spaced_runs(shorts):
            out.update(self._kept(self._tails(run)))
        return out

    def score(self, text: str) -> tuple[float, str]:
        """The weight of the most telling feature, and that feature."""
        weights = self.model.weights
        return max(((weights[f], f) for f in self.features(text)), default=(self.model.floor, ""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_toxic: int = 4, shrink: float = 4.0, least_weight: float = 0.75,
    seed: int = 9,
) -> ToxicityModel:
    """Learn from ``labels (doc_id, toxic)``, of rows that aren't held out, on about ``max_rows`` labelled
    documents at most (a random sample by doc_id, so it is the same each time); the letters come from all of
    ``docs``.

    A feature's weight is the share of toxic ones among the documents with it, drawn to the overall share by
    ``shrink`` documents' worth.  Kept are weights of ``least_weight`` and more that :func:`borne_out` bears out: words
    that only keep toxic words company are left out.  Repeated labels of a document count once (the larger
    one); rows without text, id or label are left out.  No labels: no weights, and every score is 0.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for r in letter_counts(docs).collect():  # as many rows as the alphabet allows
        counts[r.tri] = r.n
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    parts = 1 << 30
    share = int(parts * min(1.0, max_rows / max(1, total)))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(parts)) < share
    sample = docs.where(drawn & ~held_out() & F.col("text").isNotNull()).select("doc_id", "text")
    sample = materialize(sample.join(known.where(drawn), "doc_id").select("toxic", "text"), "toxic-sample")
    bare = ToxicityModel(counts)

    def count(toxic: int, wanted: frozenset | None = None) -> dict[str, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, found = Scorer(bare, wanted), Counter()
            for batch in batches:
                for t in batch.column("text").to_pylist():
                    found[""] += 1
                    found.update(scorer.features(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])

        rows = sample.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "feature string, n long")
        rows = rows.groupBy("feature").agg(F.sum("n").alias("n"))
        return {r.feature: r.n for r in (rows.where((F.col("n") >= least_toxic) | (F.col("feature") == "")) if toxic else rows).collect()}

    bad = count(1)
    n_bad = bad.pop("", 0)
    good = count(0, frozenset(bad))
    n_good = good.pop("", 0)
    base = n_bad / max(1, n_bad + n_good)
    weights = {f: (n + shrink * base) / (n + good.get(f, 0) + shrink) for f, n in bad.items()}
    telling = frozenset(f for f, w in weights.items() if w >= least_weight)

    def carriers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bare, telling)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [pa.array([sorted(scorer.features(t)) for t in texts], pa.list_(pa.string()))]
            found.append(pa.array([text_signs(t) for t in texts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(found, names=["found", "signs"])

    # as many rows as the sample has toxic documents
    rows = sample.where("toxic = 1").select("text").mapInArrow(carriers, "found array<string>, signs array<long>").collect()
    discard(sample)
    chosen = borne_out([(r.found, r.signs) for r in rows], good, base, len(bad), least_weight, shrink)
    return ToxicityModel(counts, chosen, 0.2 * base)


def text_signs(text: str, signs: int = 4, words: int = 3) -> list[int]:
    """Smallest hashes of the runs of ``words`` words; copies of a text mostly have the same."""
    w = text.split()
    runs = {xxhash.xxh64_intdigest(" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))}
    hashes = np.fromiter(runs, dtype=np.uint64, count=len(runs))
    return [int((hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).min() >> np.uint64(1)) for k in range(signs)]


def borne_out(found: list[tuple[list[str], list[int]]], good: dict[str, int], base: float, tested: int, least: float, shrink: float) -> dict[str, float]:
    """Weights of the features whose toxic documents are no copies of each other and more than chance gives in
    ``tested`` trials.

    Support is the number of different signs among the documents with the feature, at the sign that shows
    fewest; it must be half of the documents and more, and unlikely under the overall share (Chernoff's bound).
    A beginning counts without the documents of longer features kept before it: heavier ones come first.
    """
    where: dict[str, set[int]] = {}
    for i, (features, _) in enumerate(found):
        for f in features:
            where.setdefault(f, set()).add(i)

    def weight(bad: int, clean: int) -> float:
        return (bad + shrink * base) / (bad + clean + shrink)

    kept: dict[str, float] = {}
    for f in sorted(where, key=lambda f: (-weight(len(where[f]), good.get(f, 0)), f)):
        longer = [g for g in kept if g[1:].startswith(f[1:]) and f[0] == "^"]
        rows = where[f].difference(*(where[g] for g in longer))
        clean = max(0, good.get(f, 0) - sum(good.get(g, 0) for g in longer))
        if not rows:
            continue
        support = min(len({found[i][1][k] for i in rows}) for k in range(len(found[0][1])))
        share = support / (support + clean)
        if share <= base or 2 * support < len(rows) or weight(len(rows), clean) < least:
            continue
        far = share * log(share / base) + ((1 - share) * log((1 - share) / (1 - base)) if share < 1 else 0.0)
        if (support + clean) * far >= log(max(1, tested)) + 2:
            kept[f] = weight(len(where[f]), good.get(f, 0))
    return kept


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row of ``docs``: ``doc_id, score double, evidence string`` (the telling feature, "" if none).

    Null and empty texts score the model's floor.  Repeated rows get a row each; other columns are ignored.
    One pass without a shuffle over whole texts; what a worker keeps of words is bounded.
    """
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, frozenset(model.weights))
        for batch in batches:
            for part in steps(batch, "text"):
                found = [scorer.score(t or "") for t in part.column("text").to_pylist()]
                arrays = [pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence string")
