"""BPE encoding and decoding (operator 8): distinct words as a prefix tree, last-token states passed down it.

A word's encoding follows from those of its prefixes: the last token of a prefix is the one token that ends
there and is compatible with the last token of what stands before it.  Two tokens are compatible if encoding
their strings together gives just the two.  The distinct words of a batch, in sorted order, are the
depth-first order of their prefix tree; the states on the path to a node are kept on a stack, so what words
share at their start is worked out once.  Words end in a suffixed character, a character of its own kind.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import byte_texts, require, steps

#: Words of letters that are NFC as they stand and lower-case one to one, with ASCII marks behind them.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([!-&(-/:;=?@\\[-`{-~]*)")
# fixed value: the pieces that such a file cuts texts into
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: An ASCII mark right behind a letter of Latin-1, at the end.
_MARK_APART = re.compile(rb".*(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[!-/:-@\[-`{-~]", re.DOTALL).fullmatch

#: Letters of ASCII, and the marks behind them.
_LETTERS_APART = re.compile(rb"([a-z]+)([!-&(-/:;=?@\[-`{-~]+)").fullmatch


def _byte_char(b: int) -> str:
    """Printable Latin-1 bytes stand for themselves, the others for the code points from 256, in order."""
    def own(x: int) -> bool:
        return 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255

    return chr(b) if own(b) else chr(256 + sum(not own(x) for x in range(b)))


_BYTE_CHARS = {b: _byte_char(b) for b in range(256)}


def plain_pieces(word: bytes) -> list[str] | None:
    """Pre-tokens, in the byte alphabet, of a word of letters with or without marks behind them; None for others."""
    if word.isalpha():
        return [word.lower().decode()]
    plain = _PLAIN.fullmatch(word.decode())
    return plain and ["".join([_BYTE_CHARS[b] for b in p.lower().encode()]) for p in plain.groups() if p]


class PairTable:
    """Which tokens may follow each other, by encoding their strings together; a bounded number is kept once known."""

    most = 200_000

    def __init__(self, model: dict) -> None:
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.known: dict[tuple[str, str], bool] = {}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        #: longest token within a word that ends in given three characters
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            if len(t) > 2 and not (self.suffix and t.endswith(self.suffix)):
                self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token.removesuffix(self.suffix)
            return [*body[:-1], body[-1:] + self.suffix]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Merge the lowest-ranked neighbours, leftmost first, until none can be merged."""
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` stays a token after ``left``; with an empty ``left``, on its own."""
        found = self.known.get((left, right))
        if found is None:
            want = [left, right] if left else [right]
            found = self.merged([s for t in want for s in self.symbols(t)]) == want
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[left, right] = found
        return found


class PrefixTreeEncoder:
    """Encodes distinct strings together.  Strings are in the tokenizer's byte alphabet."""

    def __init__(self, pairs: PairTable) -> None:
        self.pairs = pairs

    def encode(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each distinct non-empty word with its tokens."""
        pairs, vocab, longest, suffix = self.pairs, self.pairs.vocab, self.pairs.longest, self.pairs.suffix
        known, fits, reach = pairs.known, pairs.fits, pairs.reach.get
        path: list[str] = [""]  # last token of each prefix of the word before; "" before the first character
        before = ""
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word) - 1, len(path) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word)):
                most = reach(word[end - 3 : end], 2) if end > 2 else end
                for start in range(end - most if end > most else 0, end):
                    token = word[start:end]
                    if token in vocab:
                        pair = (path[start], token)
                        if known[pair] if pair in known else fits(*pair):
                            path.append(token)
                            break
                else:
                    path.append(word[end - 1])
            before = word
            for start in range(max(0, len(word) - longest), len(word)):
                token = word[start:] + suffix
                if token in vocab and fits(path[start], token):
                    break
            else:
                start, token = len(word) - 1, word[-1:] + suffix
            tokens = [token]
            while start:
                tokens.append(path[start])
                start -= len(path[start])
            yield word, tokens[::-1]


class WordCache:
    """Cuts texts at space and U+0009 to U+000D, where the tokenizers meant here always cut, and keeps what words
    become: ids as little-endian 32-bit integers, and the tokens joined by spaces.

    Lower and upper case ASCII letters are one to these tokenizers, and an ASCII mark behind a letter is a word
    part of its own; so words are kept in lower case and without such a mark.  A word that may hold a special
    token is looked up as it stands.  The number of words kept is bounded.
    """

    most = 300_000

    def __init__(self, special: list[str]) -> None:
        self.kept: dict[bytes, tuple[bytes, str] | bytes] = {}
        self._starts = tuple({t[:2].encode() for t in special})

    def find(self, words: list[bytes]) -> list:
        """What distinct words become; for subclasses."""
        raise NotImplementedError

    def together(self, word, mark):
        """What a word with a mark behind it becomes, from what each becomes; for subclasses."""
        raise NotImplementedError

    def fill(self, words: set[bytes]) -> None:
        kept = self.kept
        new = [w for w in words if w not in kept]
        if len(kept) + 2 * len(new) > self.most:
            kept.clear()
            new = list(words)
        marked = [w for w in new if _MARK_APART(w) and not any(s in w for s in self._starts)]
        apart = set(marked)
        fresh = {w for w in new if w not in apart} | {w[:-1] for w in marked} | {w[-1:] for w in marked}
        fresh = [w for w in fresh if w not in kept]
        kept.update(zip(fresh, self.find(fresh)))
        for w in marked:
            kept[w] = self.together(kept[w[:-1]], kept[w[-1:]])
        if len(new) > 10_000:
            gc.freeze()  # what is kept holds no cycles; it needn't be looked through again and again

    def cut(self, texts: list[bytes]) -> list[list[bytes]]:
        """The words of each text as they are looked up."""
        cut = []
        for t in texts:
            if any(s in t for s in self._starts):
                cut.append([w if any(s in w for s in self._starts) else w.lower() for w in t.split()])
            else:
                cut.append(t.lower().split())
        return cut

    def words_of(self, texts: list[bytes]) -> list[list[bytes]]:
        cut = self.cut(texts)
        self.fill(set().union(*cut))
        return cut


def check_habits(spec: dict) -> None:
    """Raise unless a tokenizer file works as :class:`WordCache` takes for granted: it puts texts into NFC and lower
    case and makes spaces of white space, cuts off runs of letters, single digits and runs of marks, and has no
    decoder."""
    parts = (spec.get("normalizer") or {}).get("normalizers") or []
    normal = [n["type"] if n["type"] != "Replace" else (n["pattern"], n["content"]) for n in parts]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    cut = [(c["type"], c.get("pattern"), c.get("behavior"), c.get("invert")) if c["type"] == "Split" else (c["type"], c.get("add_prefix_space"), c.get("use_regex")) for c in cuts]
    known = [("Split", {"Regex": _PIECES}, "Removed", True), ("ByteLevel", False, False)]
    if normal != ["NFC", ({"Regex": "\\s+"}, " "), "Lowercase"] or cut != known or spec.get("decoder") or spec.get("post_processor"):
        raise ValueError("a tokenizer of another kind: words can't be encoded one by one in lower case")


class _Kept(dict):
    """A dict that works out what it lacks."""

    def __init__(self, work) -> None:
        self.work = work

    def __missing__(self, word: bytes) -> bytes:
        self[word] = found = self.work(word)
        return found


class LibraryTokenizer(WordCache):
    """Words encoded by the tokenizers library itself; only their ids are kept."""

    most = 900_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check_habits(json.load(f))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        super().__init__([t.content for t in self.library.get_added_tokens_decoder().values()])
        self.kept = _Kept(self.encode)

    def encode(self, word: bytes) -> bytes:
        """Ids of one word.  A piece of letters goes straight to the library's model, which takes a quarter of the
        time of a call that normalizes and cuts it first."""
        special = any(s in word for s in self._starts)
        letters = None if special else _LETTERS_APART(word)
        if letters:
            return b"".join(map(self.kept.__getitem__, letters.groups()))
        pieces = None if special else plain_pieces(word)
        if pieces is None:
            ids = self.library.encode(word.decode(), add_special_tokens=False).ids
        else:
            ids = [t.id for p in pieces for t in self.model.tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text; a word that isn't known is encoded where it is met."""
        if len(self.kept) > self.most:
            self.kept.clear()
        of = self.kept.__getitem__
        for words in self.cut(texts):
            yield b"".join(map(of, words))


class WordTokenizer(WordCache):
    """Words normalized and pre-tokenized by the library's own components and encoded by :class:`PrefixTreeEncoder`."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_habits(spec)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        self.library = Tokenizer.from_file(path)
        self.pairs = PairTable(model)
        self.encoder = PrefixTreeEncoder(self.pairs)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        super().__init__(list(self.special))
        self._cut = re.compile("|".join(f"({re.escape(t)})" for t in self.special)) if self.special else None
        self._raw = {t: i.to_bytes(4, "little") for t, i in self.pairs.vocab.items()}

    def together(self, word: tuple[bytes, str], mark: tuple[bytes, str]) -> tuple[bytes, str]:
        return word[0] + mark[0], f"{word[1]} {mark[1]}" if word[1] and mark[1] else word[1] or mark[1]

    def documents(self, texts: list[bytes]) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded text of each text."""
        of = self.kept.__getitem__
        for words in self.words_of(texts):
            found = list(map(of, words))
            yield b"".join([x for x, _ in found]), " ".join([y for _, y in found if y])

    def pieces(self, word: bytes) -> list[tuple[str, bool]]:
        """A word's pre-tokens in the byte alphabet; true marks a special token."""
        plain = plain_pieces(word)
        if plain is not None:
            return [(p, False) for p in plain]
        word = word.decode()
        out: list[tuple[str, bool]] = []
        for part in self._cut.split(word) if self._cut else [word]:
            if part in self.special:
                out.append((part, True))
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += [(p, False) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def find(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        raw, known = self._raw, {}
        cut = [self.pieces(w) for w in words]
        for piece, tokens in self.encoder.encode([p for parts in cut for p, special in parts if p and not special]):
            found = [t for t in tokens if t in raw]  # a character outside the vocabulary is dropped
            known[piece] = (b"".join([raw[t] for t in found]), " ".join(found))
        out = []
        for parts in cut:
            found = [(self.special[p].to_bytes(4, "little"), p) if special else known[p] for p, special in parts if p]
            out.append(found[0] if len(found) == 1 else (b"".join([ids for ids, _ in found]), " ".join([t for _, t in found if t])))
        return out


_LOADED: dict[tuple[type, str], WordCache] = {}


def load_tokenizer(path: str, kind: type[WordCache] = WordTokenizer) -> WordCache:
    """One tokenizer of a kind for each file in a worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


_FIELDS = {"ids": "ids array<int>", "decoded": "decoded string", "n_tokens": "n_tokens long", "ids_sha256": "ids_sha256 string", "decoded_sha256": "decoded_sha256 string"}


def encode_decode(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and the wanted of ids, decoded, n_tokens, ids_sha256, decoded_sha256.

    ``tokenizer`` is the path of a tokenizers file that every executor can read.  The decoded text joins the
    tokens as the library does for a file without a decoder.  Null texts are empty and give no ids.  One pass
    without a shuffle; what a worker keeps of words is bounded.
    """
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load_tokenizer(tokenizer)
        for batch in batches:
            for part in steps(batch, "text"):
                cols: dict[str, list] = {f: [] for f in fields}
                for ids, decoded in words.documents(byte_texts(part.column("text"))):
                    for f, col in cols.items():
                        if f == "ids":
                            col.append(np.frombuffer(ids, dtype="<i4"))
                        elif f == "n_tokens":
                            col.append(len(ids) // 4)
                        elif f == "ids_sha256":
                            col.append(hashlib.sha256(ids).hexdigest())
                        else:
                            col.append(decoded if f == "decoded" else hashlib.sha256(decoded.encode()).hexdigest())
                kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
                arrays = [pa.array(col, kinds.get(f, pa.string())) for f, col in cols.items()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *fields])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(_FIELDS[f] for f in fields)]))
