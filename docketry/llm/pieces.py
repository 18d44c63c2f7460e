"""SentencePiece encoding and decoding (operator 11) with the byte span of every piece in the source text.

A text is normalized by longest prefix through the model's compiled character map (a double array), and for each
byte of the normalized text it is recorded which source byte it comes from.  The ends of pieces in the normalized
text, looked up in that record, are their spans in the source.  No piece crosses the start of a word, so words are
encoded once and kept; the merges of a new one are the library's, of a model that takes the text as it is.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from docketry.llm.common import STEP_BYTES, byte_texts, require, steps

#: The mark that stands for a space in pieces.
MARK = "▁"
_MARK = MARK.encode()
#: Where a long text may be cut: before a space behind an ASCII letter or digit.
_CUT = re.compile(rb"[A-Za-z0-9](?= )")
# fixed values: numbers of the model file's fields and kinds
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2


def read_message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        if kind not in (1, 2, 5):
            raise ValueError("not a model file")
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def write_field(number: int, value: int | bytes) -> bytes:
    """A field of a message, the other way round."""

    def packed(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes(out) + bytes([x])

    if isinstance(value, int):
        return packed(number << 3) + packed(value)
    return packed(number << 3 | 2) + packed(len(value)) + value


class CharacterMap:
    """The compiled map of a normalizer: a double array over keys, and the replacements that its values point at."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size :]
        self.first = {b for b in range(256) if self._step(self._root(), b) is not None} if size else set()
        self.start = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in sorted(self.first)) + b"]") if self.first else None

    def _root(self) -> int:
        return self._jump(self.units[0])

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _step(self, node: int, b: int) -> tuple[int, int | None] | None:
        """The node behind ``b`` and the value of the key that ends there."""
        node ^= b
        if node >= len(self.units) or self.units[node] & 0x800000FF != b:
            return None
        unit = self.units[node]
        after = node ^ self._jump(unit)
        return after, self.units[after] & 0x7FFFFFFF if unit >> 8 & 1 else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins at ``at``."""
        node, found, end = self._root(), None, at
        while end < len(text):
            step = self._step(node, text[end])
            if step is None:
                break
            node, value = step
            end += 1
            if value is not None:
                found = (end - at, value)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def spaces_inside(self) -> bool:
        """Whether a key holds a space behind its first byte."""
        if not self.first:
            return False
        open_nodes, seen = [self._root()], set()
        for depth in range(256):
            after = []
            for node in open_nodes:
                for b in range(256):
                    step = self._step(node, b)
                    if step is not None and step[0] not in seen:
                        if depth and b == 32:
                            return True
                        seen.add(step[0])
                        after.append(step[0])
            open_nodes = after
            if not after:
                break
        return False


class PieceModel:
    """A BPE model file: its normalizer and its pieces."""

    most = 300_000

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        kinds, trainer, normal = [], {}, {}
        for field, value in read_message(data):
            if field == 1:
                part = dict(read_message(value))
                piece, kind = part.get(1, b"").decode(), part.get(3, _NORMAL)
                i = len(self.pieces)
                self.pieces.append(piece)
                kinds.append(kind)
                if kind == _BYTE:
                    self.byte_id[int(piece[3:5], 16)] = i
                self.id_of[piece] = i
            elif field == 2:
                trainer = dict(read_message(value))
            elif field == 3:
                normal = dict(read_message(value))
            elif field == 5 and any(x for _, x in read_message(value)):
                raise ValueError("a model with a denormalizer")
        if trainer.get(3, 1) != _BPE or _USER in kinds or _UNUSED in kinds or trainer.get(24) or len(self.byte_id) != 256:
            raise ValueError("a BPE model with bytes for unknown characters is needed, without pieces of its user's own")
        if any(MARK in p.lstrip(MARK) for p in self.pieces) or MARK not in self.id_of or not normal.get(5, 1):
            raise ValueError("a model whose pieces hold a space mark at their start alone is needed")
        self.bos, self.eos = self.id_of[trainer.get(46, b"<s>").decode()], self.id_of[trainer.get(47, b"</s>").decode()]
        self.map = CharacterMap(normal.get(2, b""))
        self.dummy, self.trims = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.cuttable = not self.map.spaces_inside()
        of_byte = {i: bytes([b]) for b, i in self.byte_id.items()}
        #: what each id stands for in the normalized text; begin and end stand for nothing
        self.bytes_of = [of_byte.get(i, b"" if kinds[i] in (_CONTROL, _UNKNOWN) else p.encode()) for i, p in enumerate(self.pieces)]
        self.length_of = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.is_byte = np.array([k == _BYTE for k in kinds])
        self.byte_ids = frozenset(self.byte_id.values())
        self.kept: dict[bytes, tuple[bytes, bytes]] = {}
        plain = b"".join(write_field(f, v) for f, v in ((1, b"identity"), (3, 0), (4, 0), (5, 0)))
        kept_fields = b"".join(write_field(f, v) for f, v in read_message(data) if f in (1, 2))
        self.library = SentencePieceProcessor(model_proto=kept_fields + write_field(3, plain))

    # normalizing

    def normalize(self, text: bytes, first: bool = True, last: bool = True) -> tuple[bytes, np.ndarray]:
        """The normalized text (a stretch of one, if it isn't ``first`` and ``last``) and the source place of each of
        its bytes, with the place behind the text at the end."""
        end = len(text)
        if self.map.start is None and not self.trims:
            raw = np.frombuffer(text, dtype=np.uint8)
            width = np.where(raw == 32, len(_MARK), 1)
            places = np.repeat(np.arange(len(raw)), width)
            normal = text.replace(b" ", _MARK)
        else:
            normal, places = self._mapped(text, first)
            while self.trims and last and normal.endswith(_MARK):
                end = int(places[-len(_MARK)])
                normal, places = normal[: -len(_MARK)], places[: -len(_MARK)]
        if first and self.dummy and normal:
            normal = _MARK + normal
            places = np.concatenate((np.full(len(_MARK), places[0]), places))
        return normal, np.concatenate((places, [end]))

    def _mapped(self, text: bytes, first: bool) -> tuple[bytes, np.ndarray]:
        """Longest prefixes replaced, spaces marked, and runs of spaces made one if the model wants that."""
        out, places, at, spaced = [], [], 0, first
        start = self.map.start

        def put(part: bytes, where: np.ndarray) -> None:
            """Append replaced text; ``where`` has a place for each of its bytes."""
            nonlocal spaced
            if self.trims:
                keep = np.frombuffer(part, dtype=np.uint8) != 32
                keep[1:] |= keep[:-1]
                if len(keep):
                    keep[0] |= not spaced
                    part, where = np.frombuffer(part, dtype=np.uint8)[keep].tobytes(), where[keep]
                if part:
                    spaced = part.endswith(b" ")
            raw = np.frombuffer(part, dtype=np.uint8)
            out.append(part.replace(b" ", _MARK))
            places.append(np.repeat(where, np.where(raw == 32, len(_MARK), 1)))

        while at < len(text):
            found = start.search(text, at) if start else None
            to = found.start() if found else len(text)
            # a character that begins with such a byte but no key is taken whole
            hit = self.map.longest(text, to) if found else None
            if to > at:
                put(text[at:to], np.arange(at, to))
            if found is None:
                break
            if hit:
                put(hit[1], np.full(len(hit[1]), to))
                at = to + hit[0]
            else:
                at = to + 1
                while at < len(text) and text[at] & 0xC0 == 0x80:
                    at += 1
                put(text[to:at], np.arange(to, at))
        return b"".join(out), np.concatenate(places) if places else np.empty(0, dtype=np.int64)

    # pieces

    def words(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids of stretches of normalized text that merges don't leave, and what these decode to."""
        found = self.library.encode([c.decode() for c in chunks], num_threads=1)
        return [(struct.pack(f"<{len(ids)}I", *ids), self.decode_ids(ids)) for ids in found]

    def encode(self, normal: bytes) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of a normalized text, word by word."""
        head, *rest = normal.split(_MARK)
        if b"" in rest:  # several marks in a row belong to the word behind them
            keys, marks = [], 0
            for part in rest:
                if part:
                    keys.append(_MARK * marks + part)
                    marks = 0
                else:
                    marks += 1
            if marks:
                keys.append(_MARK * (marks - 1))
            rest = keys
        kept = self.kept
        new = [k for k in dict.fromkeys(rest) if k not in kept]
        if len(kept) + len(new) > self.most:
            kept.clear()
            new = list(dict.fromkeys(rest))
        fresh = dict(zip(new, self.words([_MARK + k for k in new])))
        kept.update((k, v) for k, v in fresh.items() if len(k) < 64)
        first = self.words([head]) if head else []
        return first + [kept[k] if k in kept else fresh[k] for k in rest]

    # decoding

    def decode_ids(self, ids: list[int]) -> bytes:
        """What ids stand for: pieces with spaces for marks, and bytes, of which those that are no UTF-8 become U+FFFD each."""
        if self.byte_ids.isdisjoint(ids):
            return b"".join([self.bytes_of[i] for i in ids]).replace(_MARK, b" ")
        out, loose = [], []
        for i in ids:
            if self.is_byte[i]:
                loose.append(self.bytes_of[i])
                continue
            if loose:
                out.append(_repaired(b"".join(loose)))
                loose = []
            out.append(self.bytes_of[i].replace(_MARK, b" "))
        if loose:
            out.append(_repaired(b"".join(loose)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, without the space that stands for the text's start."""
        return self.decode_ids(ids)[self.spaces_dropped(ids) :].decode()

    def spaces_dropped(self, ids: Iterable[int]) -> int:
        """How many spaces a decoded text loses at its start: one, or one of each piece until there is something else."""
        n = 0
        for i in ids if self.dummy or self.trims else ():
            piece = self.bytes_of[i]
            if self.is_byte[i] or piece and not piece.startswith(_MARK):
                break
            n += bool(piece)
            if piece and (piece != _MARK or not self.trims):
                break
        return n

    def stretches(self, text: bytes, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
        """Where to cut a text, so that no stretch is much longer than ``most`` unless it has no place for a cut."""
        start = 0
        while self.cuttable and len(text) - start > most:
            found = _CUT.search(text, start + most)
            if not found:
                break
            yield start, found.end()
            start = found.end()
        yield start, len(text)


def _repaired(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in range(4, 0, -1):
                try:
                    raw[at : at + n].decode()
                except UnicodeDecodeError:
                    continue
                if at + n <= len(raw) and len(raw[at : at + n].decode()) == 1:
                    out.append(raw[at : at + n])
                    at += n
                    break
            else:
                out.append("�".encode())
                at += 1
        return b"".join(out)


class Encoded:
    """One text's ids, spans and decoded text, as digests or as a whole; filled stretch by stretch."""

    def __init__(self, model: PieceModel, text: bytes, whole: set[str]) -> None:
        ids_hash, decoded_hash, crc = hashlib.sha256(), hashlib.sha256(), 0
        self.n_tokens, self.covered = 0, 0
        kept: dict[str, list] = {"ids": [], "starts": [], "ends": [], "decoded": []}

        def take(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
            nonlocal crc
            ids_hash.update(ids.tobytes())
            self.n_tokens += len(ids)
            self.covered += int((ends - starts).sum())
            crc = zlib.crc32(np.stack((starts, ends), axis=1).astype("<i8").tobytes(), crc)
            for name, values in (("ids", ids), ("starts", starts), ("ends", ends)):
                if name in whole:
                    kept[name].append(values.astype(np.int64))

        edge = lambda i, at: take(np.array([i], dtype="<u4"), np.array([at]), np.array([at]))
        edge(model.bos, 0)
        first, cuts = True, list(model.stretches(text))
        for a, b in cuts:
            normal, places = model.normalize(text[a:b], a == 0, b == len(text))
            found = list(model.encode(normal))
            ids = np.frombuffer(b"".join([x for x, _ in found]), dtype="<u4")
            lengths = model.length_of[ids]
            stops = np.cumsum(lengths)
            if len(normal) != (stops[-1] if len(stops) else 0):
                raise AssertionError("pieces don't cover the text")
            take(ids, places[stops - lengths] + a, places[stops] + a)
            decoded = b"".join([y for _, y in found])
            if first and len(ids):
                decoded, first = decoded[model.spaces_dropped(ids) :], False
            decoded_hash.update(decoded)
            if "decoded" in whole:
                kept["decoded"].append(decoded)
        edge(model.eos, len(text))
        self.ids_sha256, self.decoded_sha256, self.spans_crc32 = ids_hash.hexdigest(), decoded_hash.hexdigest(), crc
        for name in ("ids", "starts", "ends"):
            setattr(self, name, np.concatenate(kept[name]) if name in whole else None)
        self.decoded = b"".join(kept["decoded"]).decode() if "decoded" in whole else None

    def pieces(self, model: PieceModel) -> list[str]:
        return [model.pieces[i] for i in self.ids]


_LOADED: dict[str, PieceModel] = {}


def load_pieces(path: str) -> PieceModel:
    """One model for each file in a worker process."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = PieceModel(f.read())
    return _LOADED[path]


_KINDS = {
    "n_tokens": pa.int64(), "ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "pieces": pa.list_(pa.string()), "decoded": pa.string(),
    "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "spans_crc32": pa.int64(), "covered": pa.int64(),
}
_TYPES = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}


def encode_pieces(docs: DataFrame, model: str, fields: tuple[str, ...] = ("ids", "pieces", "starts", "ends", "decoded")) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and the wanted fields.

    ``model`` is the path of a model file that every executor can read.  ``ids`` hold the begin and end ids;
    ``starts`` and ``ends`` are byte offsets into the UTF-8 text (an empty span at its edges for begin and end;
    each byte of an unknown character has its own); ``covered`` is the number of bytes inside spans, and
    ``spans_crc32`` a checksum of all spans as little-endian 64-bit pairs.  Null texts are empty: begin and end
    alone.  Rows are taken as they are, repeated or null ids too; other columns don't matter.  One pass, no
    shuffle; long texts are worked off in stretches, and what a worker keeps of words is bounded.
    """
    require(docs, "doc_id", "text")
    unknown = set(fields) - set(_KINDS)
    if unknown:
        raise ValueError(f"no such field: {sorted(unknown)}")
    whole = set(fields) | ({"ids"} if "pieces" in fields else set())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = load_pieces(model)
        for batch in batches:
            for part in steps(batch, "text"):
                found = [Encoded(loaded, t, whole) for t in byte_texts(part.column("text"))]
                arrays = [pa.array([x.pieces(loaded) if f == "pieces" else getattr(x, f) for x in found], _KINDS[f]) for f in fields]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *fields])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{f} {_TYPES[_KINDS[f]]}" for f in fields)]))
