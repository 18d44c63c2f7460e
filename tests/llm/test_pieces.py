"""Operator 11 against the sentencepiece library: ids, decoded texts and spans, with and without a character map."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from docketry.llm import pieces
from docketry.llm import queries as q
from docketry.llm.common import read_table

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab  ▁\n\t\re,.①ｱ㍿é́ß漢字😀\u0000<s>0xA株Å  　 ﬁ½"


@pytest.fixture(scope="module")
def raw():
    with open(PATH, "rb") as f:
        return f.read()


def with_map(raw, rule, dummy, trims):
    """The model file with another normalizer."""
    normal = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    blob = dict(pieces.read_message(dict(pieces.read_message(normal))[3]))[2]
    spec = b"".join(pieces.write_field(*f) for f in ((1, rule.encode()), (2, blob), (3, dummy), (4, trims), (5, 1)))
    return b"".join(pieces.write_field(f, v) for f, v in pieces.read_message(raw) if f != 3) + pieces.write_field(3, spec)


def compare(model, library, text):
    got = pieces.Encoded(model, text.encode(), {"ids", "starts", "ends", "decoded"})
    ids = [library.bos_id(), *library.encode(text), library.eos_id()]
    assert got.ids.tolist() == ids
    assert got.decoded == library.decode(ids) == model.decode(ids)
    place = [len(text[:k].encode()) for k in range(len(text) + 1)]
    spans = [(place[a], place[b]) for a, b in library.encode_as_offset_mapping(text)["offsets"]]
    mine = list(zip(got.starts.tolist(), got.ends.tolist()))[1:-1]
    assert len(spans) == len(mine)
    # the bytes of an unknown character have a span each here; the library gives the whole to the last
    assert [s for s, i in zip(spans, ids[1:-1]) if not model.is_byte[i]] == [s for s, i in zip(mine, ids[1:-1]) if not model.is_byte[i]]
    return got


def test_library_agrees(raw):
    model, library, rng = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw), random.Random(1)
    for text in ["", " ", "a" * 5000, " " * 500 + "x" + " " * 300, "字" * 3000, *("".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(1500))]:
        got = compare(model, library, text)
        spans = list(zip(got.starts.tolist(), got.ends.tolist()))
        assert all(a <= b for a, b in spans) and all(b == c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("dummy", [0, 1])
@pytest.mark.parametrize("trims", [0, 1])
def test_character_maps(raw, rule, dummy, trims):
    data, rng = with_map(raw, rule, dummy, trims), random.Random(2)
    model, library = pieces.PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for _ in range(500):
        compare(model, library, "".join(rng.choices(ALPHABET, k=rng.randrange(30))))


def test_stretches_of_a_long_text(raw):
    model, library = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdeé漢\n", k=rng.randrange(1, 9))) for _ in range(3000)) + " " * 7
    whole = pieces.Encoded(model, text.encode(), {"ids", "starts", "ends", "decoded"})
    model.stretches = lambda t: pieces.PieceModel.stretches(model, t, 100)
    assert len(list(model.stretches(text.encode()))) > 50
    cut = compare(model, library, text)
    assert cut.starts.tolist() == whole.starts.tolist() and cut.ids_sha256 == whole.ids_sha256 and cut.decoded_sha256 == whole.decoded_sha256 and cut.spans_crc32 == whole.spans_crc32


def test_ids_in_any_order_decode(raw):
    model, library, rng = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw), random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(1, 3), rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == library.decode(ids)


def test_whole_table(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in read_table(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in q.op11_sentencepiece(spark, sf).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got[d].n_tokens == len(ids) and got[d].covered == len(text.encode())
        assert got[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, 1, "x"), (None, "a null id", 2, "y"), (2, "", 3, None), (3, " \n\t ", 4, "z"), (3, " \n\t ", 4, "z"), (4, "x y " * 50_000, 5, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, pieces string")
    got = pieces.encode_pieces(docs, PATH, ("ids", "pieces", "starts", "ends", "decoded", "n_tokens")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "4", "None"]
    for r in got:
        text = next(t for d, t, *_ in rows if d == r.doc_id) or ""
        assert r.decoded == text and r.n_tokens == len(r.ids) == len(r.pieces) and (r.ids[0], r.ids[-1]) == (1, 2)
        assert "".join(text.encode()[a:b].decode() for a, b in zip(r.starts, r.ends)) == text
    assert pieces.encode_pieces(docs.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        pieces.encode_pieces(docs, PATH, ("no such field",))


def test_models_of_another_kind_are_refused(raw):
    unigram = b"".join(pieces.write_field(f, v) for f, v in pieces.read_message(raw) if f != 2) + pieces.write_field(2, pieces.write_field(3, 1))
    with pytest.raises(ValueError):
        pieces.PieceModel(unigram)
