"""The max-plus scan against the library's encoder, for whole texts and for every way of cutting."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from posewright.llm import sentencepiece_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb\n\n c", "▁ a▁b", "tab\tand\x00nul", "漢字 and 😀😀 𐍈", "e.g. U.S.A. x=1;y=2", "ñandú éá",
         "    indented  code   ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" + " " * 37 + "y", "Ωμέγα " * 9, "don't stop!!!??", " nb sp"]


@pytest.fixture(scope="module")
def model():
    return C.Model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def whole(model, texts):
    values = [t.encode() for t in texts]
    return [x.tolist() for x in model.encode(np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)]))]


def sample(rng, n):
    letters = "abcdefghetaoinshr    ▁\n.,é漢" + "the and ing tion"
    return "".join(rng.choice(letters) for _ in range(n))


def test_whole_texts(model, library):
    rng = random.Random(3)
    texts = TEXTS + [sample(rng, rng.randint(0, 200)) for _ in range(200)]
    assert whole(model, texts) == [library.encode(t) for t in texts]


def test_small_parts_and_forgetful_table_give_the_same(model, library, monkeypatch):
    monkeypatch.setattr(C, "UNITS", 3)
    monkeypatch.setattr(C, "SLICE", 40)
    rng = random.Random(4)
    texts = [sample(rng, 120) for _ in range(40)]
    fresh = C.Model(PATH)
    monkeypatch.setattr(C, "TABLE", 5)
    assert whole(fresh, texts) == [library.encode(t) for t in texts]


@pytest.mark.parametrize("size", [1, 5, 16, 33])
def test_chunks(model, library, size):
    rng = random.Random(size)
    for text in TEXTS + [sample(rng, 90) for _ in range(25)] + [sample(rng, 90).replace(" ", "") for _ in range(10)]:
        assert C.encode_in_chunks(model, text, size) == library.encode(text)


def test_product_is_associative(model):
    text = C.normal("the associative combination ofmanylongwordswithoutspaces in chunks")
    at = C.cut(text, 9)
    ms = [model.transfer(text[max(0, a - 16):a], text[a:b], text[b:b + 16]) for a, b in zip(at, [*at[1:], len(text)], strict=True)]
    left = ms[0]
    for m in ms[1:]:
        left = C.combine(left, m)
    right = ms[-1]
    for m in ms[-2::-1]:
        right = C.combine(m, right)
    assert left.keys() == right.keys() and all(abs(left[k] - right[k]) < 1e-6 for k in left)


def test_distributed(spark, library):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (50, sample(rng, 700)), (50, sample(rng, 700).replace(" ", "")), (51, "no" * 400)]
    rows += [rows[-1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS rid", "'c' AS chunk", "3 AS ids")
    got = C.encode(docs, PATH, chunk=100)
    want = [(i, library.encode(t or "")) for i, t in rows]
    found = got.collect()
    assert sorted(((r.doc_id, r.ids) for r in found), key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.round_trip for r in found)
    assert max(r.n_chunks for r in found) >= 7
    decoded = {(r.doc_id, r.decoded) for r in C.decode(got, PATH).collect()}
    assert decoded == {(i, (t or "").replace("▁", " ")) for i, t in rows}
    assert C.encode(docs.limit(0), PATH).collect() == []
