"""Token ids against the library, the coder's round trip, and damaged files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from posewright.llm import token_files as K
from posewright.llm.word_table import WordTable
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["It's O'Neil's, 3.14 x<|endoftext|>y a  b\tc\x1cd", "", " ", "Éa été, ÉTÉ. İstanbul ΣΑΣ σας ﬁ ǅ ß.", "don't, can't. I'll 's 'S ,. .. a.. b,. é, ×, ÷.",
         "漢字, 漢 字. 😀😀, x٣, ٣.", "été, ½ á ́", "A B C\u0085D", "<|STARTOFTEXT|> <|startoftext|>", "naïve,NAÏVE.", "x y z", "a.b,c. 1,000, 2."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def arrays(texts):
    values = [t.encode() for t in texts]
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)])


def test_ids_equal_the_library(library, monkeypatch):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab,. é'A1\n<|>") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for size in (1 << 20, 64):
        monkeypatch.setattr(K, "SLICE", size)
        flat, at = K.Encoder(PATH).encode(*arrays(texts))
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert flat[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_table_tells_equal_hashes_apart(monkeypatch):
    learned = []

    def learn(words):
        learned.extend(words)
        return np.array([w[0] for w in words], np.uint32), np.arange(len(words) + 1)

    words = [b"abcdefgh" + bytes([65 + k]) * 40 + b"12345678" + b"abcdefghijklmnop" for k in range(5)] + [b"a", b"b", b"abcdefghijklmnopqrst"]
    table = WordTable(learn, limit=100)
    data, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    for _ in range(2):
        n = table.numbers(data, at[:-1], at[1:])
        assert len(set(n.tolist())) == len(words)
    assert sorted(learned) == sorted(words)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 70_000])
def test_block_round_trip(n, monkeypatch):
    monkeypatch.setattr(K, "CHECKPOINT", 8)
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
    seen, counts = np.unique(np.append(ids, [1, 70_000]), return_counts=True)
    tables = K.Tables(seen, counts)
    assert tables.freq.sum() == 1 << K.BITS and tables.freq.min() >= 1
    sizes = np.array([n // 3, 0, n - n // 3])
    data = K.encode_block(tables, 17, [5, None, -2], sizes, ids)
    block = K.Block(tables, data)
    assert block.start == 17 and block.doc_ids == [5, None, -2] and block.sizes.tolist() == sizes.tolist()
    parts = [block.stretch(k) for k in reversed(range(len(block.points)))][::-1]
    assert np.concatenate(parts).tolist() == ids.tolist() == block.ids().tolist()
    if n > 64:
        assert len(data) < 4 * n + 100_000
    for at in (len(data) - 1, K.HEAD.size + 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            K.Block(tables, bytes(bad)).ids()


def test_single_symbol():
    tables = K.Tables(np.array([1]), np.array([9]))
    ids = np.ones(500, np.uint32)
    assert K.Block(tables, K.encode_block(tables, 0, [1], np.array([500]), ids)).ids().tolist() == ids.tolist()


def test_files(spark, library, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(i * 7 % 40, t) for i, t in enumerate(TEXTS * 3)] + [(None, None), (None, "b"), (2, "a"), (2, "a"), (99, "the cat " * 30_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS part", "3 AS start")
    got = K.token_files(docs, PATH, str(tmp_path / "t")).collect()
    ids = sorted((i is not None, i or 0, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert len(got) == len(rows)
    at, want = 0, []
    for known, i, x in ids:
        want.append((i if known else None, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert K.token_files(docs.limit(0), PATH).collect() == []


def test_frequent_ids_are_dealt_over_parts_in_file_order(spark, library, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices("the cat sat on a mat and then it went away again".split(), k=rng.randint(1, 9)))
    rows = [(None, text()) for _ in range(150)] + [(None, "the same text")] * 150 + [(7, text()) for _ in range(120)] + [(i, text()) for i in range(100)] + [(7, "le " * 20_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parts = {r.part: r.n for r in K.tokenize(docs, PATH).groupBy("part").count().withColumnRenamed("count", "n").collect()}
    assert len(parts) >= 5 and max(parts.values()) < 250 < sum(i is None for i, _ in rows)
    path = tmp_path / "t"
    got = sorted(K.token_files(docs, PATH, str(path)).collect(), key=lambda r: r.start)
    ids = sorted((i is not None, i or 0, len(x), x) for i, x in ((i, [*library.encode(t, add_special_tokens=False).ids, 1]) for i, t in rows))
    key = lambda i, n, crc: (i is not None, i or 0, n, crc)
    assert sorted(key(r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(key(i if k else None, n, zlib.crc32(np.array(x, "<u4").tobytes())) for k, i, n, x in ids)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i if k else None, n) for k, i, n, _ in ids]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    starts = [pq.read_table(f, partitioning=None)["start"].to_pylist() for f in sorted(path.glob("blocks/*/*.parquet"))]
    assert len(starts) > 1 and sum(starts, []) == sorted(sum(starts, []))


def test_parts_keep_the_order():
    rows = [(3, b"a", b"", b""), (3, b"b", b"", b""), (4, b"", b"", b"")]
    parts = K.Parts(np.array([5, 9]), {None: [rows[1]], 9: [rows[0], rows[0], rows[2]]})
    assert parts.n == 8
    ids = pa.array([None, None, None, 4, 5, 6, 9, 9, 9, 9, 10])
    got = parts.of(ids, [rows[0], rows[1], rows[2], rows[0], rows[0], rows[0], *rows, (5, b"", b"", b""), rows[0]]).tolist()
    assert got[0] == 0 and got[1] in (0, 1) and got[2] == 1 and got[3:6] == [2, 2, 3] and got[6] in (3, 4, 5) and got[7] == 5 and got[8] in (5, 6) and got[9] == 6 and got[10] == 7
