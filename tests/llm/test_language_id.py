"""PPM language identification against a direct implementation, and its edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
from posewright.llm import language_id as L

TEXTS = [("en", "the cat sat on the mat and then ate"), ("en", "there is another thing to think"),
         ("fr", "le chat est assis sur le tapis où il était"), ("fr", "été à la plage avec les amis"),
         ("de", "die katze saß auf der matte und schlief")]


def model(texts=TEXTS):
    lang, gram, n = [], [], []
    for name in sorted({x for x, _ in texts}):
        code, c = np.unique(L.grams([t.encode() for x, t in texts if x == name]), return_counts=True)
        lang += [name] * len(code)
        gram += code.tolist()
        n += c.tolist()
    return L.Model(np.array(lang, object), np.array(gram, np.int64), np.array(n, np.int64))


def direct_bits(text, lang, min_node):
    """Code length by walking the contexts of one text, with counts kept in dictionaries."""
    counts, pooled = defaultdict(Counter), Counter()
    for name, t in TEXTS:
        b = b"\n" * L.ORDER + t.encode()
        for i in range(L.ORDER, len(b)):
            for k in range(L.ORDER + 1):
                pooled[b[i - k:i]] += 1
                if name == lang:
                    counts[b[i - k:i]][b[i]] += 1
    total, b = 0.0, b"\n" * L.ORDER + text.encode()
    for i in range(L.ORDER, len(b)):
        bits = 0.0
        for k in range(L.ORDER, -1, -1):
            c = counts[b[i - k:i]]
            if k > 1 and pooled[b[i - k:i]] < min_node or not c:
                continue
            whole = sum(c.values()) + len(c)
            if c[b[i]]:
                bits -= math.log2(c[b[i]] / whole)
                break
            bits -= math.log2(len(c) / whole)
        else:
            bits += 8
        total += bits
    return total


def test_bits_equal_direct_ppm(monkeypatch):
    for min_node in (1, 3):
        monkeypatch.setattr(L, "MIN_NODE", min_node)
        monkeypatch.setattr(L, "SLICE", 7)
        texts = ["the mat", "", "où est le chat", "zzz Ω katze", "t"]
        values = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, values)])
        m = model()
        got = m.bits(np.frombuffer(b"".join(values), np.uint8), offsets)
        want = [[direct_bits(t, x, min_node) for x in m.langs] for t in texts]
        np.testing.assert_allclose(got, want, rtol=1e-4)


def test_edges(spark):
    rows = [(i, t, lang, 1) for i, (lang, t) in enumerate(TEXTS * 3)]
    rows += [(None, None, None, 2), (100, "", "en", 3), (101, "123 !!", "fr", 4), (102, "the " * 5000, None, 5), (102, "the " * 5000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").selectExpr("*", "'x' AS letters", "1 AS gram")
    got = L.language_id(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.lang_pred for i in (None, 100, 101) for r in by[i]] == ["und"] * 3
    assert [r.lang_pred for r in by[102]] == ["en", "en"]
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    kept = L.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert L.language_id(docs.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    planted = [(-1, "Tämä on suomenkielinen lause jota malli ei ole nähnyt koskaan.", "fi"), (-2, "qwzx jkvb pqlm xzzv kkjq wwvb qzzx", None),
               (-3, "это русский текст для проверки", None), (None, "日本語の文章をここに書いておきます", "ja"), (-5, "A.", None), (-6, "12 34", "en")]
    planted[1:1] = [(-7, "зжщ " * 400_000, None)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema).where("lang IS NULL OR lang <> 'fi' AND lang <> 'ja'")).unionByName(
        spark.createDataFrame([(i, t, None) for i, t, x in planted if x in ("fi", "ja")], docs.schema)).selectExpr("*", "1 AS letters", "'k' AS letters_")
    kept = L.drop_unidentified(docs)
    assert kept.columns == docs.columns
    gone = docs.select("doc_id", "text").exceptAll(kept.select("doc_id", "text")).collect()
    assert sorted(r.doc_id or 0 for r in gone) == [-7, -6, -3, -2, -1, 0]
    english = {r.doc_id for r in L.drop_unidentified(docs, ["en"]).collect()}
    langs = {r.doc_id: r.lang for r in docs.collect()}
    assert len(english) > 300 and sum(langs[i] == "en" for i in english) > 0.97 * len(english)


def test_plain_code_is_the_shortest_without_context():
    m = model()
    for t in ("the mat", "zzz Ω", ""):
        v = np.frombuffer(t.encode(), np.uint8)
        want = [sum(direct_order0(b, x) for b in t.encode()) for x in m.langs]
        assert np.isclose(m.plain_bits(v), min([*want, 8 * len(v)]), rtol=1e-5)


def direct_order0(byte, lang):
    c = Counter(b for name, t in TEXTS if name == lang for b in t.encode())
    whole = sum(c.values()) + len(c)
    return -math.log2(c[byte] / whole) if c[byte] else 8 - math.log2(len(c) / whole)


def test_nothing_learned_rejects_only_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None), (None, None, None), (3, "", None), (3, "x", None), (3, "x", None)], "doc_id long, text string, lang string")
    assert sorted(r.text for r in L.drop_unidentified(docs).collect()) == ["some text", "x", "x"]
    assert L.drop_unidentified(docs.limit(0)).collect() == []
