"""Fingerprints and components against direct versions, and the trie walk against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from posewright.llm import simhash as S


def direct_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= bits:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    out = base[rng.integers(0, 12, n)]
    for _ in range(6):
        flip = rng.random(n) < 0.7
        out[flip] ^= np.uint64(1) << rng.integers(0, 64, int(flip.sum())).astype(np.uint64)
    return np.unique(out)


def test_fingerprint():
    for t in (None, "", " \n\t", "One two", "one TWO three four", "a b c d e", "é É x y z w q", "la " * 5000, "x\x1cy b c d e"):
        assert S.fingerprint(t) == direct_fingerprint(t)


@pytest.mark.parametrize("extra", [1, 2])
@pytest.mark.parametrize("bits", [0, 2, 4])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, bits, extra):
    fps = clustered(400, bits + extra)
    monkeypatch.setattr(S, "BUCKET", 1e9 if extra == 1 else 0.01)
    monkeypatch.setattr(S, "STEP", 500)
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = S.links(rows, bits).collect()
    assert all(((r.i ^ r.j) & (1 << 64) - 1).bit_count() for r in got)
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    label = list(range(len(fps)))
    for r in got:
        a, b = label[at[r.i]], label[at[r.j]]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == components(fps, bits)


def test_plan_keeps_more_bits_for_larger_corpora():
    assert [len(S.plan_tables(n)) for n in (1000, 10 ** 9, 10 ** 11)] == [5, 15, 35]
    assert all(len(set(t)) == len(t) for t in S.plan_tables(10 ** 11))


ROWS = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "one two three"), (7, "ONE  two\nthree"), (4, "other words here now"),
        (5, "w " * 40_000), (6, "  "), (None, "alone in null"), (8, "tie a b c d"), (9, "tie a b c d")]


def test_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component", "3 AS node", "4 AS key")
    got = sorted(map(tuple, S.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    fps = [S.fingerprint(t) for _, t in ROWS]
    label = components(fps, 4)
    low = {c: min((i for (i, _), x in zip(ROWS, label, strict=True) if x == c and i is not None), default=None) for c in label}
    assert got == sorted(((i, f"{f:016x}", low[c]) for (i, _), f, c in zip(ROWS, fps, label, strict=True)), key=repr)
    assert S.simhash_components(docs.limit(0)).collect() == []
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([low[c] for c in set(label)], key=repr)


def test_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.simhash_components(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert all(got[r.doc_id][0] == direct_fingerprint(r.text) for r in rows[:60])
    ids = sorted(got)
    label = components([got[i][0] for i in ids], 4)
    low = {}
    for i, c in zip(ids, label, strict=True):
        low.setdefault(c, i)
    assert all(got[i][1] == low[c] for i, c in zip(ids, label, strict=True))


def test_crowded_buckets_are_dealt_again(spark, monkeypatch):
    rng = np.random.default_rng(4)
    loose = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.uint64(0x0123456789ABCDEF) ^ (rng.integers(0, 1 << 20, 400, dtype=np.uint64) << np.uint64(7))  # one bucket of four tables
    fps = np.unique(np.concatenate([loose, near, clustered(60, 3)]))
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    monkeypatch.setattr(S, "CROWDED", 30)
    got = S.links(rows, 4).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    label = list(range(len(fps)))
    for r in got:
        assert ((r.i ^ r.j) & (1 << 64) - 1).bit_count() > 0
        a, b = label[at[r.i]], label[at[r.j]]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == components(fps, 4)
    deal = S.Deal(S.plan_tables(10), 4)
    for t in (0, 4, *deal.again(2), *deal.again(deal.again(1)[3])):
        assert sorted([*deal.fixed(t), *deal.rest(t).tolist()]) == list(range(64))
    for parent in (3, deal.again(3)[0]):
        parts = [set(deal.fixed(t)) - set(deal.fixed(parent)) for t in deal.again(parent)]
        assert sorted(b for p in parts for b in p) == sorted(deal.rest(parent).tolist()) and all(parts)
