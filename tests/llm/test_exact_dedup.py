"""Radix deduplication against SQL and its edge cases."""

import hashlib
from collections import defaultdict

import duckdb
from posewright.llm import exact_dedup as E

LONG = "abc " * 30_000
ROWS = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, "a\x00"), (6, LONG), (7, LONG), (8, LONG + "x"), (9, "é"), (10, "é"),
        (None, "a"), (None, "n"), (None, "n"), (11, "x" * 32), (12, "x" * 32), (13, "x" * 33), (3, "z"), (14, "z")]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        known = [x for x in groups[t or ""] if x is not None]
        keep = max(known, default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS keep_id", "1 AS gid", "2 AS n", "'k' AS key", "0 AS judged_id", "0 AS judged_key")


def test_edges(spark):
    assert sorted(map(tuple, E.exact_dedup(frame(spark, ROWS)).collect()), key=repr) == expected(ROWS)
    assert E.exact_dedup(frame(spark, ROWS).limit(0)).collect() == []
    assert sorted(map(tuple, E.exact_dedup(frame(spark, [(2, "b"), (1, "c")])).collect())) == expected([(2, "b"), (1, "c")])


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(E, "MAX_DIGIT", 64)
    rows = [(i, t[:400] if t else t) for i, t in ROWS]
    assert sorted(map(tuple, E.exact_dedup(frame(spark, rows)).collect()), key=repr) == expected(rows)


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01/documents.parquet"
    got = sorted(map(tuple, E.exact_dedup(spark.read.parquet(d)).collect()))
    assert got == sorted(duckdb.sql(E.ORACLE_SQL.replace("FROM documents", f"FROM '{d}'")).fetchall())


def test_drop_copies(spark):
    docs = frame(spark, ROWS)
    kept = E.drop_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    assert got == sorted([(2, ""), (4, "a"), (5, "a\x00"), (7, LONG), (8, LONG + "x"), (9, "é"), (10, "é"), (None, "n"),
                          (12, "x" * 32), (13, "x" * 33), (14, "z")], key=repr)
