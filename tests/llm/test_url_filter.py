"""The digest array against plain rule matching, its edge cases, and collisions."""

import duckdb
import numpy as np
import pytest
from posewright.llm import url_filter as U

URLS = ["https://a.EXAMPLE.org/es/1?x=/de/", "http://example.org/en/19", "http://example.org/en/2", "x://com/fr/", "x://my.com/de/a#b",
        "x://my.com/de", "x://notcom/de/", "x://xcom/de/", "no scheme", "", None, "x://", "a://b://c/d", "x://com./de/", "http://h?/fr/", "x://org",
        "x://a\nb.org/z\ny", "X://ÉA.net/é"]


def plain(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for what, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, what))
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_edges(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(1, URLS[1], None), (None, "x://org/a", "y")]
    got = U.url_filter(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert [tuple(r)[1:] for r in got] == [plain(u) for _, u, _ in rows]
    assert U.url_filter(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_join_gives_the_same(spark):
    more = [*U.RULES, ("block", "h"), ("allow", "b/"), ("block", "example.org/en/19"), ("block", "ÉA.net/é")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(1, URLS[1])], "page_id long, url string")
    got = U.url_filter_by_join(pages, spark.createDataFrame(more, "what string, text string"))
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(got) == key(U.url_filter(pages, more))
    assert key(U.url_filter_by_join(pages, spark.createDataFrame([], "what string, text string"))) == key(U.url_filter(pages, ()))


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, U.url_filter(spark.read.parquet(f"{d}/pages.parquet")).collect()))
    want = duckdb.sql(U.ORACLE_SQL.replace("FROM pages", f"FROM '{d}/pages.parquet'")).fetchall()
    assert got == sorted(want)


@pytest.mark.parametrize("rules", [(), U.RULES, tuple(("block", f"h{i}.net/p{i % 7}") for i in range(999))])
def test_file_round_trip(tmp_path, rules):
    data, built = U.Rules.build(rules)
    (tmp_path / "r").write_bytes(data)
    loaded = U.Rules.load(str(tmp_path / "r"))
    texts = [t.encode() for _, t in rules] + [b"none/"]
    assert loaded.find(texts).tolist() == built.find(texts).tolist()
    assert all(loaded.string(k) == t for k, t in zip(loaded.find(texts)[:-1].tolist(), texts, strict=False))
    assert loaded.find(texts)[-1] == -1 and loaded.sizes == built.sizes


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda t: 7)
    _, rules = U.Rules.build([("block", "a/"), ("allow", "b/")])
    found = rules.find([b"b/", b"a/", b"c/"])
    assert rules.string(int(found[0])) == b"b/" and rules.string(int(found[1])) == b"a/" and found[2] == -1
    assert np.all(rules.keys == 7)
