"""Template windows against a direct version, re-parameterised questions, and edge cases."""

import re

import duckdb
from posewright.llm import decontaminate as D

ITEMS = [(1, "Tom has 3 apples and Anna gives him 5 more apples. How many apples does Tom have after 2 days of rain?"),
         (2, "the quick brown fox jumps over the lazy dog near a quiet river bank"),
         (3, "too short"), (4, ""), (5, None), (6, "1 2 3 4 5 6 7 8 9 10 11 12"), (7, "el niño comió 4 kg de pan con la niña en casa ayer")]
DOCS = [
    (1, "Before it. Tom has 3 apples and Anna gives him 5 more apples. How many apples does Tom have after 2 days of rain? After."),
    (2, "Bob has 7 apples and Lucy gives him 9 more apples. How many apples does Bob have after 4 weeks of rain?"),
    (3, "Bob has 7 apples and Lucy gives him 9 more apples. How many apples does Jack have after 4 weeks of rain?"),
    (4, "THE QUICK, brown fox; jumps over (the) lazy dog near a quiet river bank!"),
    (5, "the quick brown fox jumps over the fence"), (6, "Too SHORT."), (7, "too short a text"), (8, ""), (9, None),
    (10, "20 21 22 23 24 25 26 27 28 29 30 31"), (None, "a the quick brown fox jumps over the lazy dog near a quiet river bank"),
    (11, "x " * 60_000 + "El NIÑO comió 12 pounds de pan con la niña en casa ayer " + "y " * 60_000),
    (12, "the quick brown fox jumps over the lazy dog near a quiet river bank"), (12, "the quick brown fox jumps over the lazy dog near a quiet river bank"),
]


def frames(spark, docs=DOCS, items=ITEMS):
    extra = ["'e' AS hash", "1 AS at", "2 AS item", "3 AS row", "4 AS words"]
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *extra),
            spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *extra))


def direct(docs, items):
    """All windows of all pairs, with the slots of each alignment compared one by one."""
    def words(t):
        return [w for w in re.split(r"(?:[^\w.,]|_|[.,](?!\d)|(?<!\d)[.,])+", t.lower()) if w]

    def kind(w):
        return "#n" if w[0].isdigit() or w in D.NUMBERS else "#u" if w in D.UNITS else "#p" if w in D.NAMES else None

    out = set()
    for i, t in docs:
        for j, u in items:
            a, b = words(t or ""), words(u or "")
            ca, cb = [kind(w) or w for w in a], [kind(w) or w for w in b]
            if not b or not a:
                continue
            size = min(len(b), D.WIDTH)
            at = [q for q in range(len(b) - size + 1) if size - sum(map(bool, map(kind, b[q:q + size]))) >= min(len(b), D.MIN_LITERALS)]
            if len(b) < D.WIDTH:
                hits = [(0, 0)] if ca == cb and at else []
            else:
                hits = [(p, q) for q in at for p in range(len(a) - size + 1) if ca[p:p + size] == cb[q:q + size]]
            good = set()
            for shift in {p - q for p, q in hits}:
                mine = [(p, q) for p, q in hits if p - q == shift]
                pairs = {(a[p + k], b[q + k]) for p, q in mine for k in range(size) if kind(b[q + k])}
                if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                    good |= {q for _, q in mine}
            if at and len(good) >= min(len(at), D.MIN_WINDOWS):
                out.add((i, j, len(good), len(at)))
    return out


def test_equals_direct(spark):
    got = [tuple(r)[:4] for r in D.decontaminate(*frames(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == direct(DOCS, ITEMS)
    pairs = {(r[0], r[1]) for r in got}
    assert {(1, 1), (2, 1), (4, 2), (None, 2), (11, 7), (12, 2), (6, 3)} == pairs


def test_equals_sql(spark):
    con = duckdb.connect()
    for name, rows in (("documents", DOCS), ("benchmark", ITEMS)):
        con.sql(f"CREATE TABLE {name} ({'doc_id' if name == 'documents' else 'item_id'} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = con.sql(D.ORACLE_SQL).fetchall()
    assert want and sorted(want, key=repr) == sorted(map(tuple, D.decontaminate(*frames(spark)).collect()), key=repr)


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    assert {tuple(r)[:4] for r in D.decontaminate(*frames(spark)).collect()} == direct(DOCS, ITEMS)


def test_empty_and_filter(spark):
    docs, items = frames(spark)
    assert D.decontaminate(docs.limit(0), items).collect() == [] == D.decontaminate(docs, items.limit(0)).collect()
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 7, 8, 9, 10]


def test_finds_planted_passages_and_no_others(spark):
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.decontaminate(docs, items).collect()}
    low = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    texts, passages = [(r.doc_id, low(r.text)) for r in docs.collect()], [(r.item_id, low(r.text)) for r in items.collect()]
    assert got == {(i, j) for i, t in texts for j, p in passages if p in t} and got


def test_disagreeing_slots_leave_verbatim_windows(spark):
    text = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(45)]
    text[3] = text[42] = "one"
    item, doc = " ".join(text), " ".join([*text[:42], "two", *text[43:]])
    got = D.decontaminate(*frames(spark, [(1, doc), (None, doc), (2, " ".join(text[30:41]))], [(1, item)])).collect()
    assert {tuple(r)[:4] for r in got} == {(1, 1, 35, 38), (None, 1, 35, 38)}


def test_short_and_number_rich_items_are_found_word_for_word(spark):
    items = [(1, "1 2 3 4 5 6 7 8 9 10 11 12"), (2, "What is 3 plus 4?"), (3, "小明有三个苹果，小红给了他五个苹果。他一共有多少个苹果？"), (4, "7 8")]
    docs = [(1, "so 1 2 3 4 5 6 7 8 9 10 11 12 end"), (2, "Ask: what is 3 plus 4? Now."), (3, "what is 5 plus 4?"), (4, "前文小明有三个苹果，小红给了他五个苹果。他一共有多少个苹果？后文"),
            (5, "7, 8"), (6, "6 7 8 9"), (None, "what is 3 plus 4"), (7, "")]
    got = D.decontaminate(*frames(spark, docs, items)).collect()
    assert {tuple(r)[:4] for r in got} == {(1, 1, 5, 5), (2, 2, 1, 1), (None, 2, 1, 1), (4, 3, 18, 18), (5, 4, 1, 1)}


def test_names_by_form(spark):
    ravi = ITEMS[0][1].replace("Tom", "Ravi").replace("Anna", "Priya")
    mixed = "Ravi has 3 apples and Priya gives him 5 more apples. How many apples does Anil have after 2 days of rain? Does Ravi know?"
    plain = "the quick brown fox jumps over the lazy dog near a quiet river bank"
    got = D.decontaminate(*frames(spark, [(1, ravi), (2, ravi.lower()), (3, plain.title())], ITEMS[:2])).collect()
    assert {(r[0], r[1]) for r in got} == {(1, 1), (3, 2)}
    other = [(1, mixed.replace("Ravi", "Kofi").replace("Anil", "Juan")), (2, mixed.replace("Anil", "Priya"))]
    assert {(r[0], r[1]) for r in D.decontaminate(*frames(spark, other, [(1, mixed)])).collect()} >= {(1, 1)}


def in_duckdb(docs, items):
    con = duckdb.connect()
    for name, column, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.sql(f"CREATE TABLE {name} ({column} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return con.sql(D.ORACLE_SQL).fetchall()


SUM = "12 + 7 = 19 , 5 x 6 = 30 , 9 - 4 = 5"
A, B, C = ("a grey heron stands in the cold shallow water and waits for small silver fish",
           "every second carriage of that night train was painted green by the old company", ITEMS[1][1])
#: An item of numbers, a short question, null ids, an item id of two texts, and a document id of three.
MIXED = [(11, SUM), (12, SUM.replace("19", "20")), (21, "So what is the capital city of France? Paris."), (22, "what is the capital of France"),
         (None, A), (None, "clean"), (31, A + " x"), (41, DOCS[1][1]), (42, B), (51, C), (51, "clean"), (51, C + " again")]
MIXED_ITEMS = [(11, SUM), (21, "What is the capital city of France"), (None, A), (33, "nothing of it is in any of the documents here"),
               (41, ITEMS[0][1]), (41, B), (41, B), (52, C)]


def test_mixed_cases_equal_sql(spark):
    got = [tuple(r) for r in D.decontaminate(*frames(spark, MIXED, MIXED_ITEMS)).collect()]
    assert {(r[0], r[1]) for r in got} == {(11, 11), (21, 21), (None, None), (31, None), (41, 41), (42, 41), (51, 52)} and len(got) == 7
    assert sorted(got, key=repr) == sorted(in_duckdb(MIXED, MIXED_ITEMS), key=repr)


def test_only_texts_that_leak_are_dropped(spark):
    leak = ITEMS[1][1]
    rows = [(1, leak), (1, "a clean text"), (None, leak), (None, "clean too"), (None, None), (2, "kept"), (2, "kept"), (3, "")]
    docs, items = frames(spark, rows, ITEMS)
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([r for r in rows if r[1] != leak], key=repr)
