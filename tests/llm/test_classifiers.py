"""Toxicity and quality: held-out accuracy, counterfactual and shrinkage properties, edge cases."""

import numpy as np
import pytest
from posewright.llm import quality as Q
from posewright.llm import toxicity as T
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = T.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert len(rows) > 500 and hit >= 0.85 * sum(r.toxic for r in rows) and hit >= 0.97 * sum(r.predicted for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_swapped_groups_score_alike():
    rng = np.random.default_rng(0)
    vocabulary = ["bad", "men", "women", "word"]
    has, y = [], []
    for _ in range(400):
        toxic = rng.random() < 0.5
        row = ([0] if toxic else []) + ([1] if rng.random() < (0.8 if toxic else 0.2) else []) + ([3] if rng.random() < 0.5 else [])
        has.append(np.array(row + ([2] if not toxic and 1 not in row and rng.random() < 0.5 else [])))
        y.append(float(toxic))
    plain = T.fit(np.array(y), has, vocabulary, penalty=0.0)
    fair = T.fit(np.array(y), has, vocabulary)
    gap = lambda m: abs(m.score("men word") - m.score("women word"))
    assert gap(fair) < 0.25 * gap(plain) and fair.score("bad word") > 0.9 > 0.5 > fair.score("word")


def test_penalty_reaches_the_stems_of_identity_terms(spark):
    at = {"jews": 0, "musl*": 1, "musl*2": 2, "muslim*": 3, "muslims": 4}
    assert [-5, -4, -3, 1] in T.swaps_of({"muslims", "muslin"}, at)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2000):
        toxic = int(rng.random() < 0.3)
        group = "muslims" if rng.random() < (0.6 if toxic else 0.05) else "jews" if rng.random() < 0.2 else "people"
        rows.append((i, f"{'awful' if toxic and rng.random() < 0.7 else 'plain'} {group} w{'abcdefgh'[i % 8]}", toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    gap = lambda a, b: abs(model.score(f"plain {a}") - model.score(f"plain {b}"))
    assert gap("muslims", "jews") < 0.05 and model.score("plain muslims") < T.THRESHOLD and model.score("awful people") > 0.8


def planted(n, seed):
    """Labelled texts in which one group stands in most toxic examples."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        group = "muslim" if rng.random() < (0.6 if toxic else 0.1) else "christian" if rng.random() < 0.4 else "people"
        rows.append((i, f"{'awful' if toxic and rng.random() < 0.7 else 'plain'} {group} w{'abcdefgh'[i % 8]}", toxic))
    return rows


def test_penalty_closes_the_gap_through_train(spark):
    df = spark.createDataFrame(planted(1500, 5), "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    plain, fair = (T.train(docs, labels, penalty=p) for p in (0.0, T.COUNTERFACTUAL))
    gap = lambda m: abs(m.score("word christian") - m.score("word muslim"))
    assert gap(plain) > 0.1 and gap(fair) < 0.25 * gap(plain) and fair.score("awful people") > 0.8


def test_fit_is_the_minimum_over_swapped_texts():
    """A dense Newton solver over the texts and their rewritten counterfactuals."""
    rows = planted(150, 8)
    vocabulary = sorted({f for _, t, _ in rows for f in T.features_of(t)})
    at = {f: k for k, f in enumerate(vocabulary)}

    def dense(text):
        out = np.zeros(len(vocabulary))
        out[[at[f] for f in T.features_of(text) if f in at]] = 1
        return out

    x, y, moves = np.array([dense(t) for _, t, _ in rows]), np.array([float(l) for *_, l in rows]), []
    for _, t, _ in rows:
        for a in set(t.split()) & T.KIND.keys():
            moves += [m for b in T.KIND[a] if b != a and np.any(m := dense(" ".join(b if w == a else w for w in t.split())) - dense(t))]
    moves, scale = np.array(moves), T.COUNTERFACTUAL * len(y) / len(moves)
    loss = lambda w, b: np.logaddexp(0, -(2 * y - 1) * (x @ w + b)).sum() + T.RIDGE / 2 * w @ w + scale / 2 * ((moves @ w) ** 2).sum()
    w, b, design = np.zeros(len(vocabulary)), 0.0, np.c_[x, np.ones(len(x))]
    ridge = np.diag(np.r_[np.full(len(w), T.RIDGE), 0]) + np.pad(scale * moves.T @ moves, (0, 1))[:len(w) + 1, :len(w) + 1]
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (p - y) + ridge @ np.r_[w, b])
        w, b = w - step[:-1], b - step[-1]
    has = [np.flatnonzero(r) for r in x]
    swapped = T.Counter(tuple(c) for _, t, _ in rows for c in T.swaps_of(T.words(t), at))
    assert swapped.total() == len(moves)
    got = T.fit(y, has, vocabulary, swapped=swapped)
    weights = np.array([got.weights[v] for v in vocabulary])
    assert loss(weights, got.bias) <= loss(w, b) + 1e-4 and np.abs(weights - w).max() < 0.01


def test_features_are_whole_and_distinct():
    found = T.features_of("Idiotic idiotas; IDIOT x9")
    assert {"idiot", "idiotas", "idiot*", "idio*3", "idiot*2", "x"} <= found and "idiot*3" not in found
    assert T.features_of("Idiotic idiotas", {"idiot*": 1, "idiotas": 1}) == {"idiotas", "idiot*", "idiot*2"}
    assert T.features_of(None) == set() == T.features_of("12 --")


def test_toxicity_edges(spark):
    rows = [(i, f"word{'a' * (i % 5)} " + ("nasty" if i % 3 == 0 else "nice")) for i in range(60)] + [(None, "nasty"), (70, None), (71, ""), (72, "nasty " * 50_000), (72, "nice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "0.5 AS score", "'w' AS word")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, None), (6, 1), (6, 1)], "doc_id long, toxic int").selectExpr("*", "9 AS text")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, round(r.score, 9)) for r in got}
    assert len({s for i, s in by if i in (70, 71)}) == 1
    assert max(s for i, s in by if i == 72) > 0.5 > min(s for i, s in by if i == 72)
    assert {r.score for r in T.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert T.toxicity(docs.limit(0), labels).collect() == []


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in T.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 1)
    rows = Q.quality(docs, part).join(labels.join(part, "doc_id", "left_anti"), "doc_id").collect()
    assert len(rows) > 500 and sum(r.keep == bool(r.quality) for r in rows) >= 0.97 * len(rows)


def direct(rows):
    """Posteriors by plain sums; the weights of the priors by the method of moments."""
    def weight(groups):
        n = sum(g[0] for g in groups)
        spread = sum(c * (s / c - m) ** 2 for c, s, m in groups) / n - sum(m * (1 - m) for _, _, m in groups) / n
        base = sum(c * m * (1 - m) for c, _, m in groups) / n
        return min(Q.MOST_WEIGHT, max(Q.LEAST_WEIGHT, base / spread - 1 if spread > 0 else Q.MOST_WEIGHT))

    sums, hosts = {}, {}
    for h, p, logit in rows:
        x = 1 / (1 + np.exp(-logit))
        for d, k in ((sums, (h, p)), (hosts, h)):
            c, s = d.get(k, (0, 0.0))
            d[k] = (c + 1, s + x)
    mu = sum(s for _, s in hosts.values()) / len(rows)
    wh = weight([(c, s, mu) for c, s in hosts.values()])
    mean = {h: (wh * mu + s) / (wh + c) for h, (c, s) in hosts.items()}
    wp = weight([(c, s, mean[h]) for (h, _), (c, s) in sums.items()])
    out = []
    for h, p, logit in rows:
        x = 1 / (1 + np.exp(-logit))
        (c, s), (n, t) = hosts[h], sums[h, p]
        host = (wh * mu + s - x) / (wh + c - 1)
        path = (wp * host + t - x) / (wp + n - 1)
        out.append((h, p, host, path, 1 / (1 + np.exp(-(logit - np.log(mu / (1 - mu)) + np.log(path / (1 - path)))))))
    return out


def test_posteriors_equal_direct_sums(spark):
    rng = np.random.default_rng(1)
    base = {h: rng.normal(0, 2) for h in range(8)}
    rows = [(f"h{h}", f"p{rng.integers(0, 3)}", float(base[h] + rng.normal())) for h in rng.integers(0, 8, 300)] + [("lone", "x", -3.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, host string, path string, logit double").withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    got = [tuple(r)[1:] for r in Q.combine(df).orderBy("doc_id").select("doc_id", "host", "path", "host_posterior", "path_posterior", "score").collect()]
    for a, b in zip(got, direct(rows), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-9)


def test_sparse_sites_are_shrunk_more(spark):
    rows = [("big", "a", 4.0)] * 200 + [("small", "a", 4.0)] * 2 + [(f"o{k}", "a", -1.0 if k % 2 else 1.0) for k in range(100)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, host string, path string, logit double").withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    got = {r.host: r.path_posterior for r in Q.combine(df).collect()}
    assert got["big"] > got["small"]


def test_quality_edges(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (3, "Some plain words here.", "s", "en"), (3, "Some plain words here.", "s", "en"),
            (None, "x", "t", None), (4, "a b " * 50_000, "s", "fr"), (5, "é" * 70_000, "s", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS host", "2 AS path", "3 AS n", "4 AS y")
    labels = spark.createDataFrame([(2, 0), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int").selectExpr("*", "7 AS text")
    got = Q.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 < r.path_posterior < 1 for r in got)
    assert [r.score for r in Q.quality(docs, labels.limit(0)).collect()] == pytest.approx([0.5] * len(rows))
    assert Q.quality(docs.limit(0), labels).collect() == []


def test_shape_in_slices(monkeypatch):
    texts = ["One one two\nTWO", "", "é é x!", "a" * 40, " b ", "q 1 2 3"] * 4
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = Q.shape(data, at)
    monkeypatch.setattr(Q, "SLICE", 5)
    assert np.allclose(whole, Q.shape(data, at)) and np.allclose(whole[:6], whole[6:12])
    row = dict(zip(Q.FEATURES, whole[0], strict=True))
    assert row["word_size"] == 3 and row["distinct"] == 1 and row["repeated"] == 0 and row["upper"] == 4 / 15
