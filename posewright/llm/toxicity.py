"""Toxicity by a counterfactual-regularised word classifier.

A logistic model over the distinct words of a text, and the stems that they begin with, is trained so that
swapping identity terms leaves its score alone: for a labelled text that names a group, the same text with
another group in its place must get the same logit, and the squared change is added to the loss. Words
that only name a group then carry no weight, whatever groups the toxic examples happen to mention.

The classifier is fitted on a bounded sample of labelled rows, chosen by a hash: grouped aggregation gives
its vocabulary, and the counterfactual rows are derived from it. Every document is scored in one pass.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Features kept by association with the label, rows to fit on, and least documents with a feature.
VOCABULARY, SAMPLE, MIN_DOCS = 4096, 20_000, 3
#: Lengths of stems, and how many distinct words of a stem are told apart.
STEMS, REPEATS = range(4, 9), 3
#: Strength of the ridge and of the counterfactual penalty, and the score from which a text is called toxic.
RIDGE, COUNTERFACTUAL, THRESHOLD = 1.0, 10.0, 0.3
STEPS = 30

# Identity terms by kind; a swap replaces a term by the others of its kind.
IDENTITIES = (
    ("men", "women", "man", "woman", "boys", "girls", "male", "female", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("christian", "christians", "muslim", "muslims", "jewish", "jews", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("old", "young", "elderly", "teenage", "disabled", "blind", "deaf"),
)
KIND = {term: group for group in IDENTITIES for term in group}
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct words of a text in lower case: runs of letters."""
    return set(WORD.findall((text or "").lower()))


def features_of(text: str | None, known=None) -> set[str]:
    """Words; ``stem*`` for a proper beginning of a word, and ``stem*2``, ``stem*3`` for that many distinct words.

    With ``known``, only features in it.
    """
    return features_of_words(words(text), known)


def features_of_words(distinct: set[str], known=None) -> set[str]:
    count: dict[str, int] = {}
    for w in distinct:
        for k in STEMS:
            if k >= len(w):
                break
            stem = w[:k] + "*"
            if known is None or stem in known:
                count[stem] = count.get(stem, 0) + 1
    out = set(distinct) if known is None else distinct & known.keys()
    for stem, n in count.items():
        out.add(stem)
        for k in range(2, min(n, REPEATS) + 1):
            out.add(f"{stem}{k}")
    return out


def word_counts(train: DataFrame) -> DataFrame:
    """``(word, n, toxic)``: documents with a feature, and toxic ones; pre-aggregated for each batch."""

    def run(batches):
        for b in batches:
            n: dict[str, list[int]] = {}
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for w in features_of(text):
                    c = n.setdefault(w, [0, 0])
                    c[0] += 1
                    c[1] += y
            yield pa.record_batch([pa.array(n.keys(), pa.string()), pa.array([c[0] for c in n.values()], pa.int64()),
                                   pa.array([c[1] for c in n.values()], pa.int64())], ["word", "n", "toxic"])

    return train.select("text", "toxic").mapInArrow(run, "word string, n long, toxic long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def choose_words(counts: DataFrame, rows: int, toxic: int, size: int = VOCABULARY) -> list[str]:
    """The words with the largest likelihood ratio against the label, and the identity terms that occur."""
    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, t, p = F.col("n"), F.col("toxic"), toxic / max(rows, 1)
    ratio = (term(t, n * p) + term(n - t, n * (1 - p)) + term(F.lit(toxic) - t, (rows - n) * p) + term(rows - n - toxic + t, (rows - n) * (1 - p)))
    often = counts.where(n >= MIN_DOCS)
    best = often.orderBy(ratio.desc(), "word").limit(size).select("word").collect()
    named = counts.where(F.col("word").isin(sorted(KIND))).select("word").collect()
    found = {r["word"] for r in best + named}
    stems = {w[:w.index("*") + 1] for w in found if "*" in w}  # scoring looks a stem up before it counts its words
    return sorted(found | stems)


def swaps_of(distinct: set[str], at: dict[str, int]) -> list[list[int]]:
    """How the features change for each named group and each other of its kind in its place, stems and their counts included.

    A feature at ``k`` that is gained is ``k + 1``, one that is lost ``-k - 1``; swaps that change none are left out.
    """
    out = []
    for a in sorted(distinct & KIND.keys()):
        for b in KIND[a]:
            if b == a:
                continue
            near = {w for w in distinct if w[:STEMS.start] in (a[:STEMS.start], b[:STEMS.start])}  # no other word shares a stem
            old, new = features_of_words(near, at), features_of_words(near - {a} | {b}, at)
            change = sorted([at[w] + 1 for w in new - old if w in at] + [-at[w] - 1 for w in old - new if w in at])
            if change:
                out.append(change)
    return out


def features(sample: DataFrame, vocabulary: list[str]) -> pd.DataFrame:
    """``toxic, has, swaps`` of the sample: the label, the positions of the vocabulary words of a text, and ``swaps_of`` it."""
    at = {w: k for k, w in enumerate(vocabulary)}

    def run(batches):
        for b in batches:
            has = [sorted(at[w] for w in features_of(t, at) if w in at) for t in b.column("text").to_pylist()]
            swaps = [swaps_of(words(t), at) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("toxic"), pa.array(has, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))], ["toxic", "has", "swaps"])

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, has array<int>, swaps array<array<int>>").toPandas()


def counterfactuals(has: list[np.ndarray], vocabulary: list[str]) -> np.ndarray:
    """One row for each text and swap, where only features are known: those of a named group and of another in its place."""
    at = {w: k for k, w in enumerate(vocabulary)}
    kinds = {at[w]: [at[o] for o in KIND[w] if o in at and o != w] for w in vocabulary if w in KIND}
    return np.array([(a, b) for h in has for a in h if a in kinds for b in kinds[a] if b not in h], np.int64).reshape(-1, 2)


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights.get(w, 0.0) for w in features_of(text, self.weights))))))


def fit(y: np.ndarray, has: list[np.ndarray], vocabulary: list[str], ridge: float = RIDGE, penalty: float = COUNTERFACTUAL, swapped: Counter | None = None) -> Model:
    """Minimise log loss + ridge |w|^2 / 2 + penalty * mean squared logit change under swaps, by Newton-CG.

    ``swapped`` counts the rows of ``swaps_of``; without it a swap changes the words of ``vocabulary`` alone.
    """
    d = len(vocabulary)
    rows = np.repeat(np.arange(len(y)), [len(h) for h in has])
    cols = np.concatenate([np.zeros(0, np.int64), *has]).astype(np.int64)
    if swapped is None:
        swapped = Counter((int(b) + 1, -int(a) - 1) for a, b in counterfactuals(has, vocabulary))
    changes = sorted(swapped)
    which = np.repeat(np.arange(len(changes)), [len(c) for c in changes])
    moved = np.array([k for c in changes for k in c], np.int64)
    sign, moved = np.sign(moved), np.abs(moved) - 1
    scale = penalty * len(y) / max(1, swapped.total()) * np.array([swapped[c] for c in changes], float)
    w, b = np.zeros(d), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def logits(w, b):
        return b + np.bincount(rows, w[cols], len(y))

    def back(v):
        return np.bincount(cols, v[rows], d)

    def swaps(w):
        change = scale * np.bincount(which, sign * w[moved], len(changes))
        return np.bincount(moved, sign * change[which], d)

    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-logits(w, b)))
        g, gb, h = back(p - y) + ridge * w + swaps(w), (p - y).sum(), np.maximum(p * (1 - p), 1e-6)
        if max(np.abs(g).max(initial=0), abs(gb)) < 1e-6 * max(1, len(y)):
            break
        # Conjugate gradients on the Newton system of weights and bias.
        x, r = np.zeros(d + 1), -np.append(g, gb)
        q, rr = r.copy(), r @ r
        for _ in range(100):
            m = h * logits(q[:d], q[d])
            aq = np.append(back(m) + ridge * q[:d] + swaps(q[:d]), m.sum())
            step = rr / max(q @ aq, 1e-300)
            x, r = x + step * q, r - step * aq
            new = r @ r
            if new < 1e-12 * max(1.0, rr):
                break
            q, rr = r + new / rr * q, new
        size = 1.0
        loss = lambda w, b: np.logaddexp(0, -(2 * y - 1) * logits(w, b)).sum() + ridge * (w @ w) / 2 + (w @ swaps(w)) / 2
        now = loss(w, b)
        while size > 1e-6 and loss(w + size * x[:d], b + size * x[d]) > now:
            size /= 2
        w, b = w + size * x[:d], b + size * x[d]
    return Model({v: float(c) for v, c in zip(vocabulary, w, strict=True)}, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = COUNTERFACTUAL) -> Model:
    """Fit on about ``sample`` labelled documents, chosen by a hash of the id; null ids and labels are ignored.

    The chosen labels are broadcast, so that texts are not shuffled to meet them.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30))
    some = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic-sample")
    n, toxic = some.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return Model({}, 0.0)
    vocabulary = choose_words(stage(word_counts(some), "toxic-words"), n, toxic)
    got = features(some, vocabulary)
    has = [np.asarray(h, np.int64) for h in got["has"]]
    order = sorted(range(len(has)), key=lambda k: (has[k].tolist(), got["toxic"][k]))
    swapped = Counter(tuple(int(k) for k in change) for swaps in got["swaps"] for change in swaps)
    return fit(got["toxic"].to_numpy(float)[order], [has[k] for k in order], vocabulary, penalty=penalty, swapped=swapped)


def held_out(folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; only the text is an input of the score.

    Labels are learned from rows that are not held out; an id that is labelled twice is two examples, a
    null id or label is none. Null and empty texts get the score of a text without words. Without any
    label every score is one half. Repeated rows are scored each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out())))

    def run(batches):
        for b in batches:
            score = [shared.value.score(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
