"""Document quality by hierarchical empirical Bayes.

A logistic classifier on shape statistics of a text gives each document its own evidence. Documents of one
host, and of one path below it, tend to be alike, so the evidence is combined with what the rest of the
site says: grouped aggregation sums the classifier's probabilities by path and by host, a path's mean is
shrunk toward its host's and a host's toward the global one, and how much is estimated from the spread of
the means (method of moments), so that a site of a few documents says little. A document is left out of
its own site's sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .word_table import pieces

#: Labelled rows that the classifier is fitted on (about), ridge strength, and the score from which a document is kept.
SAMPLE, RIDGE, THRESHOLD = 20_000, 1.0, 0.5
#: Bounds of the prior's weight in documents, and of a probability.
LEAST_WEIGHT, MOST_WEIGHT, EDGE = 1.0, 1e6, 1e-6
#: Site sums (about 200 bytes) are broadcast up to this many, else joined by shuffle.
BROADCAST_SITES = 200_000
SLICE = 1 << 20
FEATURES = ("log_bytes", "upper", "digit", "space", "line", "symbol", "high", "word_size", "repeated", "distinct", "log_words")

KIND = np.full(256, 4, np.uint8)
KIND[65:91] = 0
KIND[48:58] = 1
KIND[[9, 11, 12, 13, 32]] = 2
KIND[10] = 3
KIND[128:] = 5
KIND[97:123] = 6


def shape(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``FEATURES`` of each UTF-8 text ``data[offsets[k]:offsets[k + 1]]``: shares of kinds of bytes and words."""
    out, a = np.zeros((len(offsets) - 1, len(FEATURES))), 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        out[a:b] = _shape(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        a = b
    return out


def _shape(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(at)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    kind = KIND[data]
    size = np.maximum(n, 1)
    columns = [np.log1p(n), *(sums(kind == k) / size for k in range(6))]
    space = (kind == 2) | (kind == 3)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins = ~space & edge[:-1]
    begins[1:] |= ~space[1:] & space[:-1]
    stops = ~space & edge[1:]
    stops[:-1] |= ~space[:-1] & space[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(at, starts, "right") - 1
    words = np.bincount(doc, minlength=len(n))
    parts = pieces(data, starts, ends - starts)
    h = parts[0] * np.uint64(0x9E3779B97F4A7C15) ^ parts[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ parts[2] ^ (ends - starts).astype(np.uint64)
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    many = np.maximum(words, 1)
    columns += [np.bincount(doc, ends - starts, len(n)) / many, np.bincount(doc[1:][again], minlength=len(n)) / many,
                np.bincount(doc[order][fresh], minlength=len(n)) / many, np.log1p(words)]
    return np.stack(columns, axis=1)


def _arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = texts.cast(pa.binary())
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    return np.frombuffer(text.buffers()[2] or b"", np.uint8), offsets


class Classifier:
    """Logistic model over standardised features and their squares."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(x), 1)), z, z * z], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Classifier:
        """Newton steps on log loss with a ridge on all weights but the constant; without labels, even odds."""
        d = 1 + 2 * len(FEATURES)
        if not len(x):
            return cls(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(d))
        out = cls(x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(d))
        a, penalty = out.design(x), np.r_[1e-6, np.full(d - 1, ridge)]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ out.weights, -30, 30)))
            g = a.T @ (p - y) + penalty * out.weights
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6), g)
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            out.weights -= step
            if np.abs(step).max() < 1e-8:
                break
        return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on about ``sample`` labelled documents, chosen by a hash of the id; their labels are broadcast."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("y"))
    n = known.count()
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30))

    def run(batches):
        for b in batches:
            x = shape(*_arrays(b.column("text")))
            yield pa.record_batch([b.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    got: pd.DataFrame = rows.select("text", "y").mapInArrow(run, "y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, got["y"]])
    return Classifier.fit(x[order], got["y"].to_numpy(float)[order])


def evidence(docs: DataFrame, classifier: Classifier, host: Column, path: Column) -> DataFrame:
    """``doc_id, host, path, logit, p``: the classifier's evidence on each document alone."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        for b in batches:
            logit = shared.value.logit(shape(*_arrays(b.column("text")))) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(logit)], ["doc_id", "host", "path", "logit"])

    blank = F.lit("")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(host.cast("string"), blank).alias("host"),
                       F.coalesce(path.cast("string"), blank).alias("path"), F.coalesce("text", blank).alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, logit double").withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))


def prior_weight(centre: Column) -> Column:
    """Weight in documents of a beta prior around ``centre``, from groups ``n, s`` (documents and their sum).

    The spread of group means about the centre, less what sampling alone gives, is the prior's variance
    ``v``; the weight is ``centre (1 - centre) / v - 1``, within bounds. It is a grouped aggregation itself.
    """
    mean = F.col("s") / F.col("n")
    noise = F.sum(centre * (1 - centre)) / F.sum("n")
    spread = F.sum(F.col("n") * (mean - centre) * (mean - centre)) / F.sum("n") - noise
    base = F.sum(F.col("n") * centre * (1 - centre)) / F.sum("n")
    return F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), F.when(spread > 0, base / spread - 1).otherwise(MOST_WEIGHT)))


def combine(rows: DataFrame) -> DataFrame:
    """Add ``host_posterior, path_posterior, score`` to rows ``doc_id, host, path, logit, p``."""
    paths = stage(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    mu = min(1 - EDGE, max(EDGE, s / n)) if n else 0.5
    host_weight = hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")).agg(prior_weight(F.lit(mu)).alias("w")).first()["w"] or MOST_WEIGHT
    host_mean = (host_weight * F.lit(mu) + F.col("host_s")) / (host_weight + F.col("host_n"))
    sites = stage(paths.join(hosts, "host"), "quality-sites")
    path_weight = sites.agg(prior_weight(host_mean).alias("w")).first()["w"] or MOST_WEIGHT
    near = F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites
    inside = lambda x: F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), x))
    logit = lambda x: F.log(x / (1 - x))
    p = F.col("p")
    host = inside((host_weight * F.lit(mu) + F.col("host_s") - p) / (host_weight + F.col("host_n") - 1))
    path = inside((path_weight * F.col("host_posterior") + F.col("s") - p) / (path_weight + F.col("n") - 1))
    total = F.col("logit") - float(np.log(mu / (1 - mu))) + logit(F.col("path_posterior"))
    return (rows.join(near, ["host", "path"]).withColumn("host_posterior", host).withColumn("path_posterior", path)
            .withColumn("score", 1 / (1 + F.exp(-total))))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, host, path, evidence, host_posterior, path_posterior, score, keep``.

    ``host`` and ``path`` name the columns of the site (for documents without URLs, their source and the
    language section below it); nulls are a site of their own, as is every empty name. Null and empty texts
    are scored by the shape of an empty text. Without labels the evidence is even. Rows repeat as in the
    input; an empty table gives an empty result.
    """
    rows = stage(evidence(docs, train(docs, labels), F.col(host), F.col(path)), "quality-evidence")
    return combine(rows).select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "score",
                                (F.col("score") >= threshold).alias("keep"))
