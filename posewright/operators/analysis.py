"""Analysis of embeddings: components of variance, clusters, similarity of random pairs, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit

#: Rows, at most, over which a silhouette is computed, and rows of their distances that are held at once.
SILHOUETTE_ROWS, STRIP = 5000, 512
#: Fits of k-means that run at a time.
FITS = 8


def principal_components(rows: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """``rows`` with ``pc``, the first ``k`` components about the mean, and each component's share of the variance.

    The sign of a component is set so that its largest entry is positive.
    """
    v = rows.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(v)
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    size = axes.shape[0]
    means = v.agg(*(F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(size))).first()
    offset = (np.array(list(means), np.float64) @ axes) * sign
    raw = vector_to_array("__pc")
    pc = F.array(*(raw[i] * float(sign[i]) - float(offset[i]) for i in range(k)))
    return model.transform(v).withColumn("pc", pc).drop("__v", "__pc"), model.explainedVariance.toArray().tolist()


def _best_fits(v: DataFrame, ks, seed: int, restarts: int, column: str) -> list[KMeansModel]:
    """For each ``k`` the restart of k-means on ``__v`` with the least cost; fits are many small jobs, so some run side by side."""
    asked = [(k, seed + r) for k in ks for r in range(restarts)]
    fit = inheritable_thread_target(v.sparkSession)(lambda a: KMeans(k=a[0], seed=a[1], featuresCol="__v", predictionCol=column).fit(v))
    with ThreadPool(FITS) as pool:
        models = pool.map(fit, asked)
    return [min(models[a:a + restarts], key=lambda m: m.summary.trainingCost) for a in range(0, len(models), restarts)]


def cluster(rows: DataFrame, vector: str, k: int = 12, seed: int = 42, restarts: int = 10) -> DataFrame:
    """``rows`` with ``cluster`` from the restart of k-means that has the least cost."""
    v = rows.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).cache()
    best = _best_fits(v, [k], seed, restarts, "cluster")[0]
    v.unpersist()
    return best.transform(v).drop("__v")


def silhouette(x: np.ndarray, labels: Sequence[np.ndarray]) -> list[float | None]:
    """Mean silhouette of the rows of ``x`` by Euclidean distance, for each labelling; strips of the distances are shared.

    A row alone in its cluster counts as zero. With one cluster, or none, there is no silhouette.
    """
    n, total = len(x), np.zeros(len(labels))
    hot, size = [], []
    for label in labels:
        _, at = np.unique(label, return_inverse=True)
        hot.append(np.eye(at.max() + 1)[at] if n else np.zeros((0, 0)))
        size.append(hot[-1].sum(axis=0))
    square = (x * x).sum(axis=1)
    for a in range(0, n, STRIP):
        rows = np.arange(a, min(n, a + STRIP))
        d = np.sqrt(np.maximum(square[rows, None] + square[None] - 2 * x[rows] @ x.T, 0.0))
        d[np.arange(len(rows)), rows] = 0.0
        for k, (h, m) in enumerate(zip(hot, size, strict=True)):
            own = h[rows] > 0
            if h.shape[1] < 2:
                continue
            sums = d @ h
            others = (h[rows] @ m) - 1
            inside = np.where(others > 0, sums[own] / np.maximum(others, 1), 0.0)
            outside = np.where(own, np.inf, sums / m).min(axis=1)
            widest = np.maximum(inside, outside)
            total[k] += np.where((others > 0) & (widest > 0), (outside - inside) / np.where(widest > 0, widest, 1.0), 0.0).sum()
    return [float(t / n) if h.shape[1] > 1 else None for t, h in zip(total, hot, strict=True)]


def cluster_choice(rows: DataFrame, vector: str, ks, seed: int = 42, restarts: int = 5, sample: int = SILHOUETTE_ROWS) -> DataFrame:
    """``k, inertia, silhouette`` for each ``k``.

    The silhouette is the exact one over ``sample`` rows at most, chosen by a hash of their vectors, since
    it compares all pairs; the clusters are fitted on all rows.
    """
    v = rows.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).cache()
    chosen = rows.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(sample)
    x = np.array([r["v"] for r in chosen.collect()], np.float64)
    out, labels, ks = [], [], list(ks)
    for k, best in zip(ks, _best_fits(v, ks, seed, restarts, "c"), strict=True):
        centres = np.array(best.clusterCenters())
        labels.append(((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1))
        out.append((int(k), float(best.summary.trainingCost)))
    v.unpersist()
    scored = [(*o, s) for o, s in zip(out, silhouette(x, labels), strict=True)]
    return rows.sparkSession.createDataFrame(scored, "k int, inertia double, silhouette double")


def random_pairs(spark, n: int, draws: int, seed: int = 12345) -> DataFrame:
    """``draw, i, j``: ``draws`` pairs of rows below ``n`` with replacement, self-pairs left out.

    Two multiplicative congruential streams of the draw's number, so that any part of the draws can be made
    anywhere.
    """
    d = F.col("id")
    i = F.pmod(F.pmod(d * 1103515245 + seed, F.lit(2147483647)) * 48271, F.lit(2147483647)) % n
    j = F.pmod(F.pmod(d * 214013 + seed + 2531011, F.lit(2147483647)) * 16807, F.lit(2147483647)) % n
    return spark.range(draws).select(d.alias("draw"), i.alias("i"), j.alias("j")).where("i <> j")


def pair_similarities(rows: DataFrame, pairs: DataFrame, row: str, vector: str) -> DataFrame:
    """``draw, sim``: cosine of each drawn pair."""
    u = rows.select(F.col(row).alias("r"), unit(F.col(vector)).alias("u"))
    left = pairs.join(u, pairs["i"] == u["r"]).select("draw", "j", F.col("u").alias("a"))
    return left.join(u, left["j"] == u["r"]).select("draw", dot(F.col("a"), F.col("u")).alias("sim"))


def histogram(rows: DataFrame, value: str, bins: int = 80) -> DataFrame:
    """``bin, n``: equal bins from least to greatest, which closes the last bin; empty bins are left out."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return rows.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins
    at = F.lit(0) if width <= 0 else F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).isNotNull()).select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def draw(row: Column, seed: int) -> Column:
    """A number that depends on a row's id and the seed alone, by two steps of a congruential generator."""
    return F.pmod(F.pmod(F.pmod(row.cast("long"), F.lit(2147483647)) * 16807 + seed, F.lit(2147483647)) * 48271, F.lit(2147483647))


def sample_rows(rows: DataFrame, n: int, row: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, chosen by a draw from their whole-number id, in order of the id."""
    return rows.orderBy(draw(F.col(row), seed), row).limit(n).orderBy(row)


def max_off_diagonal(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.max("sim").alias("max_sim"))
