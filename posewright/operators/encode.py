"""The encoder network: weights, forward pass over batches, evaluation of embeddings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine

#: Layer sizes of the default encoder, and mean squared error and contrastive constants of its trainers.
HIDDEN, LATENT = (512, 256), 128


@dataclass
class Layers:
    """Weights ``[out][in]`` and biases of linear layers with a ReLU between them."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    def forward(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            x = x @ w.T + b
            if k + 1 < len(self.weights):
                x = np.maximum(x, 0.0)
        return x

    def rows(self) -> list[tuple[int, list[list[float]], list[float]]]:
        return [(k, w.tolist(), b.tolist()) for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True))]

    @classmethod
    def formula(cls, sizes: Sequence[int]) -> Layers:
        """Deterministic weights ``((7 i + 3 j) mod 11 - 5) / 10`` and biases ``(i mod 5 - 2) / 10``."""
        weights, biases = [], []
        for n_in, n_out in zip(sizes, sizes[1:], strict=False):
            i, j = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
            weights.append(((7 * i + 3 * j) % 11 - 5) / 10.0)
            biases.append((np.arange(n_out) % 5 - 2) / 10.0)
        return cls(weights, biases)

    @classmethod
    def random(cls, sizes: Sequence[int], rng: np.random.Generator) -> Layers:
        bound = [1 / np.sqrt(n) for n in sizes[:-1]]
        return cls([rng.uniform(-b, b, (o, i)) for b, i, o in zip(bound, sizes, sizes[1:], strict=False)],
                   [rng.uniform(-b, b, o) for b, o in zip(bound, sizes[1:], strict=False)])


def save_layers(spark, layers: Layers, path: str) -> None:
    spark.createDataFrame(layers.rows(), "layer int, weight array<array<double>>, bias array<double>").write.parquet(path)


def load_layers(spark, path: str) -> Layers:
    rows = spark.read.parquet(path).orderBy("layer").collect()
    return Layers([np.array(r["weight"]) for r in rows], [np.array(r["bias"]) for r in rows])


def embed(clips: DataFrame, layers: Layers, vector: str = "feat", name: str = "emb", mean=None, std=None, size: int | None = None) -> DataFrame:
    """``clips`` with the encoder's output for each vector, a batch at a time.

    With ``mean`` and ``std`` vectors are standardised first; with ``size`` they are cut or filled up with
    zeros, as for raw poses. A null vector, or one of a wrong length, gives null.
    """
    shared = clips.sparkSession.sparkContext.broadcast(layers)
    n_in = layers.weights[0].shape[1]

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        rows = [None if v is None else np.asarray(v, np.float64) for v in column]
        if size is not None:
            rows = [None if v is None else np.pad(v[:size], (0, max(0, size - len(v)))) for v in rows]
        good = [k for k, v in enumerate(rows) if v is not None and len(v) == n_in]
        out: list = [None] * len(rows)
        if good:
            x = np.stack([rows[k] for k in good])
            if mean is not None:
                x = (x - np.asarray(mean)) / np.asarray(std)
            for k, z in zip(good, shared.value.forward(x), strict=True):
                out[k] = z
        return pd.Series(out)

    return clips.withColumn(name, run(F.col(vector)))


def mean_squared_error(a: DataFrame, b: DataFrame, key: Sequence[str], vector: str) -> DataFrame:
    """``mse``: mean squared difference of the entries of two tables of vectors, joined by key."""
    x = a.select(*key, F.col(vector).alias("x")).join(b.select(*key, F.col(vector).alias("y")), list(key))
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, v: s + v)
    return x.agg((F.sum(square) / F.sum(F.size("x"))).alias("mse"))


def contrastive_loss(views: DataFrame, batch: str, pair: str, vector: str, tau: float = 0.07) -> DataFrame:
    """``batch, loss``: normalised-temperature cross-entropy of two views of each pair, over the rows of a batch.

    A batch has two rows for each ``pair``; every row is compared with all others of its batch, which the
    training's batch size bounds. The row maximum is subtracted before the exponential.
    """
    def losses(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([pair, "view"])
        z = np.array(f[vector].tolist(), np.float64)
        z = z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-8)
        logits = z @ z.T / tau
        np.fill_diagonal(logits, -np.inf)
        own = np.arange(len(z)) ^ 1
        top = logits.max(axis=1, keepdims=True)
        loss = np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - logits[np.arange(len(z)), own]
        return pd.DataFrame({batch: [f[batch].iloc[0]], "loss": [float(loss.mean())]})

    return views.groupBy(batch).applyInPandas(losses, f"{batch} long, loss double")


def pass_rate(cases: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """``cases, passed, rate``: how many pairs of vectors have a cosine of at least ``least``."""
    ok = (cosine(F.col(a), F.col(b)) >= least).cast("int")
    return cases.agg(F.count("*").alias("cases"), F.sum(ok).cast("long").alias("passed"), F.avg(ok).alias("rate"))
