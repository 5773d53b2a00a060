"""All pairs of vectors with a cosine at or above a threshold, by blocks with exact pruning.

Equal vectors are one class, and a class is its smallest row; its other rows are linked to that one, not
to each other. Every class is dealt to the block of its nearest pivot (one for every few thousand
classes, but no more than the root of their number), and blocks of many classes are split. Two blocks
can hold a pair within the angle ``acos(t)`` only if the angle of their pivots, less the blocks' radii, is
within it; the block pairs that pass, found by tasks for a few blocks each, are one matrix product each,
done in strips of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..staging import stage

PIVOT_ROWS, BLOCK, STRIP = 5_000, 20_000, 2048
#: Rows of the plan (16 bytes each) up to which it is broadcast, else joined by shuffle.
BROADCAST_PLAN = 1_000_000
#: Slack for rounding in the pruning bound, in radians.
SLACK = 1e-6


def classes(vectors: DataFrame, row: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of distinct vectors by the smallest row id that has them, and ``row, rep`` for every row."""
    v = vectors.select(F.col(row).alias("row"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    reps = stage(v.groupBy("v").agg(F.min("row").alias("rep")), "vector-classes")
    members = v.join(reps, "v").select("row", "rep")
    return reps.select("rep", unit(F.col("v")).alias("u")), members


def copy_links(units: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """``i, j, sim`` of each row with the row that stands for its equal vectors: one link for each copy.

    A zero vector has similarity zero with itself, as with any other.
    """
    own = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    same = units.select(F.col("rep").alias("i"), F.when(own > 0.5, 1.0).otherwise(0.0).alias("sim")).where(F.col("sim") >= threshold)
    return members.where("row <> rep").join(same, F.col("rep") == F.col("i")).select("i", F.col("row").alias("j"), "sim")


def similar_rows(vectors: DataFrame, threshold: float, row: str, vector: str) -> DataFrame:
    """``i, j, sim`` with ``i < j``: all similar pairs of distinct vectors, by their smallest rows, and a link for each copy.

    A pair of any two rows follows from these: the rows that they are linked to as copies are one, or a pair.
    """
    units, members = classes(vectors, row, vector)
    return similar_pairs(units, threshold).unionByName(copy_links(units, members, threshold))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _strips(a: np.ndarray, b: np.ndarray, t: float, same: bool):
    """Index pairs with a product of at least ``t``, strip by strip; ``i < j`` within one block."""
    for i in range(0, len(a), STRIP):
        for j in range(i if same else 0, len(b), STRIP):
            sims = a[i:i + STRIP] @ b[j:j + STRIP].T
            x, y = np.nonzero(sims >= t)
            keep = (x + i < y + j) if same else np.ones(len(x), bool)
            yield x[keep] + i, y[keep] + j, sims[x[keep], y[keep]]


def _forest(rows: np.ndarray, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    while len(x):
        p, q = label[x], label[y]
        differ = p != q
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    return label


def similar_pairs(units: DataFrame, threshold: float, forest: bool = False, row: str = "rep", vector: str = "u",
                  block_rows: int = BLOCK) -> DataFrame:
    """``i, j, sim`` with ``i < j`` and cosine at least ``threshold`` among rows of unit vectors.

    With ``forest``, only as many links as connect what the links would connect. Zero vectors are similar
    to nothing at a positive threshold. The driver holds the pivots and the sizes of their blocks; the plan
    of block pairs is made by tasks.
    """
    rows = units.select(F.col(row).alias("row"), F.col(vector).alias("u")).where("u IS NOT NULL")
    n = rows.count()
    wanted = min(math.isqrt(n) + 1, -(-n // PIVOT_ROWS))
    pivots = np.array([r["u"] for r in rows.orderBy(F.xxhash64("row")).limit(wanted).select("u").collect()], np.float64)
    spark = units.sparkSession
    if not len(pivots):
        return spark.createDataFrame([], "i long, j long, sim double")
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(frames):
        for f in frames:
            sims = _matrix(f["u"]) @ shared.value.T
            k = sims.argmax(axis=1)
            yield pd.DataFrame({"row": f["row"], "u": f["u"], "p": k, "angle": np.arccos(np.clip(sims[np.arange(len(k)), k], -1, 1))})

    dealt = stage(rows.mapInPandas(nearest, "row long, u array<double>, p int, angle double"), "vector-blocks")
    found = dealt.groupBy("p").agg(F.count("*").alias("n"), F.max("angle").alias("r")).orderBy("p").toPandas()
    parts = -(-found["n"].to_numpy(np.int64) // block_rows)
    base = np.cumsum(parts) - parts
    # A part of a split block is at most as wide as the block.
    pivot, radius = np.repeat(found["p"].to_numpy(np.int64), parts), np.repeat(found["r"].to_numpy(np.float64), parts)
    cut = spark.createDataFrame([(int(p), int(b), int(m)) for p, b, m in zip(found["p"], base, parts, strict=True)], "p int, base long, parts long")
    blocked = dealt.join(F.broadcast(cut), "p").select("row", "u", (F.col("base") + F.pmod(F.xxhash64("row"), "parts")).alias("b"))
    limit = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    blocks = spark.sparkContext.broadcast((pivot, radius))

    def partners(frames):
        p, r = blocks.value
        for f in frames:
            for x in f["id"].tolist():
                between = np.arccos(np.clip(shared.value[p[x:]] @ shared.value[p[x]], -1, 1))
                y = np.flatnonzero((between - r[x:] - r[x] <= limit) | (np.arange(len(p) - x) == 0)) + x
                two = y[y > x]
                yield pd.DataFrame({"b": np.concatenate([np.full(len(y), x), two]), "x": x, "y": np.concatenate([y, two]), "first": np.arange(len(y) + len(two)) < len(y)})

    plan = stage(spark.range(len(pivot)).mapInPandas(partners, "b long, x long, y long, first boolean"), "vector-plan")
    sent = blocked.join(F.broadcast(plan) if plan.count() <= BROADCAST_PLAN else plan, "b")

    def product(f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["first"]].sort_values("row"), f[~f["first"]].sort_values("row")
        same = bool(f["x"].iloc[0] == f["y"].iloc[0])
        right = left if same else right
        if not len(left) or not len(right):  # a block without rows
            return pd.DataFrame({"i": [], "j": [], "sim": []})
        a, b = _matrix(left["u"]), _matrix(right["u"])
        i, j = left["row"].to_numpy(np.int64), right["row"].to_numpy(np.int64)
        found, ids = [], np.unique(np.concatenate([i, j]))
        label = np.arange(len(ids))
        for x, y, s in _strips(a, b, threshold, same):
            if forest:
                label = _forest(ids, np.searchsorted(ids, i[x]), np.searchsorted(ids, j[y]), label)
            else:
                found.append(pd.DataFrame({"i": np.minimum(i[x], j[y]), "j": np.maximum(i[x], j[y]), "sim": s}))
        if forest:
            child = np.flatnonzero(label != np.arange(len(ids)))
            return pd.DataFrame({"i": ids[label[child]], "j": ids[child], "sim": np.full(len(child), np.nan)})
        return pd.concat(found) if found else pd.DataFrame({"i": [], "j": [], "sim": []})

    return sent.groupBy("x", "y").applyInPandas(product, "i long, j long, sim double")
