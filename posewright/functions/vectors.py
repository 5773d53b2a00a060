"""Arrays as vectors: products, norms, layers, mirrored frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FEATURES_PER_BONE
from .hashing import let


def quantize(x: Column, step: float) -> Column:
    """Steps of ``x``, halves up: ``floor(x / step + 0.5)``."""
    return F.floor(x / F.lit(step) + 0.5).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-10) -> Column:
    """The vector over its length, or over ``floor`` if that is more."""
    return let(F.greatest(norm(a), F.lit(floor)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column, least: float = 1e-9) -> Column:
    """Cosine of two vectors; zero if either is shorter than ``least``."""
    sizes = F.struct(norm(a).alias("a"), norm(b).alias("b"))
    return let(sizes, lambda n: F.when((n["a"] < least) | (n["b"] < least), 0.0).otherwise(dot(a, b) / (n["a"] * n["b"])))


def standardize(x: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(x, mean, lambda a, m: a.cast("double") - m), std, lambda a, s: a / s)


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(0.0), x))


def linear(a: Column, weight: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """A layer with constant weights: one product for each output."""
    rows = [F.array(*map(F.lit, map(float, row))) for row in weight]
    return F.array(*(dot(a, row) + F.lit(float(b)) for row, b in zip(rows, bias, strict=True)))


def pad(a: Column, size: int, fill: float = 0.0) -> Column:
    """The first ``size`` entries, filled up at the end."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill).cast("double"), size)), 1, size)


def parse_pairs(text: str) -> list[tuple[int, int]]:
    """Pairs of ``a:b,c:d``; blanks and empty parts are ignored."""
    parts = [p.split(":") for p in text.replace(" ", "").split(",") if p]
    return [(int(a), int(b)) for a, b in parts]


def swap_index(bones: int, pairs: Sequence[tuple[int, int]], strict: bool = False) -> list[int]:
    """For each bone the bone that takes its place; a pair out of range is ignored, or an error if strict."""
    index = list(range(bones))
    for a, b in pairs:
        if not (0 <= a < bones and 0 <= b < bones):
            if strict:
                raise ValueError(f"pair {a}:{b} is out of range for {bones} bones")
            continue
        index[a], index[b] = index[b], index[a]
    return index


def mirror(frame: Column, swap: Sequence[int], axis: str = "x") -> Column:
    """A frame of six numbers a bone (position, rotation vector) seen in a mirror across ``axis``.

    Bones change places, the position is negated on the axis and the rotation on the two others.
    """
    k = {"x": 0, "y": 1}.get(axis.lower(), 2)
    sign = [-1.0 if j == k else 1.0 for j in range(3)] + [1.0 if j == k else -1.0 for j in range(3)]
    entries = [F.get(frame, F.lit(b * FEATURES_PER_BONE + j)) * F.lit(sign[j]) for b in swap for j in range(FEATURES_PER_BONE)]
    return F.array(*entries)


def mirror_energy(energy: Column, swap: Sequence[int]) -> Column:
    return F.array(*(F.get(energy, F.lit(b)) for b in swap))
