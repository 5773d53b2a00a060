"""Tracks of curve clips: which clips and tracks count, and in what order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BONES_WITH_ROOT
from .analysis import draw

CURVE_CLASS = "CurveAnimation"


def curve_clips(clips: DataFrame, kind: str = "class") -> DataFrame:
    """Clips that hold curves."""
    return clips.where(F.col(kind) == CURVE_CLASS)


def tracks_of(folders: DataFrame, key: Sequence[str], name: str = "name", position: str = "position", rotation: str = "rotation",
              order: str = "ix") -> DataFrame:
    """One row for each name of a clip: folders with both a position and a rotation; of one name, the last in order stays."""
    whole = folders.where(F.col(position).isNotNull() & F.col(rotation).isNotNull())
    return whole.groupBy(*key, name).agg(F.max_by(F.struct(position, rotation), order).alias("t")).select(
        *key, name, F.col(f"t.{position}").alias(position), F.col(f"t.{rotation}").alias(rotation))


def track_order(order: Sequence[str] = ()) -> list[str]:
    """The given order, or that of the rig with its root."""
    return list(order) or list(BONES_WITH_ROOT)


def registered_clips(clips: DataFrame, registers: Column) -> tuple[DataFrame, DataFrame]:
    """Clips of any kind that register, and those that are skipped; a null test is no."""
    ok = F.coalesce(registers, F.lit(False))
    return clips.where(ok), clips.where(~ok)


def add_noise(x: Column, row: Column, sigma: float = 0.02, seed: int = 0) -> Column:
    """A value with Gaussian noise that depends on the row's whole-number id and the seed alone, by Box and Muller."""
    u, v = ((draw(row, seed + k) + 0.5) / 2147483647 for k in (1, 2))
    return x + F.lit(sigma) * F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)
