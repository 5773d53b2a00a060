"""Rotations, quaternions and rigid transforms as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def quaternion(m: Sequence[Vector]) -> list[Column]:
    """Unit quaternion ``x, y, z, w`` of a 3x3 rotation matrix; the largest of trace and diagonal leads."""
    (a, b, c), (d, e, f), (g, h, i) = m
    trace = a + e + i
    # Numerators for x, y, z, w of each case; the leading one is a quarter of the divisor s.
    cases = [(trace > 0, trace + 1.0, (h - f, c - g, d - b, None)), ((a > e) & (a > i), 1.0 + a - e - i, (None, b + d, c + g, h - f)),
             (e > i, 1.0 + e - a - i, (b + d, None, f + h, c - g)), (F.lit(True), 1.0 + i - a - e, (c + g, f + h, None, d - b))]
    raw = []
    for k in range(4):
        value = None
        for test, square, numerators in cases:
            s = F.sqrt(F.greatest(square, F.lit(0.0))) * 2
            term = 0.25 * s if numerators[k] is None else numerators[k] / s
            value = F.when(test, term) if value is None else value.when(test, term)
        raw.append(value)
    size = F.sqrt(sum((q * q for q in raw[1:]), raw[0] * raw[0]))
    return [q / size for q in raw]


def matrix(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion, normalised first; the identity for a zero quaternion."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = (F.when(n > 0, q / n).otherwise(one) for q, one in ((x, 0.0), (y, 0.0), (z, 0.0), (w, 1.0)))
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
            [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
            [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]


def align(q: Vector, reference: Vector) -> list[Column]:
    """``q`` or its negative, whichever is in the hemisphere of the reference."""
    dot = sum((a * b for a, b in zip(q[1:], reference[1:], strict=True)), q[0] * reference[0])
    return [F.when(dot < 0, -a).otherwise(a) for a in q]


def rotation_vector(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Axis times angle of a unit quaternion; zero where the axis is shorter than 1e-6."""
    square = x * x + y * y + z * z
    v = F.sqrt(square)
    factor = F.when(square < 1e-12, 0.0).otherwise(2 * F.atan2(v, w) / v)
    return [factor * a for a in (x, y, z)]


def relative(parent_m: Sequence[Vector], parent_p: Vector, m: Sequence[Vector], p: Vector) -> tuple[list[list[Column]], list[Column]]:
    """Rotation and position of a part in its parent's frame: the parent's inverse times the part."""
    def dot(u, v):
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    columns = [[parent_m[r][c] for r in range(3)] for c in range(3)]
    shift = [a - b for a, b in zip(p, parent_p, strict=True)]
    return ([[dot(columns[r], [m[k][c] for k in range(3)]) for c in range(3)] for r in range(3)], [dot(columns[r], shift) for r in range(3)])
