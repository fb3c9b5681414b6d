"""Column functions on quaternions (arrays w, x, y, z) and rotation matrices (arrays of nine, by row)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinelink.functions.vectors import col, dot


def _parts(a: Column | str, n: int) -> list[Column]:
    return [F.get(col(a), F.lit(i)) for i in range(n)]


def normalize(q: Column | str, floor: float = 1e-12) -> Column:
    """Unit quaternion; null where the norm is not above the floor."""
    size = F.sqrt(dot(q, q))
    return F.when(size > floor, F.transform(col(q), lambda v: v / size))


def multiply(a: Column | str, b: Column | str) -> Column:
    w, x, y, z = _parts(a, 4)
    p, q, r, s = _parts(b, 4)
    return F.array(w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p)


def to_matrix(q: Column | str) -> Column:
    w, x, y, z = _parts(q, 4)
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def from_matrix(m: Column | str) -> Column:
    """Unit quaternion of a rotation matrix, from its largest diagonal term."""
    a, b, c, d, e, f, g, h, i = _parts(m, 9)
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) * 2
    s0, s1, s2, s3 = root(1 + a + e + i), root(1 + a - e - i), root(1 + e - a - i), root(1 + i - a - e)
    q = F.when(a + e + i > 0, F.array(s0 / 4, (h - f) / s0, (c - g) / s0, (d - b) / s0))
    q = q.when((a > e) & (a > i), F.array((h - f) / s1, s1 / 4, (b + d) / s1, (c + g) / s1))
    q = q.when(e > i, F.array((c - g) / s2, (b + d) / s2, s2 / 4, (f + h) / s2))
    return normalize(q.otherwise(F.array((d - b) / s3, (c + g) / s3, (f + h) / s3, s3 / 4)))


def matmul(a: Column | str, b: Column | str) -> Column:
    p, q = _parts(a, 9), _parts(b, 9)
    return F.array(*(p[3 * r] * q[c] + p[3 * r + 1] * q[3 + c] + p[3 * r + 2] * q[6 + c] for r in range(3) for c in range(3)))


def rotate(m: Column | str, v: Column | str, transpose: bool = False) -> Column:
    p, (x, y, z) = _parts(m, 9), _parts(v, 3)
    at = (lambda r, c: p[3 * c + r]) if transpose else (lambda r, c: p[3 * r + c])
    return F.array(*(at(r, 0) * x + at(r, 1) * y + at(r, 2) * z for r in range(3)))


def axis_angle_to_matrix(v: Column | str) -> Column:
    """Rotation about the vector by its length in radians; the unit matrix for the zero vector."""
    x, y, z = _parts(v, 3)
    theta = F.sqrt(x * x + y * y + z * z)
    safe = F.when(theta > 1e-12, theta).otherwise(1.0)
    a, b, c, s, k = x / safe, y / safe, z / safe, F.sin(theta), F.cos(theta)
    t = 1 - k
    unit = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))
    return F.when(theta > 1e-12, F.array(k + a * a * t, a * b * t - c * s, a * c * t + b * s, a * b * t + c * s, k + b * b * t, b * c * t - a * s, a * c * t - b * s, b * c * t + a * s, k + c * c * t)).otherwise(unit)


def euler_matrix(x: float, y: float, z: float) -> list[float]:
    """Fixed-axis rotation by x, then y, then z degrees."""
    (sx, cx), (sy, cy), (sz, cz) = ((math.sin(math.radians(v)), math.cos(math.radians(v))) for v in (x, y, z))
    return [cy * cz, sx * sy * cz - cx * sz, cx * sy * cz + sx * sz, cy * sz, sx * sy * sz + cx * cz, cx * sy * sz - sx * cz, -sy, sx * cy, cx * cy]


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
