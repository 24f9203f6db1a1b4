"""Geometry as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
NORMAL = ("nx", "ny", "nz")
COV = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
RGBA = ("r", "g", "b", "a")

# Fixed values of the voxel key: 21 bits an axis, biased by half their range.
KEY_BITS = 21
KEY_OFFSET = 1 << 20

# Fixed tolerances of the point-set operators.
TINY_NORM = 1e-6
TINY_DET = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v: float) -> Column:
    return F.lit(float(v))


def finite(*cols: Column | str) -> Column:
    out = F.lit(True)
    for c in cols or XYZ:
        out = out & ~F.isnan(col(c)) & (F.abs(col(c)) < lit(float("inf")))
    return F.coalesce(out, F.lit(False))


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: list[Column]) -> list[Column]:
    """a over its length; zero if that is below TINY_NORM."""
    n = norm(a)
    return [F.when(n < TINY_NORM, lit(0)).otherwise(x / F.greatest(n, lit(TINY_NORM))) for x in a]


def outer(a: list[Column], b: list[Column]) -> list[list[Column]]:
    return [[x * y for y in b] for x in a]


def matmul(a: list[list], b: list[list]) -> list[list]:
    return [[dot(row, [b[k][j] for k in range(len(b))]) for j in range(len(b[0]))] for row in a]


def transpose(a: list[list]) -> list[list]:
    return [list(r) for r in zip(*a)]


def trace(a: list[list[Column]]) -> Column:
    return a[0][0] + a[1][1] + a[2][2]


def sym(c: list[Column]) -> list[list[Column]]:
    """A symmetric matrix from its six columns xx, xy, xz, yy, yz, zz."""
    xx, xy, xz, yy, yz, zz = c
    return [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]


def unsym(m: list[list[Column]]) -> list[Column]:
    return [m[0][0], m[0][1], m[0][2], m[1][1], m[1][2], m[2][2]]


def det(m: list[list[Column]]) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def inverse(m: list[list[Column]]) -> list[list[Column]]:
    """Adjugate over determinant; the zero matrix where the determinant is below TINY_DET."""
    d = det(m)
    safe = F.when(F.abs(d) < TINY_DET, None).otherwise(d)
    adj = transpose([cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])])
    return [[F.coalesce(x / safe, lit(0)) for x in row] for row in adj]


def mahalanobis_sq(d: list[Column], inv: list[list[Column]]) -> Column:
    return dot(d, [dot(row, d) for row in inv])


def constant(t: np.ndarray) -> list[list[Column]]:
    """A pose or matrix, the same for all rows, as literals."""
    return [[lit(v) for v in row] for row in np.asarray(t, float)]


def move(t: list[list[Column]], p: list[Column]) -> list[Column]:
    return [dot(row[:3], p) + row[3] for row in t[:3]]


def rotate(t: list[list[Column]], v: list[Column]) -> list[Column]:
    return [dot(row[:3], v) for row in t[:3]]


def rotate_cov(t: list[list[Column]], c: list[Column]) -> list[Column]:
    r = [row[:3] for row in t[:3]]
    return unsym(matmul(matmul(r, sym(c)), transpose(r)))


def cell(c: Column | str, size: float) -> Column:
    return F.floor(col(c) * lit(1.0 / size)).cast("long")


def pack_key(scaled: list[Column], ok: Column | None = None) -> Column:
    """21 bits of the floor of each of three numbers; null where one lies outside the key's range or is
    null or not finite, or where ok is false. One guard covers all three: NaN is not below a bound."""
    inside = F.lit(True) if ok is None else ok
    for v in scaled:
        inside = inside & (v >= lit(-KEY_OFFSET)) & (v < lit(KEY_OFFSET))
    cells = [F.floor(v) + F.lit(KEY_OFFSET) for v in scaled]
    return F.when(inside, cells[0].bitwiseOR(F.shiftleft(cells[1], KEY_BITS)).bitwiseOR(F.shiftleft(cells[2], 2 * KEY_BITS)))


def voxel_key(size: float, cols: tuple = XYZ) -> Column:
    """The voxel of a point; null for a non-finite point or one beyond the key's range."""
    return pack_key([col(c) * lit(1.0 / size) for c in cols])


def so3_exp(w: list[Column]) -> list[list[Column]]:
    """Rotation matrix of a rotation vector (Rodrigues), with its series at small angles."""
    t2 = dot(w, w)
    t = F.sqrt(t2)
    small = t < 1e-8
    safe = F.when(small, lit(1)).otherwise(t)
    a = F.when(small, 1 - t2 / 6).otherwise(F.sin(safe) / safe)
    b = F.when(small, lit(0.5) - t2 / 24).otherwise((1 - F.cos(safe)) / (safe * safe))
    x, y, z = w
    k = [[lit(0), -z, y], [z, lit(0), -x], [-y, x, lit(0)]]
    k2 = matmul(k, k)
    return [[lit(i == j) + a * k[i][j] + b * k2[i][j] for j in range(3)] for i in range(3)]


def se3_exp(twist: list[Column]) -> list[list[Column]]:
    """3x4 pose of a twist, rotation first."""
    w, v = twist[:3], twist[3:]
    t2 = dot(w, w)
    t = F.sqrt(t2)
    small = t < 1e-8
    safe = F.when(small, lit(1)).otherwise(t)
    b = F.when(small, lit(0.5) - t2 / 24).otherwise((1 - F.cos(safe)) / (safe * safe))
    c = F.when(small, lit(1 / 6) - t2 / 120).otherwise((safe - F.sin(safe)) / (safe * safe * safe))
    wv = cross(w, v)
    wwv = cross(w, wv)
    r = so3_exp(w)
    return [r[i] + [v[i] + b * wv[i] + c * wwv[i]] for i in range(3)]


def log_odds(p: Column) -> Column:
    return F.ln(p / (1 - p))


def probability(log_odds_: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds_))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(lit(low), F.least(lit(high), c))


def yaw(r00: Column, r10: Column) -> Column:
    """Heading of a rotation from its first column; 0 where that has no horizontal part."""
    return F.when(r00 * r00 + r10 * r10 < 1e-12, lit(0)).otherwise(F.atan2(r10, r00))


def robust_weight(residual: Column, scale: float, loss: str) -> Column:
    """Weight of a residual under a loss: none, huber, tukey, cauchy or geman_mcclure."""
    loss = loss.lower()
    q = residual / lit(scale)
    q2 = q * q
    w = {
        "none": lit(1),
        "huber": F.least(lit(1), 1 / F.greatest(q, lit(1e-300))),
        "tukey": F.when(q >= 1, lit(0)).otherwise((1 - q2) * (1 - q2)),
        "cauchy": 1 / (1 + q2),
        "geman_mcclure": 1 / ((1 + q2) * (1 + q2)),
    }
    if loss not in w:
        raise ValueError(f"no robust loss {loss!r}")
    return lit(1) if loss == "none" else F.when(residual <= 1e-8, lit(1)).otherwise(w[loss])


def robust_error(residual: Column, scale: float, loss: str) -> Column:
    loss, r2, s2 = loss.lower(), residual * residual, lit(scale * scale)
    rest = 1 - r2 / s2
    e = {
        "none": r2 * 0.5,
        "huber": F.when(residual <= scale, r2 * 0.5).otherwise(lit(scale) * (residual - 0.5 * scale)),
        "tukey": F.when(residual <= scale, s2 / 6 * (1 - rest * rest * rest)).otherwise(s2 / 6),
        "cauchy": s2 * 0.5 * F.ln(1 + r2 / s2),
        "geman_mcclure": 0.5 * (s2 * r2) / (s2 + r2),
    }
    if loss not in e:
        raise ValueError(f"no robust loss {loss!r}")
    return e[loss]
