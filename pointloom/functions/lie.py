"""Rotations, poses and symmetric 3x3 matrices in numpy, batched over leading axes."""

from __future__ import annotations

import numpy as np


def skew(w: np.ndarray) -> np.ndarray:
    w = np.asarray(w, float)
    out = np.zeros((*w.shape[:-1], 3, 3))
    out[..., 0, 1], out[..., 0, 2] = -w[..., 2], w[..., 1]
    out[..., 1, 0], out[..., 1, 2] = w[..., 2], -w[..., 0]
    out[..., 2, 0], out[..., 2, 1] = -w[..., 1], w[..., 0]
    return out


def _series(t: np.ndarray, f, small: np.ndarray) -> np.ndarray:
    safe = np.where(t < 1e-4, 1.0, t)
    return np.where(t < 1e-4, small, f(safe))


def so3_exp(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors."""
    w = np.asarray(w, float)
    t = np.linalg.norm(w, axis=-1)
    k = skew(w)
    a = _series(t, lambda s: np.sin(s) / s, 1 - t**2 / 6)[..., None, None]
    b = _series(t, lambda s: (1 - np.cos(s)) / s**2, 0.5 - t**2 / 24)[..., None, None]
    return np.eye(3) + a * k + b * (k @ k)


def rotation_to_quaternion(r: np.ndarray) -> np.ndarray:
    """(x, y, z, w) of rotation matrices, w not negative."""
    r = np.asarray(r, float)
    # the eigenvector of the largest eigenvalue of Bar-Itzhack's symmetric matrix
    k = np.empty((*r.shape[:-2], 4, 4))
    for i in range(3):
        for j in range(3):
            k[..., i, j] = r[..., i, j] + r[..., j, i]
    tr = np.trace(r, axis1=-2, axis2=-1)
    for i in range(3):
        k[..., i, i] = 2 * r[..., i, i] - tr
    k[..., 0, 3] = k[..., 3, 0] = r[..., 2, 1] - r[..., 1, 2]
    k[..., 1, 3] = k[..., 3, 1] = r[..., 0, 2] - r[..., 2, 0]
    k[..., 2, 3] = k[..., 3, 2] = r[..., 1, 0] - r[..., 0, 1]
    k[..., 3, 3] = tr
    q = np.linalg.eigh(k)[1][..., -1]
    return np.where(q[..., 3:] < 0, -q, q)


def quaternion_to_rotation(q: np.ndarray) -> np.ndarray:
    x, y, z, w = np.moveaxis(np.asarray(q, float), -1, 0)
    rows = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
    return np.stack([np.stack(r, -1) for r in rows], -2)


def quaternion_log(q: np.ndarray) -> np.ndarray:
    q = np.asarray(q, float)
    q = np.where(q[..., 3:] < 0, -q, q)
    n = np.linalg.norm(q[..., :3], axis=-1)
    angle = 2 * np.arctan2(n, q[..., 3])
    return q[..., :3] * np.where(n < 1e-8, 2.0, angle / np.where(n < 1e-8, 1, n))[..., None]


def quaternion_exp(w: np.ndarray) -> np.ndarray:
    w = np.asarray(w, float)
    t = np.linalg.norm(w, axis=-1)
    s = _series(t, lambda a: np.sin(a / 2) / a, 0.5 - t**2 / 48)
    return np.concatenate([w * s[..., None], np.cos(t / 2)[..., None]], -1)


def quaternion_multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    av, aw, bv, bw = a[..., :3], a[..., 3:], b[..., :3], b[..., 3:]
    return np.concatenate([aw * bv + bw * av + np.cross(av, bv), aw * bw - (av * bv).sum(-1, keepdims=True)], -1)


def slerp(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Between unit quaternions along the shorter arc."""
    b = np.where((a * b).sum(-1, keepdims=True) < 0, -b, b)
    rel = quaternion_multiply(a * np.array([-1, -1, -1, 1]), b)
    return quaternion_multiply(a, quaternion_exp(quaternion_log(rel) * np.asarray(t)[..., None]))


def so3_log(r: np.ndarray) -> np.ndarray:
    return quaternion_log(rotation_to_quaternion(r))


def pose(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.zeros((*np.shape(t)[:-1], 4, 4))
    out[..., :3, :3], out[..., :3, 3], out[..., 3, 3] = r, t, 1
    return out


def inverse_pose(t: np.ndarray) -> np.ndarray:
    r = np.swapaxes(t[..., :3, :3], -1, -2)
    return pose(r, -(r @ t[..., :3, 3:])[..., 0])


def _left(w: np.ndarray) -> np.ndarray:
    t, k = np.linalg.norm(w, axis=-1), skew(w)
    b = _series(t, lambda s: (1 - np.cos(s)) / s**2, 0.5 - t**2 / 24)[..., None, None]
    c = _series(t, lambda s: (s - np.sin(s)) / s**3, 1 / 6 - t**2 / 120)[..., None, None]
    return np.eye(3) + b * k + c * (k @ k)


def right_jacobian(w: np.ndarray) -> np.ndarray:
    return _left(-np.asarray(w, float))


def se3_exp(twist: np.ndarray) -> np.ndarray:
    """Poses of twists, rotation first."""
    twist = np.asarray(twist, float)
    w, v = twist[..., :3], twist[..., 3:]
    return pose(so3_exp(w), (_left(w) @ v[..., None])[..., 0])


def se3_log(t: np.ndarray) -> np.ndarray:
    w = so3_log(t[..., :3, :3])
    return np.concatenate([w, np.linalg.solve(_left(w), t[..., :3, 3:])[..., 0]], -1)


def project_isometry(m: np.ndarray) -> np.ndarray:
    """The pose nearest to a 4x4 matrix."""
    return pose(quaternion_to_rotation(rotation_to_quaternion(m[..., :3, :3])), m[..., :3, 3])


def yaw(r: np.ndarray) -> float:
    return 0.0 if r[0, 0] ** 2 + r[1, 0] ** 2 < 1e-12 else float(np.arctan2(r[1, 0], r[0, 0]))


def symmetric(c: np.ndarray) -> np.ndarray:
    """3x3 matrices from columns xx, xy, xz, yy, yz, zz."""
    return np.asarray(c, float)[..., [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(*np.shape(c)[:-1], 3, 3)


def packed(m: np.ndarray) -> np.ndarray:
    return m.reshape(*m.shape[:-2], 9)[..., [0, 1, 2, 4, 5, 8]]


def _spectral(m: np.ndarray, f) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return (vectors * f(values)[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def spd_log(m: np.ndarray) -> np.ndarray:
    return _spectral(m, lambda v: np.log(np.maximum(v, 1e-6)))


def spd_exp(m: np.ndarray) -> np.ndarray:
    return _spectral(m, np.exp)


def plane_regularized(m: np.ndarray) -> np.ndarray:
    """The eigenvalues become those of a thin disc."""
    return _spectral(m, lambda v: np.broadcast_to(np.array([1e-3, 1.0, 1.0]), v.shape))


def normalized_covariance(m: np.ndarray) -> np.ndarray:
    """Eigenvalues over the largest, not below a thousandth; the identity where there is none."""
    top = np.linalg.eigvalsh(m)[..., -1]
    ok = np.isfinite(top) & (top > 1e-12)
    out = _spectral(m, lambda v: np.clip(v / np.where(ok, top, 1)[..., None], 1e-3, 1))
    return np.where(ok[..., None, None], out, np.eye(3))


def curvature(m: np.ndarray) -> np.ndarray:
    v = np.linalg.eigvalsh(m)
    total = v.sum(-1)
    return np.where(total > 1e-12, v[..., 0] / np.where(total > 1e-12, total, 1), 1.0)


def inverse3(m: np.ndarray) -> np.ndarray:
    """Inverse, or the zero matrix where the determinant is below 1e-6."""
    bad = np.abs(np.linalg.det(m)) < 1e-6
    out = np.linalg.inv(np.where(bad[..., None, None], np.eye(3), m))
    return np.where(bad[..., None, None], 0.0, out)


def normal_of(m: np.ndarray, p: np.ndarray, limit: float = 1.0) -> np.ndarray:
    """The eigenvector of the smallest eigenvalue, turned round where its product with the point is
    above `limit` (0 makes all face the sensor)."""
    n = np.linalg.eigh(m)[1][..., 0]
    return np.where((n * p).sum(-1, keepdims=True) > limit, -n, n)


def solve_cholesky(h: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    try:
        low = np.linalg.cholesky(h)
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(low.T, np.linalg.solve(low, b))
