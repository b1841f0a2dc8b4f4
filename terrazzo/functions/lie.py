"""SE3 in numpy, for Arrow functions over pose arrays: 7 numbers [t, q_xyzw]."""

from __future__ import annotations

import numpy as np


def _hat(w: np.ndarray) -> np.ndarray:
    z = np.zeros(w.shape[:-1])
    return np.stack([np.stack([z, -w[..., 2], w[..., 1]], -1), np.stack([w[..., 2], z, -w[..., 0]], -1), np.stack([-w[..., 1], w[..., 0], z], -1)], -2)


def quat_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    av, aw, bv, bw = a[..., :3], a[..., 3:], b[..., :3], b[..., 3:]
    return np.concatenate([aw * bv + bw * av + np.cross(av, bv), aw * bw - (av * bv).sum(-1, keepdims=True)], -1)


def quat_rotate(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    uv = np.cross(q[..., :3], p)
    return p + 2 * (q[..., 3:] * uv + np.cross(q[..., :3], uv))


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([a[..., :3] + quat_rotate(a[..., 3:], b[..., :3]), quat_mul(a[..., 3:], b[..., 3:])], -1)


def inv(a: np.ndarray) -> np.ndarray:
    q = a[..., 3:] * np.array([-1, -1, -1, 1.0])
    return np.concatenate([-quat_rotate(q, a[..., :3]), q], -1)


def act(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return a[..., :3] + quat_rotate(a[..., 3:], p)


#: Angle below which series stand for closed forms that cancel.
SMALL = 0.02


def _left(theta: np.ndarray, w: np.ndarray, inverse: bool) -> np.ndarray:
    """Left Jacobian of SO3, or its inverse."""
    t2, k = theta**2, _hat(w)
    small = theta < SMALL
    safe = np.where(small, 1.0, theta)
    if inverse:
        b = np.where(small, 1 / 12 + t2 / 720 + t2**2 / 30240, (1 - safe / 2 / np.tan(safe / 2)) / safe**2)
        return np.eye(3) - 0.5 * k + b[..., None, None] * (k @ k)
    a = np.where(small, 0.5 - t2 / 24 + t2**2 / 720, (1 - np.cos(safe)) / safe**2)
    b = np.where(small, 1 / 6 - t2 / 120 + t2**2 / 5040, (safe - np.sin(safe)) / safe**3)
    return np.eye(3) + a[..., None, None] * k + b[..., None, None] * (k @ k)


def exp(xi: np.ndarray) -> np.ndarray:
    """Tangent [tau, phi] to a pose."""
    tau, phi = xi[..., :3], xi[..., 3:]
    theta = np.linalg.norm(phi, axis=-1)
    half = np.where(theta < 1e-8, 0.5 - theta**2 / 48, np.sin(theta / 2) / np.where(theta < 1e-8, 1.0, theta))
    q = np.concatenate([phi * half[..., None], np.cos(theta / 2)[..., None]], -1)
    return np.concatenate([(_left(theta, phi, False) @ tau[..., None])[..., 0], q], -1)


def log(a: np.ndarray) -> np.ndarray:
    q = a[..., 3:] * np.where(a[..., 6:7] < 0, -1.0, 1.0)
    n = np.linalg.norm(q[..., :3], axis=-1)
    angle = 2 * np.arctan2(n, q[..., 3])
    phi = q[..., :3] * np.where(n < 1e-10, 2.0, angle / np.where(n < 1e-10, 1.0, n))[..., None]
    theta = np.linalg.norm(phi, axis=-1)
    return np.concatenate([(_left(theta, phi, True) @ a[..., :3, None])[..., 0], phi], -1)


def matrix(a: np.ndarray) -> np.ndarray:
    out = np.zeros((*a.shape[:-1], 4, 4))
    for k in range(3):
        out[..., :3, k] = quat_rotate(a[..., 3:], np.broadcast_to(np.eye(3)[k], a[..., :3].shape))
    out[..., :3, 3], out[..., 3, 3] = a[..., :3], 1
    return out


def adjoint(a: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Ad_a of a tangent vector."""
    tau, phi = quat_rotate(a[..., 3:], xi[..., :3]), quat_rotate(a[..., 3:], xi[..., 3:])
    return np.concatenate([tau + np.cross(a[..., :3], phi), phi], -1)


def interpolate(left: np.ndarray, right: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Constant-velocity pose between two poses."""
    return mul(exp(share[..., None] * log(mul(right, inv(left)))), left)


def extrapolate(before: np.ndarray, last: np.ndarray, share: float = 0.5) -> np.ndarray:
    """The last pose moved on by a share of the last step; the quaternion's sign follows the pose before."""
    return interpolate(before, last, np.array(1 + share))
