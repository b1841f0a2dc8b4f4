"""Image arithmetic in numpy, for functions over decoded images."""

from __future__ import annotations

import numpy as np


def resize(image: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    """nearest, linear or area resize of an image (height x width x ...)."""
    h, w = image.shape[:2]
    if kind == "nearest":
        y = np.minimum((np.arange(height) / (height / h)).astype(int), h - 1)
        x = np.minimum((np.arange(width) / (width / w)).astype(int), w - 1)
        return image[y][:, x]
    out = image.astype(float)
    for axis, (n, m) in enumerate(((h, height), (w, width))):
        if kind == "area" and m < n:
            edges = np.linspace(0, n, m + 1)
            weights = np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, None) / (n / m)
        else:
            at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
            low = np.minimum(at.astype(int), max(n - 2, 0))
            weights = np.zeros((m, n))
            weights[np.arange(m), low] = 1 - (at - low)
            weights[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
        out = np.moveaxis(np.tensordot(weights, out, (1, axis)), 0, axis)
    return out


def sample(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bilinear values at (u, v); the nearest pixel at the borders; 0 outside."""
    h, w = image.shape[:2]
    inside = (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)
    u0, v0 = np.clip(np.floor(u).astype(int), 0, max(w - 2, 0)), np.clip(np.floor(v).astype(int), 0, max(h - 2, 0))
    u1, v1 = np.minimum(u0 + 1, w - 1), np.minimum(v0 + 1, h - 1)
    a, b = np.clip(u - u0, 0, 1), np.clip(v - v0, 0, 1)
    shape = (...,) + (None,) * (image.ndim - 2)
    a, b = a[shape], b[shape]
    out = image[v0, u0] * (1 - a) * (1 - b) + image[v0, u1] * a * (1 - b) + image[v1, u0] * (1 - a) * b + image[v1, u1] * a * b
    return out * inside[shape]


def rectification(width: int, height: int, k: np.ndarray, distortion: np.ndarray, new_k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of the rectified image lies in the lens image (k1 k2 p1 p2 [k3])."""
    v, u = np.mgrid[:height, :width].astype(float)
    x, y = (u - new_k[0, 2]) / new_k[0, 0], (v - new_k[1, 2]) / new_k[1, 1]
    k1, k2, p1, p2, k3 = [*distortion, *[0.0] * (5 - len(distortion))]
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    xd = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    yd = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return k[0, 0] * xd + k[0, 2], k[1, 1] * yd + k[1, 2]


def correlation_pyramid(a: np.ndarray, b: np.ndarray, levels: int = 4) -> list[np.ndarray]:
    """All-pairs dot products of two feature maps (h x w x c) over sqrt(c), b halved level by level."""
    c = a.shape[-1]
    out = [np.einsum("ijc,klc->ijkl", a, b) / np.sqrt(c)]
    for _ in range(levels - 1):
        x = out[-1]
        h, w = x.shape[2] // 2 * 2, x.shape[3] // 2 * 2
        out.append(x[:, :, :h, :w].reshape(*x.shape[:2], h // 2, 2, w // 2, 2).mean(axis=(3, 5)))
    return out


def correlation_window(pyramid: list[np.ndarray], u: np.ndarray, v: np.ndarray, radius: int = 3) -> np.ndarray:
    """h x w x levels x (2r+1)^2: bilinear lookups around (u, v), given per pixel at the first level."""
    h, w = u.shape
    d = np.arange(-radius, radius + 1)
    out = np.zeros((h, w, len(pyramid), len(d) ** 2))
    for level, volume in enumerate(pyramid):
        for i in range(h):
            for j in range(w):
                uu, vv = np.meshgrid(u[i, j] / 2**level + d, v[i, j] / 2**level + d)
                out[i, j, level] = sample(volume[i, j], uu, vv).ravel()
    return out
