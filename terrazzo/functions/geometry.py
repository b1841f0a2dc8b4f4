"""Camera and pose geometry as column expressions; everything is computed in double.

A pose is 12 columns or a row-major array of 16 numbers. Divisions are guarded, as expressions
of a filter may run in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 1e-3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), _c(low)), _c(high))


def finite(x) -> Column:
    """Neither null, NaN nor infinite."""
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def long_side_size(width, height, target) -> tuple[Column, Column]:
    """Both sides scaled so that the longer is `target`, halves to even, at least 1."""
    scale = _c(target).cast("double") / F.greatest(_c(width), _c(height))
    return tuple(F.greatest(F.lit(1), F.bround(_c(side) * scale, 0).cast("int")) for side in (width, height))


def rescale_intrinsics(fx, fy, cx, cy, sx, sy) -> tuple[Column, Column, Column, Column]:
    return _c(fx) * _c(sx), _c(fy) * _c(sy), _c(cx) * _c(sx), _c(cy) * _c(sy)


def resize_and_crop(height, width, target_pixels: float) -> dict[str, Column]:
    """Scale to about `target_pixels`, truncate, crop around the centre to multiples of 8."""
    scale = F.sqrt(F.lit(float(target_pixels)) / (_c(height) * _c(width)))
    h, w = (_c(height) * scale).cast("int"), (_c(width) * scale).cast("int")
    ch, cw = h - F.pmod(h, F.lit(8)), w - F.pmod(w, F.lit(8))
    return {"h": ch, "w": cw, "top": ((h - ch) / 2).cast("int"), "left": ((w - cw) / 2).cast("int"), "sy": h / _c(height), "sx": w / _c(width)}


def nearest_index(i, size_in, size_out) -> Column:
    """Source index of output pixel i when a line of size_in pixels becomes size_out."""
    return F.least((_c(i) / (_c(size_out) / _c(size_in))).cast("int"), _c(size_in) - 1)


def pose_column(pose, row: int, column: int) -> Column:
    return _c(pose)[row * 4 + column]


def world_to_camera(x, y, z, pose) -> tuple[Column, Column, Column]:
    """R^T (X - t) for a camera-to-world pose, terms in a fixed order."""
    d = [_c(v) - pose_column(pose, i, 3) for i, v in enumerate((x, y, z))]
    return tuple(pose_column(pose, 0, k) * d[0] + pose_column(pose, 1, k) * d[1] + pose_column(pose, 2, k) * d[2] for k in range(3))


def apply_pose(x, y, z, pose) -> tuple[Column, Column, Column]:
    return tuple(pose_column(pose, k, 0) * _c(x) + pose_column(pose, k, 1) * _c(y) + pose_column(pose, k, 2) * _c(z) + pose_column(pose, k, 3) for k in range(3))


def invert_pose(pose) -> Column:
    """Closed-form inverse of a rigid pose."""
    p = lambda i, j: pose_column(pose, i, j)
    rows = []
    for k in range(3):
        rows += [p(0, k), p(1, k), p(2, k), -(p(0, k) * p(0, 3) + p(1, k) * p(1, 3) + p(2, k) * p(2, 3))]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def compose(a, b) -> Column:
    """Product of two poses."""
    cells = []
    for i in range(3):
        for j in range(4):
            total = pose_column(a, i, 0) * pose_column(b, 0, j) + pose_column(a, i, 1) * pose_column(b, 1, j) + pose_column(a, i, 2) * pose_column(b, 2, j)
            cells.append(total + pose_column(a, i, 3) if j == 3 else total)
    return F.array(*cells, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def project(x, y, z, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Pinhole image coordinates; null at or before the near plane."""
    front = _c(z) > NEAR
    return tuple(F.when(front, _c(f) * _c(v) / F.when(front, _c(z)) + _c(c)) for f, v, c in ((fx, x, cx), (fy, y, cy)))


def unproject(u, v, depth, fx, fy, cx, cy) -> tuple[Column, Column, Column]:
    return (_c(u) - _c(cx)) / _c(fx) * _c(depth), (_c(v) - _c(cy)) / _c(fy) * _c(depth), _c(depth)


def unproject_disparity(u, v, disparity, fx, fy, cx, cy) -> tuple[Column, Column, Column, Column]:
    """Homogeneous point (X, Y, 1, d) of an inverse depth."""
    return (_c(u) - _c(cx)) / _c(fx), (_c(v) - _c(cy)) / _c(fy), F.lit(1.0), _c(disparity)


def project_homogeneous(x, y, z, d, fx, fy, cx, cy) -> tuple[Column, Column, Column]:
    """Image coordinates and disparity; a depth under 0.1 counts as 1."""
    safe = F.when(_c(z) < 0.1, F.lit(1.0)).otherwise(_c(z))
    return _c(fx) * (_c(x) / safe) + _c(cx), _c(fy) * (_c(y) / safe) + _c(cy), _c(d) / safe


def visible(u, v, z, measured, width, height, tolerance) -> Column:
    """In front, inside the image, measured, and within `tolerance` of what was measured."""
    inside = (_c(u) >= 0) & (_c(u) < _c(width)) & (_c(v) >= 0) & (_c(v) < _c(height))
    return (_c(z) > NEAR) & finite(u) & finite(v) & inside & (_c(measured) > NEAR) & (F.abs(_c(z) - _c(measured)) <= _c(tolerance))


def rotation_degrees(trace) -> Column:
    """Angle of a relative rotation from its trace."""
    return F.degrees(F.acos(clip((_c(trace) - 1) / 2, -1.0, 1.0)))


def translation_degrees(ax, ay, az, bx, by, bz, default: float = 1e6) -> Column:
    """Angle between two directions without regard to sign; `default` where undefined."""
    dot = _c(ax) * _c(bx) + _c(ay) * _c(by) + _c(az) * _c(bz)
    norm = F.sqrt(_c(ax) ** 2 + _c(ay) ** 2 + _c(az) ** 2) * F.sqrt(_c(bx) ** 2 + _c(by) ** 2 + _c(bz) ** 2)
    angle = F.degrees(F.acos(clip(dot / F.when(norm > 0, norm), -1.0, 1.0)))
    return F.when(finite(angle), F.least(angle, F.abs(180 - angle))).otherwise(F.lit(default))


def quaternion(m: list[Column]) -> Column:
    """wxyz of a row-major 3x3 matrix with w >= 0, by Shepperd's method.

    The trace and the diagonal tell which part of the quaternion is largest; that one comes from a
    root, which is then at least 1, and the others from sums or differences across the diagonal.
    """
    at = lambda row, column: m[3 * (row % 3) + column % 3]
    trace = at(0, 0) + at(1, 1) + at(2, 2)
    across = lambda k, sign: at(k + 2, k + 1) + sign * at(k + 1, k + 2)
    # the real part is the largest: the axis is the skew part
    root = F.sqrt(1 + trace)
    found = F.when(trace >= F.greatest(*[at(k, k) for k in range(3)]), F.array(root / 2, *[across(k, -1) / (2 * root) for k in range(3)]))
    for k in range(3):  # the part along axis k is the largest
        root = F.sqrt(1 + 2 * at(k, k) - trace)
        along = {k: root / 2, (k + 1) % 3: across(k + 2, 1) / (2 * root), (k + 2) % 3: across(k + 1, 1) / (2 * root)}
        q = F.array(across(k, -1) / (2 * root), *[along[j] for j in range(3)])
        found = found.when(at(k, k) >= F.greatest(at(k + 1, k + 1), at(k + 2, k + 2)), q)
    return F.transform(found, lambda x: F.when(found[0] < 0, -x).otherwise(x))


def quaternion_matrix(w, x, y, z) -> list[Column]:
    """Row-major 3x3 matrix of a unit quaternion."""
    w, x, y, z = map(_c, (w, x, y, z))
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def to_millimetres(depth, least: float = 0.0, most: float = 65.535) -> Column:
    """Whole millimetres, halves to even; 0 outside the valid range."""
    d = _c(depth)
    return F.when(finite(d) & (d > least) & (d <= most), F.rint(d * 1000).cast("int")).otherwise(F.lit(0))


def from_millimetres(raw) -> Column:
    return F.when(_c(raw) > 0, _c(raw) / 1000.0).otherwise(F.lit(0.0))


def voxel(x, size) -> Column:
    return F.floor(_c(x) / _c(size))


def block(i, size: int) -> tuple[Column, Column]:
    """Block number and place inside it, right for negative indices too."""
    return F.floor(_c(i) / size), F.pmod(_c(i), F.lit(size))


def sdf_along_ray(depth, cz, u, v, fx, fy, cx, cy, truncation) -> Column:
    """Signed distance along the viewing ray over the truncation, at most 1; null behind it."""
    du, dv = (_c(u) - _c(cx)) / _c(fx), (_c(v) - _c(cy)) / _c(fy)
    sdf = (_c(depth) - _c(cz)) * F.sqrt(du * du + dv * dv + 1)
    return F.when(sdf > -_c(truncation), F.least(F.lit(1.0), sdf / _c(truncation)))


def bilinear(values: list[Column], au, av) -> Column:
    """Weighted mean of the four pixels 00, 10, 01, 11 at fractions au, av."""
    au, av = _c(au), _c(av)
    return values[0] * (1 - au) * (1 - av) + values[1] * au * (1 - av) + values[2] * (1 - au) * av + values[3] * au * av


def view_weight(nx, ny, nz, x, y, z, a: float = 1.0, b: float = 1.0) -> Column:
    """z^-b times the clipped incidence to the power a, at least 1e-6; (x, y, z) in the camera."""
    incidence = clip(F.abs((_c(nx) * _c(x) + _c(ny) * _c(y) + _c(nz) * _c(z)) / _c(z)), 0.0, 1.0)
    return F.greatest(F.pow(_c(z), F.lit(-b)) * F.pow(incidence, F.lit(a)), F.lit(1e-6))


def feature_cell(u, width, grid: int = 24) -> Column:
    return clip((_c(u) / _c(width) * grid).cast("int"), 0, grid - 1)


def huber(residual, delta: float) -> Column:
    """Weight of a residual: 1 inside delta, delta over it outside."""
    r = F.abs(_c(residual))
    return F.when(r <= delta, F.lit(1.0)).otherwise(F.lit(delta) / F.when(r > 0, r))


def retract_disparity(disparity, step) -> Column:
    """A step over 10 is void; the result is at least 1e-3."""
    return F.greatest(_c(disparity) + F.when(F.abs(_c(step)) > 10, F.lit(0.0)).otherwise(_c(step)), F.lit(1e-3))


def heading_moved(degrees: float) -> float:
    return math.cos(math.radians(degrees))
