"""SE3 as column expressions: poses are arrays of 7 doubles [t, q_xyzw], tangents of 6 [tau, phi].

An argument that is used more than once is bound by a lambda (`let`), so expressions nest without
growing. Coefficients are series near angle 0; a logarithm takes the quaternion of least angle, whose
arc tangent is right near pi too. A null pose or tangent gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Angle below which series stand for closed forms that cancel.
SMALL = 0.02


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _cross(a: list, b: list) -> list:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list, b: list) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _turned(q: list, v: list) -> list:
    """v turned by the unit quaternion q = [x, y, z, w]."""
    across = _cross(q, v)
    twice = _cross(q, across)
    return [v[k] + 2 * (q[3] * across[k] + twice[k]) for k in range(3)]


def _times(a: list, b: list) -> list:
    """Product of quaternions."""
    across = _cross(a, b)
    return [a[3] * b[k] + b[3] * a[k] + across[k] for k in range(3)] + [a[3] * b[3] - _dot(a, b)]


def _parts(array: Column, first: int, last: int) -> list:
    return [array[k] for k in range(first, last)]


def _valid(out: Column, *arrays: Column) -> Column:
    known = arrays[0].isNotNull()
    for a in arrays[1:]:
        known = known & a.isNotNull()
    return F.when(known, out)


def product(a: Column, b: Column) -> Column:
    """a after b."""

    def body(x, y):
        moved = _turned(_parts(x, 3, 7), _parts(y, 0, 3))
        return F.array(*[x[k] + moved[k] for k in range(3)], *_times(_parts(x, 3, 7), _parts(y, 3, 7)))

    return let(a, lambda x: let(b, lambda y: _valid(body(x, y), x, y)))


def inverse(a: Column) -> Column:
    def body(x):
        q = [-x[3], -x[4], -x[5], x[6]]
        return F.array(*[-v for v in _turned(q, _parts(x, 0, 3))], *q)

    return let(a, lambda x: _valid(body(x), x))


def act(a: Column, point: Column) -> Column:
    """The point [x, y, z] in the frame that the pose leads to."""

    def body(x, p):
        moved = _turned(_parts(x, 3, 7), _parts(p, 0, 3))
        return F.array(*[x[k] + moved[k] for k in range(3)])

    return let(a, lambda x: let(point, lambda p: _valid(body(x, p), x, p)))


def adjoint(a: Column, xi: Column) -> Column:
    """Ad_a of a tangent: a exp(xi) = exp(adjoint(a, xi)) a."""

    def body(x, v):
        q = _parts(x, 3, 7)
        phi = _turned(q, _parts(v, 3, 6))
        lever = _cross(_parts(x, 0, 3), phi)
        return F.array(*[t + m for t, m in zip(_turned(q, _parts(v, 0, 3)), lever)], *phi)

    return let(a, lambda x: let(xi, lambda v: _valid(body(x, v), x, v)))


def exp(xi: Column) -> Column:
    """Pose of a tangent."""

    def body(v, angle):
        square = angle * angle
        safe = F.when(angle > 0, angle)
        small = angle < SMALL
        half = F.when(small, 0.5 - square / 48 + square * square / 3840).otherwise(F.sin(angle / 2) / safe)
        one = 2 * half * half  # (1 - cos) / angle^2
        two = F.when(small, F.lit(1 / 6) - square / 120 + square * square / 5040).otherwise((angle - F.sin(angle)) / (safe * safe * safe))
        tau, phi = _parts(v, 0, 3), _parts(v, 3, 6)
        once = _cross(phi, tau)
        twice = _cross(phi, once)
        return let(F.array(half, one, two), lambda c: F.array(*[tau[k] + c[1] * once[k] + c[2] * twice[k] for k in range(3)], *[phi[k] * c[0] for k in range(3)], F.cos(angle / 2)))

    return let(xi, lambda v: _valid(let(F.sqrt(_dot(_parts(v, 3, 6), _parts(v, 3, 6))), lambda angle: body(v, angle)), v))


def log(a: Column) -> Column:
    """Tangent of a pose, of the angle up to pi."""

    def body(x, sine):  # sine and cosine of half the angle
        sign = F.when(x[6] < 0, -1.0).otherwise(1.0)
        cosine = sign * x[6]
        small = sine < SMALL / 2
        safe = F.when(sine > 0, sine)
        half = F.atan2(sine, cosine)
        square = sine * sine
        scale = F.when(small, 2 * (1 + square / 6 + 3 * square * square / 40)).otherwise(2 * half / safe)
        angle2 = 4 * half * half
        two = F.when(small, F.lit(1 / 12) + angle2 / 720 + angle2 * angle2 / 30240).otherwise((1 - half * cosine / safe) / F.when(angle2 > 0, angle2))

        def tangent(c):
            tau, phi = _parts(x, 0, 3), [x[3 + k] * c[0] for k in range(3)]
            once = _cross(phi, tau)
            twice = _cross(phi, once)
            return F.array(*[tau[k] - once[k] / 2 + c[1] * twice[k] for k in range(3)], *phi)

        return let(F.array(sign * scale, two), tangent)

    return let(a, lambda x: _valid(let(F.sqrt(_dot(_parts(x, 3, 6), _parts(x, 3, 6))), lambda sine: body(x, sine)), x))


def scaled(xi: Column, share: Column) -> Column:
    return let(share, lambda s: F.transform(xi, lambda v: v * s))


def interpolate(left: Column, right: Column, share: Column) -> Column:
    """Pose at a share of the way from left to right, at constant velocity."""
    return let(left, lambda a: product(exp(scaled(log(product(right, inverse(a))), share)), a))


def extrapolate(before: Column, last: Column, share: float = 0.5) -> Column:
    """The last pose moved on by a share of the last step.

    Taken from the pose before, so the quaternion's sign follows that pose's, as interpolate's does, also
    where the last step turned the sign of its own.
    """
    return interpolate(before, last, F.lit(1 + share))
