"""Rotations and rigid motions as column expressions; matrices are row-major ``array<double>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(a: Column, i: int) -> Column:
    return F.element_at(a, i + 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quaternion_to_matrix(q: Column) -> Column:
    """3x3 matrix of a quaternion (w, x, y, z), normalised first."""

    def turn(u: Column) -> Column:
        w, x, y, z = (_at(u, i) for i in range(4))
        one = F.lit(1.0)
        return F.array(
            one - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), one - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), one - 2 * (x * x + y * y),
        )

    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(let(q, lambda v: F.transform(v, lambda x: x / length(v))), turn)


def matrix_to_quaternion(m: Column) -> Column:
    """Quaternion (w, x, y, z) of a 3x3 matrix, by the largest of the four diagonal forms."""
    return let(m, _to_quaternion)


def _to_quaternion(m: Column) -> Column:
    a = [[_at(m, 3 * i + j) for j in range(3)] for i in range(3)]
    trace = a[0][0] + a[1][1] + a[2][2]

    def form(radicand: Column, parts) -> Column:
        root = 2 * F.sqrt(radicand)
        return F.array(*parts(root))

    by_trace = form(trace + 1.0, lambda s: [s / 4, (a[2][1] - a[1][2]) / s, (a[0][2] - a[2][0]) / s, (a[1][0] - a[0][1]) / s])
    by_x = form(1.0 + a[0][0] - a[1][1] - a[2][2], lambda s: [(a[2][1] - a[1][2]) / s, s / 4, (a[0][1] + a[1][0]) / s, (a[0][2] + a[2][0]) / s])
    by_y = form(1.0 + a[1][1] - a[0][0] - a[2][2], lambda s: [(a[0][2] - a[2][0]) / s, (a[0][1] + a[1][0]) / s, s / 4, (a[1][2] + a[2][1]) / s])
    by_z = form(1.0 + a[2][2] - a[0][0] - a[1][1], lambda s: [(a[1][0] - a[0][1]) / s, (a[0][2] + a[2][0]) / s, (a[1][2] + a[2][1]) / s, s / 4])
    q = (
        F.when(trace > 0, by_trace)
        .when((a[0][0] > a[1][1]) & (a[0][0] > a[2][2]), by_x)
        .when(a[1][1] > a[2][2], by_y)
        .otherwise(by_z)
    )
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    return let(q, lambda v: F.transform(v, lambda x: x / length(v)))


def pose(rotation: Column, translation: Column) -> Column:
    """4x4 pose of a 3x3 rotation and a translation."""

    def rows(r: Column, t: Column) -> Column:
        top = [x for i in range(3) for x in (*(_at(r, 3 * i + j) for j in range(3)), _at(t, i))]
        return F.array(*top, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))

    return let(rotation, lambda r: let(translation, lambda t: rows(r, t)))


def rotation_of(p: Column) -> Column:
    """The 3x3 rotation of a 4x4 pose."""
    return let(p, lambda v: F.array(*[_at(v, 4 * i + j) for i in range(3) for j in range(3)]))


def translation_of(p: Column) -> Column:
    """The translation of a 4x4 pose."""
    return let(p, lambda v: F.array(*[_at(v, 4 * i + 3) for i in range(3)]))


def inverse_pose(p: Column) -> Column:
    """Inverse of a rigid 4x4 pose: transposed rotation, rotated back translation."""
    r = [[_at(p, 4 * i + j) for j in range(3)] for i in range(3)]
    t = [_at(p, 4 * i + 3) for i in range(3)]
    turned = F.array(*[r[j][i] for i in range(3) for j in range(3)])
    back = F.array(*[-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2]) for i in range(3)])
    return pose(turned, back)


def multiply_poses(p: Column, q: Column) -> Column:
    """Product of two 4x4 poses."""
    return let(p, lambda a: let(q, lambda b: _product(a, b)))


def _product(p: Column, q: Column) -> Column:
    rotation = F.array(*[
        _at(p, 4 * i) * _at(q, j) + _at(p, 4 * i + 1) * _at(q, 4 + j) + _at(p, 4 * i + 2) * _at(q, 8 + j)
        for i in range(3) for j in range(3)
    ])
    translation = F.array(*[
        _at(p, 4 * i) * _at(q, 3) + _at(p, 4 * i + 1) * _at(q, 7) + _at(p, 4 * i + 2) * _at(q, 11) + _at(p, 4 * i + 3)
        for i in range(3)
    ])
    return pose(rotation, translation)


def rotation_degrees(p: Column) -> Column:
    """Angle of the rotation of a pose, from its trace."""
    trace = let(p, lambda v: _at(v, 0) + _at(v, 5) + _at(v, 10))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def geodesic_loss(q: Column, r: Column) -> Column:
    """Angle between two unit quaternions, sign aside."""
    inner = F.aggregate(F.zip_with(q, r, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.least(F.lit(1.0), F.abs(inner)))
