"""Points, planes, angles and rotations as Column expressions (codegen, no Python at run time).

A point or vector is a tuple of three Columns; a plane is a tuple a, b, c, d of a*x + b*y + c*z + d = 0; an axis-angle is a
vector and an angle; a rotation matrix is a tuple of nine Columns by rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Plane = tuple[Column, Column, Column, Column]


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vector, by: Column) -> Vector:
    return tuple(x * by for x in a)


def dot(a: tuple, b: tuple) -> Column:
    return reduce(lambda x, y: x + y, [x * y for x, y in zip(a, b)])


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """Null for a zero vector."""
    return scale(a, 1 / F.nullif(norm(a), F.lit(0.0)))


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def angle_between(a: Vector, b: Vector) -> Column:
    """Degrees between two vectors from half the chord of their unit vectors; steady near 0 and 180."""
    u, v = unit(a), unit(b)
    near = 2 * F.asin(_clip(norm(sub(u, v)) / 2))
    far = F.lit(3.141592653589793) - 2 * F.asin(_clip(norm(tuple(x + y for x, y in zip(u, v))) / 2))
    return F.degrees(F.when(dot(u, v) >= 0, near).otherwise(far))


def angle3d(a: Vector, b: Vector) -> Column:
    return F.degrees(F.acos(_clip(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))))


def angle2d(p1: tuple, p2: tuple, p3: tuple) -> Column:
    """Degrees at ``p2`` from ``p1`` to ``p3`` counter-clockwise, 0 to 360."""
    ax, ay, bx, by = p1[0] - p2[0], p1[1] - p2[1], p3[0] - p2[0], p3[1] - p2[1]
    turn = F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))
    return F.when(turn < 0, turn + 360).otherwise(turn)


def joint_angle(p1: Vector, p2: Vector, p3: Vector, supplementary: bool = False, relative: bool = False) -> Column:
    """Degrees at ``p2``: the angle, its supplement, its negative (relative), or 180 less it (both)."""
    angle = angle3d(sub(p1, p2), sub(p3, p2))
    if supplementary:
        return 180 - angle if relative else F.abs(180 - angle)
    return -angle if relative else angle


def plane_distance(plane: Plane, p: Vector, signed: bool = False) -> Column:
    """Distance of a point; signed: positive on the upper side, whichever way the plane's normal points."""
    d = (dot(plane[:3], p) + plane[3]) / F.nullif(norm(plane[:3]), F.lit(0.0))
    return F.when(plane[1] < 0, -d).otherwise(d) if signed else F.abs(d)


def plane_angle(plane: Plane, v: Vector) -> Column:
    """Degrees between a direction and the plane."""
    return 90 - angle3d(plane[:3], v)


def project(plane: Plane, p: Vector) -> Vector:
    far = (dot(plane[:3], p) + plane[3]) / F.nullif(dot(plane[:3], plane[:3]), F.lit(0.0))
    return sub(p, scale(plane[:3], far))


def intersect(plane: Plane, p1: Vector, p2: Vector) -> Vector:
    """Where the line through two points meets the plane; null where it does not."""
    way = sub(p2, p1)
    share = -(dot(plane[:3], p1) + plane[3]) / F.nullif(dot(plane[:3], way), F.lit(0.0))
    return tuple(x + share * y for x, y in zip(p1, way))


def rotation_between(a: Vector, b: Vector) -> tuple[Vector, Column]:
    """Axis and angle (radians) that turn ``a`` to ``b``; a null axis where they are parallel."""
    u, v = unit(a), unit(b)
    return unit(cross(u, v)), F.acos(_clip(dot(u, v)))


def rotation_matrix(axis: Vector, angle: Column) -> tuple[Column, ...]:
    """Rodrigues' formula."""
    x, y, z = axis
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    return (t * x * x + c, t * x * y - s * z, t * x * z + s * y, t * x * y + s * z, t * y * y + c, t * y * z - s * x, t * x * z - s * y, t * y * z + s * x, t * z * z + c)


def matrix_rotation(m: tuple[Column, ...]) -> tuple[Vector, Column]:
    """Axis and angle of a rotation matrix; at a half turn the axis is read off the diagonal, at none it is null."""
    angle = F.acos(_clip((m[0] + m[4] + m[8] - 1) / 2))
    skew = (m[7] - m[5], m[2] - m[6], m[3] - m[1])
    size = F.nullif(norm(skew), F.lit(0.0))
    root = lambda d: F.sqrt(F.greatest(F.lit(0.0), (d + 1) / 2))
    x = root(m[0])
    y = F.when(x > 1e-9, m[1] / (2 * x)).otherwise(root(m[4]))
    z = F.when(x > 1e-9, m[2] / (2 * x)).when(y > 1e-9, m[5] / (2 * y)).otherwise(root(m[8]))
    half = (x, y, z)
    return tuple(F.when(angle < 3.1415, s / size).otherwise(h) for s, h in zip(skew, half)), angle


def log_map(a: Vector, b: Vector) -> Vector:
    """The rotation from ``a`` to ``b`` as axis times angle; zero for parallel vectors, null where one is zero."""
    axis, angle = rotation_between(a, b)
    known = dot(a, a) * dot(b, b) > 0
    return tuple(F.when(known, F.coalesce(x * angle, F.lit(0.0))) for x in axis)


def exp_map(rotation: Vector) -> tuple[Column, ...]:
    """The matrix of an axis-times-angle vector; the identity for zero."""
    angle = norm(rotation)
    axis = tuple(F.coalesce(x / F.nullif(angle, F.lit(0.0)), F.lit(0.0)) for x in rotation)
    return rotation_matrix(axis, angle)
