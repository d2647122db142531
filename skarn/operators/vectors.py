"""Vectors, rotations and rigid motions as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(*cols: Column) -> Column:
    return F.array(*[c.cast("double") for c in cols])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def unit(a: Column) -> Column:
    """a over its length, null for a zero vector."""
    return F.transform(a, lambda x: F.try_divide(x, norm(a)))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def matmul(a: Column, b: Column) -> Column:
    """3 x 3 times 3 x 3, row by row."""
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def turn(m: Column, v: Column) -> Column:
    return F.array(*[m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


def transposed(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


def move(m: Column, t: Column, p: Column) -> Column:
    """A point after a rotation and a shift."""
    return plus(turn(m, p), t)


def inverse_motion(m: Column, t: Column) -> Column:
    """(rotation, shift) that undo a rigid motion."""
    back = transposed(m)
    return F.struct(back.alias("r"), times(turn(back, t), F.lit(-1.0)).alias("t"))


def rodrigues(axis: Column, angle: Column) -> Column:
    """Rotation by an angle about an axis of length 1."""
    x, y, z = axis[0], axis[1], axis[2]
    c, s = F.cos(angle), F.sin(angle)
    k = 1 - c
    return F.array(c + x * x * k, x * y * k - z * s, x * z * k + y * s, y * x * k + z * s, c + y * y * k, y * z * k - x * s, z * x * k - y * s, z * y * k + x * s, c + z * z * k)


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Rotation of a quaternion, which is brought to length 1 first."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def roll_pitch_yaw(m: Column) -> Column:
    """Fixed-axis angles of a rotation; yaw is 0 where the pitch is a quarter turn."""
    flat = F.sqrt(m[0] * m[0] + m[3] * m[3])
    whole = flat > 1e-6
    return F.array(F.when(whole, F.atan2(m[7], m[8])).otherwise(F.atan2(-m[5], m[4])), F.atan2(-m[6], flat), F.when(whole, F.atan2(m[3], m[0])).otherwise(0.0))


def turn_angle(m: Column) -> Column:
    """The angle of a rotation, from its trace."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1) / 2)))


def axis_angle_error(a: Column, b: Column) -> Column:
    """Degrees between two undirected axes."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)) / (norm(a) * norm(b)))))


def line_distance(p: Column, u: Column, q: Column, v: Column) -> Column:
    """Distance of the lines through p along u and through q along v; parallel lines by the part
    of q - p across u."""
    n = cross(u, v)
    w = minus(q, p)
    across = minus(w, times(u, dot(w, u) / dot(u, u)))
    return F.when(norm(n) < 1e-9, norm(across)).otherwise(F.abs(F.try_divide(dot(w, n), norm(n))))


def onto_axis(p: Column, origin: Column, axis: Column) -> Column:
    """The point of an axis nearest to p."""
    return plus(origin, times(axis, dot(minus(p, origin), axis) / dot(axis, axis)))


def project(p: Column, f: float, cx: float, cy: float) -> Column:
    """Pixel of a point before a pinhole camera; null behind it."""
    ahead = F.when(p[2] > 1e-6, p[2])
    return F.array(f * p[0] / ahead + cx, f * p[1] / ahead + cy)


def reprojection_error(p: Column, pixel: Column, f: float, cx: float, cy: float) -> Column:
    """Pixels between a projected point and where it was seen; infinite behind the camera."""
    return F.coalesce(F.when(p[2] > 1e-6, norm(minus(project(p, f, cx, cy), pixel))), F.lit(float("inf")))
