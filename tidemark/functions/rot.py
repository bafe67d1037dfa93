"""Rotations and frames as plain column arithmetic.

A vector or matrix is a Python list of columns, a 3x3 matrix is nine of them by row.  So every formula is one flat expression
that code generation compiles, with common parts computed once; arrays are only built at the end.
Euler angles are roll, pitch and yaw about fixed axes in that order: R = Rz(yaw) Ry(pitch) Rx(roll).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
Columns = Sequence[Column]
#: Changes of axes of three robots, by row.
AXES = {"bcz": (0, -1, 0, -1, 0, 0, 0, 0, -1), "dobbe": (0, 1, 0, -1, 0, 0, 0, 0, 1), "jaco": (0, -1, 0, 1, 0, 0, 0, 0, 1)}


def unpack(array: Column, start: int, n: int) -> list[Column]:
    """``n`` components of an array from ``start`` (0-based) on."""
    return [F.get(array, F.lit(start + k)).cast("double") for k in range(n)]


def matmul(a: Columns, b: Columns) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def transpose(a: Columns) -> list[Column]:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def apply(a: Columns, v: Columns) -> list[Column]:
    return [a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3)]


def constant(values) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def about_axis(axis: int, angle: Column) -> list[Column]:
    """The rotation about x (0), y (1) or z (2)."""
    c, s, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return ([one, zero, zero, zero, c, -s, zero, s, c], [c, zero, s, zero, one, zero, -s, zero, c], [c, -s, zero, s, c, zero, zero, zero, one])[axis]


def euler_to_matrix(e: Columns) -> list[Column]:
    (cr, cp, cy), (sr, sp, sy) = ([f(x) for x in e] for f in (F.cos, F.sin))
    return [
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
        -sp, cp * sr, cp * cr,
    ]


def matrix_to_euler(m: Columns, eps: float = EPS) -> list[Column]:
    """Roll, pitch, yaw.  The floor under the square root keeps the angle defined at pitch +-90 degrees."""
    flat = F.sqrt(F.greatest(m[0] * m[0] + m[3] * m[3], F.lit(eps)))
    return [F.atan2(m[7], m[8]), F.atan2(-m[6], flat), F.atan2(m[3], m[0])]


def euler_to_quaternion(e: Columns) -> list[Column]:
    """x, y, z, w of Rx(roll) Ry(pitch) Rz(yaw), the other order than ``euler_to_matrix`` has."""
    (cx, cy, cz), (sx, sy, sz) = ([f(x * 0.5) for x in e] for f in (F.cos, F.sin))
    return [
        sx * cy * cz + cx * sy * sz,
        cx * sy * cz - sx * cy * sz,
        cx * cy * sz + sx * sy * cz,
        cx * cy * cz - sx * sy * sz,
    ]


def quaternion_to_matrix(q: Columns) -> list[Column]:
    """From x, y, z, w, of any length."""
    n = F.sqrt(F.greatest(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3], F.lit(EPS)))
    x, y, z, w = (c / n for c in q)
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def matrix_to_quaternion(m: Columns) -> list[Column]:
    """x, y, z, w of unit length, from the largest of the four sums of the diagonal."""
    trace = m[0] + m[4] + m[8]
    pick = F.when(trace > 0, 0).when((m[0] > m[4]) & (m[0] > m[8]), 1).when(m[4] > m[8], 2).otherwise(3)
    sums = [trace, m[0] - m[4] - m[8], m[4] - m[0] - m[8], m[8] - m[0] - m[4]]
    root = [F.sqrt(F.greatest(1 + s, F.lit(EPS))) * 2 for s in sums]
    x, y, z = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    xy, xz, yz = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    parts = [(x, y, z, None), (None, xy, xz, x), (xy, None, yz, y), (xz, yz, None, z)]
    raw = []
    for k in range(4):
        values = [0.25 * root[case] if p[k] is None else p[k] / (root[case] + EPS) for case, p in enumerate(parts)]
        raw.append(F.when(pick == 0, values[0]).when(pick == 1, values[1]).when(pick == 2, values[2]).otherwise(values[3]))
    n = F.sqrt(sum((c * c for c in raw[1:]), raw[0] * raw[0])) + EPS
    return [c / n for c in raw]


def quaternion_to_euler(q: Columns) -> list[Column]:
    return matrix_to_euler(quaternion_to_matrix(q))


def matrix_to_r6(m: Columns, by: str = "rows") -> list[Column]:
    """Six numbers of a rotation: its first two rows, or with ``by='columns'`` its first two columns."""
    return list(m[:6]) if by == "rows" else [m[0], m[3], m[6], m[1], m[4], m[7]]


def r6_to_matrix(r: Columns, by: str = "rows") -> list[Column]:
    """The rotation behind six numbers, made orthonormal by Gram and Schmidt."""

    def unit(v):
        n = F.greatest(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(EPS))
        return [c / n for c in v]

    a = unit(r[:3])
    along = a[0] * r[3] + a[1] * r[4] + a[2] * r[5]
    b = unit([r[3 + k] - along * a[k] for k in range(3)])
    # Of unit length already, or zero where a or b is.
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return [*a, *b, *c] if by == "rows" else transpose([*a, *b, *c])


def euler_to_r6(e: Columns, by: str = "rows") -> list[Column]:
    return matrix_to_r6(euler_to_matrix(e), by)


def r6_to_euler(r: Columns, by: str = "rows") -> list[Column]:
    return matrix_to_euler(r6_to_matrix(r, by))


def change_axes(move: Columns, axes: Columns) -> list[Column]:
    """A move (x, y, z, roll, pitch, yaw) in other axes: C t, and C R C^T."""
    turned = matmul(matmul(axes, euler_to_matrix(move[3:6])), transpose(axes))
    return [*apply(axes, move[:3]), *matrix_to_euler(turned)]


def relative_euler(after: Columns, before: Columns) -> list[Column]:
    """The turn that leads from one attitude to another, in the first one's frame."""
    return matrix_to_euler(matmul(transpose(euler_to_matrix(before)), euler_to_matrix(after)))


def zxy_to_euler(a: Columns) -> list[Column]:
    """From intrinsic z, x, y angles."""
    return matrix_to_euler(matmul(matmul(about_axis(2, a[0]), about_axis(0, a[1])), about_axis(1, a[2])))


def axis_angle_to_matrix(v: Columns) -> list[Column]:
    """Rodrigues: the rotation about v by its length; none for a length under the floor."""
    angle = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    some = angle >= EPS
    x, y, z = (F.when(some, c / F.when(some, angle).otherwise(1.0)).otherwise(F.lit(float(k == 0))) for k, c in enumerate(v))
    c, s = F.cos(angle), F.sin(angle)
    d = 1 - c
    return [
        c + x * x * d, x * y * d - z * s, x * z * d + y * s,
        y * x * d + z * s, c + y * y * d, y * z * d - x * s,
        z * x * d - y * s, z * y * d + x * s, c + z * z * d,
    ]


def axis_angle_to_euler(v: Columns) -> list[Column]:
    m = axis_angle_to_matrix(v)
    return [F.atan2(m[7], m[8]), F.asin(F.least(F.greatest(-m[6], F.lit(-1.0)), F.lit(1.0))), F.atan2(m[3], m[0])]


def axis_angle_to_r6(v: Columns) -> list[Column]:
    return matrix_to_r6(axis_angle_to_matrix(v))


def wxyz_to_r6(q: Columns) -> list[Column]:
    return matrix_to_r6(quaternion_to_matrix([*q[1:4], q[0]]))


def matrix_to_axis_angle(m: Columns) -> list[Column]:
    """The rotation vector of a matrix, away from half turns."""
    cosine = F.least(F.greatest((m[0] + m[4] + m[8] - 1) / 2, F.lit(-1.0)), F.lit(1.0))
    angle = F.acos(cosine)
    factor = F.when(angle < 1e-8, F.lit(0.5)).otherwise(angle / (2 * F.sin(F.when(angle < 1e-8, F.lit(1.0)).otherwise(angle))))
    return [factor * (m[7] - m[5]), factor * (m[2] - m[6]), factor * (m[3] - m[1])]


def axis_class(v: Columns, cosine: float = 0.92) -> Column:
    """roll, pitch or yaw if a rotation vector lies within ``cosine`` of that axis, else mixed; none without a rotation."""
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    near = lambda c: F.abs(c) >= cosine * n
    return F.when(n < 1e-9, "none").when(near(v[0]), "roll").when(near(v[1]), "pitch").when(near(v[2]), "yaw").otherwise("mixed")


def pose_matrix_to_euler(column_major: Column) -> list[Column]:
    """x, y, z, roll, pitch, yaw of a 4x4 pose matrix that is stored by columns."""
    m = unpack(column_major, 0, 16)
    rotation = [m[4 * j + i] for i in range(3) for j in range(3)]
    return [m[12], m[13], m[14], *matrix_to_euler(rotation)]


def to_tool_frame(move: Columns, attitude: Columns) -> list[Column]:
    """A move given in the base frame, in the frame of a tool with the given Euler attitude."""
    inverse = transpose(euler_to_matrix(attitude))
    turn = matmul(matmul(inverse, euler_to_matrix(move[3:6])), transpose(inverse))
    return [*apply(inverse, move[:3]), *matrix_to_euler(turn)]


def to_base_frame(move: Columns, attitude: Columns) -> list[Column]:
    """The inverse of ``to_tool_frame``."""
    m = euler_to_matrix(attitude)
    turn = matmul(matmul(m, euler_to_matrix(move[3:6])), transpose(m))
    return [*apply(m, move[:3]), *matrix_to_euler(turn)]


def project(point: Columns, camera: Columns, attitude: Columns, focal: float, centre: tuple[float, float], flip_y: bool = False) -> list[Column]:
    """Pixel and depth of a point seen by a pinhole camera at a position and attitude; null pixels behind the camera."""
    seen = apply(transpose(euler_to_matrix(attitude)), [point[k] - camera[k] for k in range(3)])
    depth = F.when(seen[2] > 1e-9, seen[2])
    sign = -1.0 if flip_y else 1.0
    return [centre[0] + focal * seen[0] / depth, centre[1] + sign * focal * seen[1] / depth, seen[2]]


def as_array(values: Columns, digits: int | None = None) -> Column:
    """One array of doubles; with ``digits``, rounded and without negative zeros."""
    return F.array(*[v if digits is None else F.round(v, digits) + F.lit(0.0) for v in values])
