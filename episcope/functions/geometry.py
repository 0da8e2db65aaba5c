"""Quaternions, rotations and rigid poses as plain columns.

A quaternion is a list of four double columns; ``order`` says whether it is ``wxyz`` or ``xyzw``.
Functions that need unit quaternions say so: normalise once with ``with_unit`` and keep the result
as columns, so that later expressions stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions.columns import clip, finite

Quat = Sequence[Column]
Vec = Sequence[Column]

ORDERS = ("wxyz", "xyzw")
NORM_TOLERANCE = 1e-6
ANGLE_TOLERANCE_RAD = 1e-6
ANGLE_TOLERANCE_DEG = 1e-6
DISPLACEMENT_TOLERANCE = 1e-9


def _check(order: str) -> None:
    if order not in ORDERS:
        raise ValueError(f"unknown quaternion order {order!r}")


def dot(a: Vec, b: Vec) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def norm(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(q: Quat) -> list[Column]:
    """Divide by the norm; a zero norm gives null."""
    n = F.nullif(norm(q), F.lit(0.0))
    return [c / n for c in q]


def with_unit(df: DataFrame, name: str, q: Quat) -> DataFrame:
    """Add columns ``<name>0 .. <name>3`` with the normalised components, NaN for a zero norm.

    They are never null, which keeps the generated code of later arithmetic short.
    """
    staged = df.withColumns({f"{name}{i}": c for i, c in enumerate(q)})
    parts = [F.col(f"{name}{i}") for i in range(4)]
    sized = staged.withColumn("_norm", F.nullif(norm(parts), F.lit(0.0)))
    nan = F.lit(float("nan"))
    return sized.withColumns(
        {f"{name}{i}": F.coalesce(c / F.col("_norm"), nan) for i, c in enumerate(parts)}
    ).drop("_norm")


def to_wxyz(q: Quat, order: str) -> list[Column]:
    _check(order)
    return list(q) if order == "wxyz" else [q[3], q[0], q[1], q[2]]


def reorder(q: Quat, order: str, target: str) -> list[Column]:
    """Normalised components in the target order."""
    _check(target)
    w, x, y, z = to_wxyz(unit(q), order)
    return [w, x, y, z] if target == "wxyz" else [x, y, z, w]


def quaternion_valid(q: Column) -> Column:
    """Array of four finite numbers in [-1, 1] with unit norm."""
    four = F.size(q) == 4
    in_range = F.forall(q, lambda x: finite(x) & (x >= -1.0) & (x <= 1.0))
    length = F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(four & in_range & (F.abs(length - 1.0) <= NORM_TOLERANCE), F.lit(False))


def geodesic_acos(a: Quat, b: Quat) -> Column:
    """Angle in radians from the clamped dot product of two unit quaternions in one order."""
    return 2.0 * F.acos(clip(F.abs(dot(a, b)), 0.0, 1.0))


def geodesic_atan2(a: Quat, a_order: str, b: Quat, b_order: str) -> Column:
    """Angle in radians between unit quaternions from the relative quaternion; accurate near zero,
    blind to the sign."""
    p, q = to_wxyz(a, a_order), to_wxyz(b, b_order)
    real = dot(p, q)
    turn = cross(p[1:], q[1:])
    imag = [p[0] * q[i + 1] - q[0] * p[i + 1] - turn[i] for i in range(3)]
    return 2.0 * F.atan2(norm(imag), F.abs(real))


def rotation_matrix(q: Quat, order: str) -> list[list[Column]]:
    """Rows of the rotation matrix of a unit quaternion."""
    w, x, y, z = to_wxyz(q, order)
    two = F.lit(2.0)
    one = F.lit(1.0)
    return [
        [one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w)],
        [two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w)],
        [two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y)],
    ]


def geodesic_trace(a: Quat, a_order: str, b: Quat, b_order: str) -> Column:
    """Angle in radians between unit quaternions from the trace; has a floor near zero."""
    ra, rb = rotation_matrix(a, a_order), rotation_matrix(b, b_order)
    trace = None
    for i in range(3):
        for j in range(3):
            term = ra[j][i] * rb[j][i]
            trace = term if trace is None else trace + term
    return F.acos(clip((trace - 1.0) / 2.0, -1.0, 1.0))


def max_basis_displacement(a: Quat, a_order: str, b: Quat, b_order: str) -> Column:
    """The farthest any basis vector ends from where the other rotation puts it."""
    ra, rb = rotation_matrix(a, a_order), rotation_matrix(b, b_order)
    return F.greatest(*[norm([ra[r][c] - rb[r][c] for r in range(3)]) for c in range(3)])


def orientation_issues(
    source: Quat, source_order: str, target: Quat, target_order: str, declared: Column,
    tolerance: float = ANGLE_TOLERANCE_RAD,
) -> Column:
    """List of issues of a transfer of unit quaternions; ``declared``: a reorder was declared."""
    angle = geodesic_acos(to_wxyz(source, source_order), to_wxyz(target, target_order))
    undeclared = F.lit(source_order != target_order) & ~declared
    undecoded = angle.isNull() | F.isnan(angle)
    return F.array_compact(
        F.array(
            F.when(undeclared, "order change is not declared"),
            F.when(~undecoded & (angle > tolerance), "orientations differ"),
            F.when(undecoded, "orientation cannot be decoded"),
        )
    )


def quaternion_product(a: Quat, b: Quat) -> list[Column]:
    """Hamilton product of two wxyz quaternions."""
    turn = cross(a[1:], b[1:])
    return [
        a[0] * b[0] - dot(a[1:], b[1:]),
        *[a[0] * b[i] + b[0] * a[i] + turn[i - 1] for i in (1, 2, 3)],
    ]


def axis_angle(axis: Vec, angle: Column) -> list[Column]:
    """Unit quaternion (wxyz) of a turn about an axis."""
    direction = unit(axis)
    s = F.sin(angle / 2)
    return [F.cos(angle / 2), *[c * s for c in direction]]


def rotate(matrix: Sequence[Sequence[Column]], v: Vec) -> list[Column]:
    return [dot(row, v) for row in matrix]


def transpose(matrix: Sequence[Sequence[Column]]) -> list[list[Column]]:
    return [[matrix[r][c] for r in range(3)] for c in range(3)]


def rotate_displacement(matrix, v: Vec) -> list[Column]:
    """A displacement is turned into the world frame; the frame's origin plays no part."""
    return rotate(matrix, v)


def rotate_displacement_as_point(matrix, origin: Vec, v: Vec) -> list[Column]:
    """The known fault: treats a displacement like a point and adds the origin."""
    return [o + c for o, c in zip(origin, rotate(matrix, v))]


def displacement_ok(matrix, v: Vec, observed: Vec, tolerance: float = DISPLACEMENT_TOLERANCE) -> Column:
    expected = rotate(matrix, v)
    return norm([o - e for o, e in zip(observed, expected)]) <= tolerance


def displacement_issues(matrix, origin: Vec, v: Vec, observed: Vec,
                        tolerance: float = DISPLACEMENT_TOLERANCE) -> Column:
    """List of issues: leak of translation, changed length, error equal to the origin."""
    expected = rotate(matrix, v)
    error = [o - e for o, e in zip(observed, expected)]
    # Same bound as an elementwise comparison with absolute and default relative tolerance.
    like_origin = norm(origin) > tolerance
    for e, o in zip(error, origin):
        like_origin = like_origin & (F.abs(e - o) <= tolerance + 1e-5 * F.abs(o))
    return F.array_compact(
        F.array(
            F.when(norm(error) > tolerance, "translation leak"),
            F.when(F.abs(norm(expected) - norm(v)) > tolerance, "length not preserved"),
            F.when(like_origin, "error equals the origin"),
        )
    )


def pose_to_world(base_position: Vec, base_q: Quat, position: Vec, q: Quat) -> tuple[list[Column], list[Column]]:
    """World pose of a pose given in the base frame (unit quaternions, wxyz)."""
    turned = rotate(rotation_matrix(base_q, "wxyz"), position)
    return [b + t for b, t in zip(base_position, turned)], quaternion_product(base_q, q)


def pose_in_base(base_position: Vec, base_q: Quat, position: Vec, q: Quat) -> tuple[list[Column], list[Column]]:
    """The inverse: a world pose seen from the base frame."""
    offset = [p - b for p, b in zip(position, base_position)]
    back = rotate(transpose(rotation_matrix(base_q, "wxyz")), offset)
    w, x, y, z = base_q
    return back, quaternion_product([w, -x, -y, -z], q)


def relative_position(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def convert_pose_array(pose: Column) -> Column:
    """Rewrite the quaternion part of ``[x, y, z, w, qx, qy, qz]`` from wxyz to xyzw."""
    return F.concat(F.slice(pose, 1, 3), F.slice(pose, 5, 3), F.slice(pose, 4, 1))


def base_pose_from_xml(xml: Column, body: str) -> tuple[Column, Column]:
    """Position and quaternion arrays of a named body in a model XML, with identity defaults."""

    def numbers(attribute: str, default: str) -> Column:
        found = F.xpath_string(xml, F.lit(f"//body[@name='{body}']/@{attribute}"))
        text = F.when(F.length(F.trim(found)) > 0, F.trim(found)).otherwise(F.lit(default))
        return F.transform(F.split(text, r"\s+"), lambda s: s.cast("double"))

    return numbers("pos", "0 0 0"), numbers("quat", "1 0 0 0")
