"""Boxes, spheres, planes, disks and frames as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Vec, b: Vec) -> Column:
    return dot(sub(a, b), sub(a, b))


def every(*terms: Column) -> Column:
    return reduce(lambda p, q: p & q, terms)


def finite(*cols: Column) -> Column:
    """Neither null nor NaN nor infinite (NaN equals NaN in Spark, so it is asked for by name)."""
    return every(*(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in cols))


def box_contains_point(low: Vec, high: Vec, p: Vec, closed: bool = True) -> Column:
    """Closed on both ends, or half-open (low end in, high end out)."""
    return every(*((c >= a) & ((c <= b) if closed else (c < b)) for a, b, c in zip(low, high, p, strict=True)))


def box_contains_box(low: Vec, high: Vec, low2: Vec, high2: Vec) -> Column:
    return box_contains_point(low, high, low2) & box_contains_point(low, high, high2)


def box_contains_sphere(low: Vec, high: Vec, c: Vec, r: Column) -> Column:
    """By the sphere's box."""
    return box_contains_box(low, high, tuple(x - r for x in c), tuple(x + r for x in c))


def boxes_intersect(low: Vec, high: Vec, low2: Vec, high2: Vec) -> Column:
    return every(*((a <= d) & (b >= c) for a, b, c, d in zip(low, high, low2, high2, strict=True)))


def sphere_intersects_box(c: Vec, r: Column, low: Vec, high: Vec) -> Column:
    """By the box's point next to the centre."""
    near = tuple(F.greatest(a, F.least(b, x)) for a, b, x in zip(low, high, c, strict=True))
    return distance2(c, near) <= r * r


def sphere_contains_point(c: Vec, r: Column, p: Vec) -> Column:
    return distance2(c, p) <= r * r


def plane_distance(p: Vec, origin: Vec, normal: Vec) -> Column:
    """Unsigned distance of a point to a plane."""
    return F.abs(dot(sub(p, origin), normal)) / length(normal)


def plane_basis(normal: Vec) -> tuple[Vec, Vec]:
    """Right and up vectors of a plane; the axis that the normal has least of starts them."""
    n = length(normal)
    u = tuple(c / n for c in normal)
    lean_x = (F.abs(u[0]) <= F.abs(u[1])) & (F.abs(u[0]) <= F.abs(u[2]))
    lean_y = F.abs(u[1]) <= F.abs(u[2])
    one, zero = F.lit(1.0), F.lit(0.0)
    pick = (F.when(lean_x, one).otherwise(zero), F.when(~lean_x & lean_y, one).otherwise(zero), F.when(~lean_x & ~lean_y, one).otherwise(zero))
    right = cross(pick, u)
    size = length(right)
    right = tuple(c / size for c in right)
    return right, cross(u, right)


def project_to_plane(p: Vec, origin: Vec, normal: Vec) -> tuple[Column, Column]:
    """Plane coordinates of a point along the basis."""
    right, up = plane_basis(normal)
    d = sub(p, origin)
    return dot(d, right), dot(d, up)


def disk_box(center: Vec, normal: Vec, radius: Column) -> tuple[Vec, Vec]:
    """Box of a disk with a unit normal, whose half extent on an axis is |r - r n²|."""
    half = tuple(F.abs(radius - radius * n * n) for n in normal)
    return tuple(c - h for c, h in zip(center, half, strict=True)), tuple(c + h for c, h in zip(center, half, strict=True))


#: Fixed value: how far the normals are turned before planes meet, the first along x and the second along z.
TURN = 0.001


def turned(n: Vec, axis: int) -> Vec:
    """A normal with TURN added on an axis, of unit length again."""
    moved = tuple(c + TURN if i == axis else c for i, c in enumerate(n))
    size = F.sqrt(dot(moved, moved))
    return tuple(c / size for c in moved)


def disks_overlap(p1: Vec, n1: Vec, r1: Column, p2: Vec, n2: Vec, r2: Column, eps: float = 1e-18) -> Column:
    """Do two disks come close enough to overlap?

    The centres must be no further apart than the radii together. Then the line
    in which the planes meet must pass within both radii. The planes are turned a
    little, each its own way, so that disks on nearly one plane meet in a line
    close by; if they still are parallel they overlap only as one plane.
    """
    n1, n2 = turned(n1, 0), turned(n2, 2)
    d = cross(n1, n2)
    d2 = dot(d, d)
    near = distance2(p1, p2) <= (r1 + r2) * (r1 + r2)
    flat = dot(sub(p2, p1), n1) == 0
    # The point of the line next to the first centre, from where the plane of the second is h away.
    h = dot(sub(p2, p1), n2)
    a = cross(d, n1)
    q = tuple(h * s / F.when(d2 > eps, d2) for s in a)

    def from_line(w: Vec) -> Column:
        along = dot(w, d)
        return dot(w, w) - along * along / F.when(d2 > eps, d2)

    crossing = (dot(q, q) <= r1 * r1) & (from_line(sub(sub(p2, p1), q)) <= r2 * r2)
    return near & F.when(d2 <= eps, flat).otherwise(F.coalesce(crossing, F.lit(False)))


def affine(m: list[list[float]], p: Vec, w: float = 1.0) -> Vec:
    """A 3 by 4 matrix applied to (p, w); the matrix folds into three linear expressions."""
    return tuple(F.lit(float(r[0])) * p[0] + F.lit(float(r[1])) * p[1] + F.lit(float(r[2])) * p[2] + F.lit(float(r[3]) * w) for r in m)


def affine_box(m: list[list[float]], low: Vec, high: Vec) -> tuple[Vec, Vec]:
    """Box of the eight transformed corners."""
    corners = [affine(m, tuple(high[k] if i >> k & 1 else low[k] for k in range(3))) for i in range(8)]
    return tuple(F.least(*(c[k] for c in corners)) for k in range(3)), tuple(F.greatest(*(c[k] for c in corners)) for k in range(3))


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def in_frustum(low: Vec, high: Vec, planes: list[tuple[float, float, float, float]]) -> Column:
    """A box meets the frustum unless it lies behind one of the planes (a, b, c, d; inside where ax + by + cz + d >= 0)."""
    tests = []
    for a, b, c, d in planes:
        far = tuple(high[k] if w >= 0 else low[k] for k, w in enumerate((a, b, c)))
        tests.append(a * far[0] + b * far[1] + c * far[2] + d >= 0)
    return every(*tests)


def node_error(radius: Column, z_eye: Column, near: float, height: float, depth: Column, min_depth: int) -> Column:
    """Projected size in pixels of a representative radius; nodes above the minimal depth always split."""
    return F.when(depth < min_depth, F.lit(100.0)).otherwise(F.abs(2.0 * radius * near / -z_eye * height))


def ray_box(origin: Vec, direction: Vec, low: Vec, high: Vec) -> tuple[Column, Column]:
    """Entry and exit parameters of a ray through a box; there is a hit if entry <= exit and exit >= 0."""
    enter, leave = [], []
    for o, d, a, b in zip(origin, direction, low, high, strict=True):
        safe = F.when(F.abs(d) < 1e-12, F.lit(1e-12)).otherwise(d)
        t1, t2 = (a - o) / safe, (b - o) / safe
        enter.append(F.least(t1, t2))
        leave.append(F.greatest(t1, t2))
    return F.greatest(*enter), F.least(*leave)


def ray_disk(origin: Vec, direction: Vec, center: Vec, normal: Vec) -> tuple[Column, Column]:
    """Parameter at which a ray meets a disk's plane, and the distance of that point from the centre; null if parallel."""
    along = dot(direction, normal)
    t = dot(sub(center, origin), normal) / F.when(F.abs(along) > 1e-12, along)
    hit = tuple(o + t * d for o, d in zip(origin, direction, strict=True))
    return t, F.sqrt(distance2(hit, center))
