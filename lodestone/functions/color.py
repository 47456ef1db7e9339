"""Colour spaces, pixel formats and quantisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB to XYZ matrix and the D65 white point.
RGB_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (95.047, 100.0, 108.883)


def linear(c: Column) -> Column:
    """An 8-bit sRGB channel as linear light, 0 to 100."""
    v = c / 255.0
    return 100.0 * F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rgb = linear(r), linear(g), linear(b)
    return tuple(m[0] * rgb[0] + m[1] * rgb[1] + m[2] * rgb[2] for m in RGB_XYZ)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB by the standard formula, L at least 0."""

    def f(t: Column) -> Column:
        return F.when(t > 216.0 / 24389.0, F.pow(t, F.lit(1.0 / 3.0))).otherwise((841.0 / 108.0) * t + 4.0 / 29.0)

    x, y, z = (f(c / w) for c, w in zip(xyz(r, g, b), WHITE, strict=True))
    return F.greatest(F.lit(0.0), 116.0 * y - 16.0), 500.0 * (x - y), 200.0 * (y - z)


def delta_e(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    return F.sqrt(sum((a - b) * (a - b) for a, b in zip(p, q, strict=True)))


def normal_rgb(n: Column) -> Column:
    """A normal component as a channel, truncated."""
    return (255 * (n * 0.5 + 0.5)).cast("int")


def to_grey(r: Column, g: Column, b: Column) -> Column:
    """One channel from three: the integer mean."""
    return F.floor((r + g + b) / 3).cast("int")


def quantize_position(v: Column, low: Column, high: Column) -> Column:
    """A coordinate as 16 bits within its node's box; a flat box gives 0."""
    at = F.when(high > low, (v - low) / (high - low)).otherwise(0.0)
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.round(at * 65535).cast("long"))).cast("int")


def quantize_radius(radius: Column, mean: Column, deviation: Column) -> Column:
    """A radius as 11 bits around the node's mean: 2047 marks none, 1023 a node without deviation."""
    at = F.when(deviation > 0, (radius - (mean - deviation)) / (2.0 * deviation)).otherwise(0.0)
    inside = F.greatest(F.lit(0), F.least(F.lit(2046), F.round(at * 2046).cast("long")))
    return F.when(radius == 0, 2047).when(deviation == 0, 1023).otherwise(inside).cast("int")


def quantize_channel(c: Column) -> Column:
    """A channel as 7 bits."""
    return F.least(F.lit(127), F.round(c / 2.0).cast("long")).cast("int")


def pack_color(r: Column, g: Column, b: Column, radius: Column) -> Column:
    """7-7-7 colour above an 11-bit radius."""
    return F.shiftleft(r.cast("long"), 25) + F.shiftleft(g.cast("long"), 18) + F.shiftleft(b.cast("long"), 11) + radius


#: Steps along and across a cube face: six faces of 104 by 105 directions fill 16 bits.
FACE_U, FACE_V = 104, 105


def quantize_normal(nx: Column, ny: Column, nz: Column) -> Column:
    """A normal as a place on the face of the cube that it points to."""
    ax, ay, az = F.abs(nx), F.abs(ny), F.abs(nz)
    on_x, on_y = (ax >= ay) & (ax >= az), ay >= az
    main = F.when(on_x, nx).when(on_y, ny).otherwise(nz)
    face = F.when(on_x, 0).when(on_y, 1).otherwise(2) * 2 + F.when(main > 0, 1).otherwise(0)
    size = F.when(main != 0, F.abs(main))
    u, v = F.when(on_x, ny).otherwise(nx) / size, F.when(on_x | on_y, nz).otherwise(ny) / size
    iu = F.round((u + 1.0) / 2.0 * (FACE_U - 1)).cast("long")
    iv = F.round((v + 1.0) / 2.0 * (FACE_V - 1)).cast("long")
    return F.when(main == 0, 0).otherwise(face * (FACE_U * FACE_V) + iv * FACE_U + iu).cast("int")


def hemi_oct(nx: Column, ny: Column, nz: Column) -> tuple[Column, Column]:
    """Upper half-sphere directions on a rotated square, -1 to 1."""
    size = F.abs(nx) + F.abs(ny) + F.abs(nz)
    return nx / size + ny / size, nx / size - ny / size


def hemi_oct_decoded(u: Column, v: Column) -> tuple[Column, Column, Column]:
    x, y = (u + v) / 2.0, (u - v) / 2.0
    z = 1.0 - F.abs(x) - F.abs(y)
    size = F.sqrt(x * x + y * y + z * z)
    return x / size, y / size, z / size
