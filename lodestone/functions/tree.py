"""Arithmetic of implicit trees: node ids of complete k-ary trees, quadtrees and Morton codes. Integers only, no logarithms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of_depth(depth: int, fan: int) -> int:
    return depth if fan == 1 else (fan**depth - 1) // (fan - 1)


def length_of_depth(depth: int, fan: int) -> int:
    return fan**depth


def child(node: Column, k: Column | int, fan: int) -> Column:
    return node * fan + 1 + k


def parent(node: Column, fan: int) -> Column:
    """Null for the root."""
    return F.when(node > 0, F.floor((node - 1) / fan).cast("long"))


def depth_of(node: Column, fan: int, deepest: int = 20) -> Column:
    out = F.lit(None).cast("int")
    for d in range(deepest, -1, -1):
        if first_of_depth(d, fan) < 2**62:
            out = F.when(node < first_of_depth(d + 1, fan), d).otherwise(out) if first_of_depth(d + 1, fan) < 2**62 else F.lit(d)
    return out


def ancestors(node: Column, fan: int, deepest: int) -> Column:
    """Array of the proper ancestors, nearest first; a fixed number of steps, as the depth is bounded."""
    steps = F.sequence(F.lit(1), F.lit(max(deepest, 1)))
    up = F.aggregate(
        steps, F.array(node.cast("long")),
        lambda acc, _: F.when(F.element_at(acc, -1) > 0, F.concat(acc, F.array(F.floor((F.element_at(acc, -1) - 1) / fan).cast("long")))).otherwise(acc),
    )
    return F.slice(up, 2, deepest + 1)


def descendants_range(node: Column, depth: int, to_depth: int, fan: int) -> tuple[Column, Column]:
    """First and last id at a depth below a node of a known depth."""
    steps = to_depth - depth
    first = node * fan**steps + first_of_depth(steps, fan)
    return first, first + fan**steps - 1


def _spread(v: Column) -> Column:
    """Put a zero between the bits of a 16-bit number."""
    x = v.cast("long").bitwiseAND(F.lit(0xFFFF))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(v: Column) -> Column:
    x = v.cast("long").bitwiseAND(F.lit(0x55555555))
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x: Column, y: Column) -> Column:
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def morton_decoded(code: Column) -> tuple[Column, Column]:
    return _gather(code), _gather(F.shiftright(code.cast("long"), 1))


def quad_id(level: int, x: Column, y: Column) -> Column:
    return morton(x, y) + first_of_depth(level, 4)


def quad_decoded(node: Column, level: int) -> tuple[Column, Column]:
    return morton_decoded(node - first_of_depth(level, 4))


def quad_neighbor(node: Column, level: int, dx: int, dy: int) -> Column:
    """The neighbouring tile, the border tile itself at the border."""
    x, y = quad_decoded(node, level)
    top = F.lit(2**level - 1)
    move = lambda v, d: F.greatest(F.lit(0), F.least(top, v + d))
    return quad_id(level, move(x, dx), move(y, dy))
