"""Nearest neighbours and spatial joins as equi-joins on grid cells.

A grid join first meets on cell ids and then applies the exact predicate, so
Spark sees an equi-join. Neighbours come from the blocks of a kd-tree (see
``nearest``), so neither dense points nor far queries make large groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geometry as geo
from lodestone.model import cut
from lodestone.operators.nearest import nearest


def _cells(size: float, spread: bool) -> Column:
    at = [F.floor(F.col(c) / size).cast("long") for c in geo.AXES]
    if not spread:
        return F.struct(*(a.alias(n) for a, n in zip(at, ("i", "j", "k"), strict=True)))
    offsets = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return F.explode(F.array(*(F.struct((at[0] + i).alias("i"), (at[1] + j).alias("j"), (at[2] + k).alias("k")) for i, j, k in offsets)))


def extent(df: DataFrame) -> tuple[float, int]:
    """Longest side of the box and the number of rows."""
    row = df.agg(*(F.max(c) - F.min(c) for c in geo.AXES), F.count("*")).first()
    return max((v or 0.0) for v in row[:3]), row[3]


def cell_size(points: DataFrame, per_cell: float, halvings: int = 40) -> float:
    """The least of a series of halved cell sizes at which occupied cells hold ``per_cell`` points on average; 0 without an extent.

    One pass: distinct cells of all sizes are counted approximately, a row a size from each task.
    """
    side, n = extent(points)
    if not n or side <= 0:
        return 0.0
    sizes = F.explode(F.array(*(F.lit(side / 2.0**h) for h in range(halvings + 1)))).alias("size")
    cell = F.xxhash64(*(F.floor(F.col(c) / F.col("size")).cast("long") for c in geo.AXES))
    counted = points.select(*geo.AXES, sizes).groupBy("size").agg(F.approx_count_distinct(cell, 0.05).alias("cells"))
    return counted.where(F.col("cells") * per_cell <= n).agg(F.min("size")).first()[0] or side


def knn(queries: DataFrame, points: DataFrame, k: int, same: bool = False) -> DataFrame:
    """pid, neighbor, d2 and rank: the k nearest points of each query, ties to the smaller pid.

    Both inputs have pid, x, y, z. With ``same`` the point of a query's own pid
    is left out. Rows without a finite position take no part.
    """
    q, p = (df.where(geo.finite(*geo.vec(*geo.AXES))).select(F.col("pid").cast("long").alias("id"), F.lit(0).cast("long").alias("_group"), *(F.col(c).cast("double").alias(c) for c in geo.AXES)) for df in (queries, points))
    own, other = (dict(df.dtypes)["pid"] for df in (queries, points))
    return nearest(q, p, k, same).select(F.col("id").cast(own).alias("pid"), F.col("neighbor").cast(other).alias("neighbor"), "d2", "rank")


def knn_in_group(points: DataFrame, group: str, k: int) -> DataFrame:
    """Neighbours within the same node or sibling set, of any size; rows without a group or a finite position take no part."""
    kind, own = (dict(points.dtypes)[c] for c in (group, "pid"))
    p = points.where(F.col(group).isNotNull() & geo.finite(*geo.vec(*geo.AXES)))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        p = p.withColumn("_group", F.col(group).cast("long"))
    else:
        names = cut(p.select(group).distinct().withColumn("_group", F.monotonically_increasing_id()), "groups")
        p = p.join(names, group)
    p = p.select(F.col("pid").cast("long").alias("id"), "_group", *(F.col(c).cast("double").alias(c) for c in geo.AXES))
    found = nearest(p, p, k, same=True)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        found = found.withColumn(group, F.col("_group").cast(kind))
    else:
        found = found.join(names, "_group")
    return found.select(group, F.col("id").cast(own).alias("pid"), F.col("neighbor").cast(own).alias("neighbor"), "d2", "rank")


def overlapping(points: DataFrame, max_radius: float) -> DataFrame:
    """Pairs of overlapping disks (pid < other): cells of twice the largest radius, 27 around each, then the exact test."""
    size = 2.0 * max_radius
    names = ("x", "y", "z", "nx", "ny", "nz", "radius")
    a = points.select("pid", *names, _cells(size, True).alias("cell"))
    b = points.select(F.col("pid").alias("other"), *(F.col(c).alias(f"o_{c}") for c in names), _cells(size, False).alias("cell"))
    test = geo.disks_overlap(
        geo.vec("x", "y", "z"), geo.vec("nx", "ny", "nz"), F.col("radius"), geo.vec("o_x", "o_y", "o_z"), geo.vec("o_nx", "o_ny", "o_nz"), F.col("o_radius")
    )
    return a.join(b.hint("merge"), "cell").where((F.col("pid") < F.col("other")) & test).select("pid", "other")


CORNERS = [f"{m}_{c}" for m in ("min", "max") for c in geo.AXES]


def _classed(boxes: DataFrame, name: str) -> tuple[DataFrame, list[int]]:
    """``name``: the power of two that the box's longest edge is below; and the list of those that occur, a few numbers."""
    edge = F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in geo.AXES), F.lit(1e-6)) * (1 + 1e-9)
    at = boxes.where(geo.finite(*(F.col(c) for c in CORNERS))).withColumn(name, F.ceil(F.log2(edge)).cast("int"))
    return at, sorted(r[0] for r in at.select(name).distinct().collect())


def _met_boxes(one: DataFrame, two: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both inputs with the cells on which intersecting boxes meet exactly once, and the names of those.

    A box of ``two`` lies in the cell of its low corner only, and one of ``one`` in the few
    cells where the low corner of a box that meets it can lie; cells are as long
    as the longer of the two edges, rounded up to a power of two.
    """
    a, of_a = _classed(one, "_ca")
    b, of_b = _classed(two, "_cb")
    listed = lambda found: F.explode(F.array(*(F.lit(c) for c in found)) if found else F.array().cast("array<int>"))
    size = F.pow(F.lit(2.0), F.greatest("_ca", "_cb"))
    b = b.withColumn("_ca", listed(of_a)).withColumns({f"_{c}": F.floor(F.col(f"min_{c}") / size).cast("long") for c in geo.AXES})
    a = a.withColumn("_cb", listed(of_b))
    for c in geo.AXES:
        low = F.col(f"min_{c}") - F.pow(F.lit(2.0), F.col("_cb")) * (1 + 1e-9) - F.abs(f"min_{c}") * 1e-15
        high = F.greatest(low, F.col(f"max_{c}"))
        a = a.withColumn(f"_{c}", F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))
    keys = ["_ca", "_cb", *(f"_{c}" for c in geo.AXES)]
    return a.select(*keys, *names), b.select(*keys, "id", *CORNERS), keys


def boxes_joined(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs (a, b) of intersecting boxes; each meets in one cell only, so it comes once without a distinct."""
    a, b, keys = _met_boxes(one, two, ["id", *CORNERS])
    a, b = a.withColumnRenamed("id", "a"), b.withColumnsRenamed({c: f"o_{c}" for c in CORNERS} | {"id": "b"})
    low, high = [f"min_{c}" for c in geo.AXES], [f"max_{c}" for c in geo.AXES]
    meets = geo.boxes_intersect(geo.vec(*low), geo.vec(*high), geo.vec(*(f"o_{c}" for c in low)), geo.vec(*(f"o_{c}" for c in high)))
    return a.join(b.hint("merge"), keys).where(meets).select("a", "b")


def in_boxes(points: DataFrame, boxes: DataFrame, closed: bool = True, how: str = "inner") -> DataFrame:
    """(pid, id) of points in boxes: points and the cells of the boxes meet on the cell. A left_semi join gives the pid only, and stops at the first box."""
    at = points.select("pid", *geo.AXES, *(F.col(c).alias(f"{m}_{c}") for m in ("min", "max") for c in geo.AXES))
    p, b, keys = _met_boxes(at, boxes, ["pid", *geo.AXES])
    b = b.withColumnsRenamed({k: f"_o{k}" for k in keys})
    test = geo.box_contains_point(geo.vec(*CORNERS[:3]), geo.vec(*CORNERS[3:]), geo.vec("x", "y", "z"), closed)
    same = geo.every(*(F.col(k) == F.col(f"_o{k}") for k in keys))
    return p.join(b.hint("merge"), same & test, how).select("pid", *(["id"] if how == "inner" else []))


def spatial_anti_join(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with the radius of those in any box set to 0."""
    hit = in_boxes(points, boxes, how="left_semi").select("pid").distinct().withColumn("_hit", F.lit(True))
    return points.join(hit, "pid", "left").withColumn("radius", F.when(F.col("_hit"), 0.0).otherwise(F.col("radius"))).drop("_hit")


def transfer(queries: DataFrame, points: DataFrame, attributes: list[str]) -> DataFrame:
    """Attributes of the nearest point."""
    near = knn(queries, points, 1).select("pid", "neighbor")
    return near.join(points.select(F.col("pid").alias("neighbor"), *attributes).hint("merge"), "neighbor").select("pid", "neighbor", *attributes)


def transfer_by_depth(queries: DataFrame, points: DataFrame, max_depth: int, least_red: int = 216) -> DataFrame:
    """Mean of the red channel over 255 of the nearest max_depth + 1 - depth points, of those with enough red; 0 if none."""
    near = knn(queries, points, max_depth + 1).join(queries.select("pid", "depth").hint("merge"), "pid")
    near = near.where(F.col("rank") <= max_depth + 1 - F.col("depth")).join(points.select(F.col("pid").alias("neighbor"), "r").hint("merge"), "neighbor")
    return near.groupBy("pid").agg((F.coalesce(F.avg(F.when(F.col("r") >= least_red, F.col("r"))), F.lit(0.0)) / 255).alias("value"))


def outliers(points: DataFrame, k: int, n: int) -> DataFrame:
    """The n points with the largest mean squared distance to their k neighbours; sums are decimal, so that their order does not matter."""
    total = F.sum(F.col("d2").cast("decimal(28,9)")).cast("double")
    mean = knn(points, points, k, same=True).groupBy("pid").agg((total / F.count("*")).alias("mean_d2"))
    return mean.orderBy(F.col("mean_d2").desc(), "pid").limit(n)


def rays_hit(rays: DataFrame, disks: DataFrame, cap: float = 6.0) -> DataFrame:
    """The best disk of each ray by error 0.01 * distance + offset from the disk's centre, at most ``cap``.

    ``rays`` is the stated query set: it meets all disks in blocks, by a
    broadcast of a bounded number of rays (see ``rays_hit_all``).
    """
    t, offset = geo.ray_disk(geo.vec("ox", "oy", "oz"), geo.vec("dx", "dy", "dz"), geo.vec("x", "y", "z"), geo.vec("nx", "ny", "nz"))
    error = 0.01 * t + F.abs(offset)
    pairs = disks.join(F.broadcast(rays), F.lit(True)).select("ray_id", "pid", t.alias("t"), offset.alias("offset"), error.alias("error"), "radius")
    good = pairs.where((F.col("t") >= 0) & (F.col("offset") <= F.col("radius")) & (F.col("error") <= cap))
    return good.groupBy("ray_id").agg(F.min(F.struct("error", "pid", "t")).alias("best")).select("ray_id", "best.pid", "best.error", "best.t")


def rays_hit_all(rays: DataFrame, disks: DataFrame, block: int = 4096, cap: float = 6.0) -> DataFrame:
    """``rays_hit`` for any number of rays, a block of at most ``block`` at a time."""
    n = rays.count()
    blocks = max(1, -(-n // block))
    numbered = rays.withColumn("_block", F.pmod(F.xxhash64("ray_id"), F.lit(2 * blocks)))
    out = None
    for i in range(2 * blocks if n > block else 1):
        part = numbered.where(F.col("_block") == i).drop("_block") if n > block else rays
        hit = rays_hit(part, disks, cap)
        out = hit if out is None else out.unionByName(hit)
    return out


def rays_boxes(rays: DataFrame, boxes: DataFrame) -> DataFrame:
    """The box that each ray enters first, at max(0, entry)."""
    enter, leave = geo.ray_box(
        geo.vec("ox", "oy", "oz"), geo.vec("dx", "dy", "dz"), geo.vec("min_x", "min_y", "min_z"), geo.vec("max_x", "max_y", "max_z")
    )
    pairs = boxes.join(F.broadcast(rays), F.lit(True)).select("ray_id", F.col("id").alias("node"), enter.alias("enter"), leave.alias("leave"))
    hits = pairs.where((F.col("enter") <= F.col("leave")) & (F.col("leave") >= 0)).withColumn("t", F.greatest(F.lit(0.0), "enter"))
    return hits.groupBy("ray_id").agg(F.min(F.struct("t", "node")).alias("best")).select("ray_id", "best.node", "best.t")


def ray_bundle(hits: DataFrame, rays: DataFrame, share: float = 0.25) -> DataFrame:
    """Bundles in which more than a share of the rays hit something: hit count and the mean and covariance of the hit points."""
    from lodestone.operators.aggregates import covariance, smallest_eigenvectors

    sizes = rays.groupBy("bundle").agg(F.count("*").alias("rays"))
    at = {c: F.col(f"o{c}") + F.col("t") * F.col(f"d{c}") for c in geo.AXES}
    points = hits.join(rays, "ray_id").withColumns(at)
    cov = covariance(points, "bundle").join(sizes, "bundle").where(F.col("n") > share * F.col("rays"))
    return smallest_eigenvectors(cov)
