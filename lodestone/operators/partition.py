"""Trees and cells: equal-run splits, downsweep, octrees, voxel thinning and balanced splits.

Ranks within a node never come from one window over the node: rows fall into
value buckets of bounded size, bucket counts give offsets, and only the rows of
one bucket are ranked together. So the first tree levels, where a node holds everything, are
as parallel as the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import geometry as geo
from lodestone.functions import tree
from lodestone.model import cut


def choose_tree(n: int, surfels_per_node: int, max_fan: int = 2) -> tuple[int, int]:
    """(fan, depth) of the tree whose leaves are closest to the wanted size, fans from 2 to max_fan."""
    best = None
    for fan in range(2, max_fan + 1):
        depth = 0
        while n / fan**depth > surfels_per_node:
            depth += 1
        for d in {max(depth - 1, 0), depth}:
            key = (abs(surfels_per_node - n / fan**d), fan, d)
            best = min(best, key) if best else key
    return best[1], best[2]


def longest_axis(low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    """0, 1 or 2; the first among equals."""
    dx, dy, dz = (b - a for a, b in zip(low, high, strict=True))
    return F.when((dx >= dy) & (dx >= dz), 0).when(dy >= dz, 1).otherwise(2)


def shortest_axis(low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    dx, dy, dz = (b - a for a, b in zip(low, high, strict=True))
    return F.when((dx <= dy) & (dx <= dz), 0).when(dy <= dz, 1).otherwise(2)


#: Rows of a table of groups or buckets that goes to all tasks.
SMALL = 1 << 18


def beside(small: DataFrame, name: str = "beside") -> DataFrame:
    """A table of a row a group or bucket, to be joined with their rows: whole in each task while it has at most ``SMALL`` rows.

    A join on few groups would otherwise gather each of them in one task; of more groups than that each holds a small share.
    """
    at = cut(small, name)
    return F.broadcast(at) if at.count() <= SMALL else at


def bucketed(df: DataFrame, by: str, value: str, tie: str = "pid", rows_per_bucket: int = 16384) -> DataFrame:
    """Adds ``n``, the rows of the group, and ``_before``, those in buckets ahead of the row's own, which names its bucket.

    Buckets are even ranges of a group's values. Those with over four times the
    wanted rows are cut again between their own ends, or those of the tie where
    all values are equal, until none is left: so neither one common value nor
    one far value makes a large bucket. Only rows equal in value and tie, and
    groups with infinite values, stay together.
    """
    own = [by, "_before"]
    ends = [f(c).alias(f"_{m}{k}") for k, c in enumerate((value, tie)) for m, f in (("lo", F.min), ("hi", F.max))]
    spread = F.col("_hi0") > F.col("_lo0")
    splits = F.when(spread, F.col("_hi0") - F.col("_lo0") < float("inf")).otherwise(F.col("_hi1") > F.col("_lo1"))
    part = lambda c, k: (F.col(c) - F.col(f"_lo{k}")) / (F.col(f"_hi{k}") - F.col(f"_lo{k}"))
    place = F.when(splits, F.when(spread, part(value, 0)).otherwise(part(tie, 1))).otherwise(0.0)
    last = F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_per_bucket)) - 1
    bucket = F.when(F.col("_n").isNull(), 0).otherwise(F.least(F.floor(place * (last + 1)), last)).cast("long")
    ahead = F.coalesce(F.sum("_c").over(Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    at = df.withColumn("_before", F.lit(0).cast("long"))
    span = cut(at.groupBy(*own).agg(F.count("*").alias("_n"), *ends), "spans")
    small = span.count() <= SMALL
    span = F.broadcast(span) if small else span
    counts = span.select(by, F.col("_n").alias("n"))
    at = at.join(F.broadcast(counts) if small else counts, by)
    names = at.columns
    while True:
        at = at.join(span, own, "left").withColumn("_b", bucket).select(*names, "_b")
        sizes = cut(at.groupBy(*own, "_b").agg(F.count("*").alias("_c")), "buckets").withColumn("_ahead", ahead)
        places = sizes.drop("_c")
        at = at.join(F.broadcast(places) if sizes.count() <= SMALL else places, [*own, "_b"]).withColumn("_before", F.col("_before") + F.col("_ahead")).select(*names)
        large = sizes.where(F.col("_c") > 4 * rows_per_bucket).select(by, (F.col("_before") + F.col("_ahead")).alias("_before"))
        if large.isEmpty():
            return at
        at = cut(at, "buckets")
        span = at.join(beside(large, "large"), own, "left_semi").groupBy(*own).agg(F.count("*").alias("_n"), *ends).where(splits)
        span = beside(span, "spans")
        if span.isEmpty():
            return at


def ranked(df: DataFrame, by: str, value: str, tie: str = "pid", rows_per_bucket: int = 16384) -> DataFrame:
    """Adds ``n`` (rows of the group) and ``rank`` (from 1, by value and tie), bucket by bucket."""
    own = F.row_number().over(Window.partitionBy(by, "_before").orderBy(value, tie))
    return bucketed(df, by, value, tie, rows_per_bucket).withColumn("rank", F.col("_before") + own).drop("_before")


def run_of(rank: Column, n: Column, fan: int) -> Column:
    """Run 0 to fan - 1 of a rank when n rows form equal runs, the remainder in the first ones."""
    q, m = F.floor(n / fan), F.pmod(n, F.lit(fan))
    return F.when(rank <= m * (q + 1), F.floor((rank - 1) / (q + 1))).otherwise(m + F.floor((rank - 1 - m * (q + 1)) / F.greatest(q, F.lit(1)))).cast("long")


def split_runs(df: DataFrame, by: str, axis: str, fan: int) -> DataFrame:
    """``run`` of each row: equal runs of every group along an axis."""
    at = ranked(df, by, axis)
    return at.withColumn("run", run_of(F.col("rank"), F.col("n"), fan)).drop("n", "rank")


def downsweep(points: DataFrame, depth: int, fan: int = 2) -> DataFrame:
    """``node_id`` of each point after ``depth`` splits on the longest axis of each node's box; the loop is over levels only."""
    at = points.withColumn("node_id", F.lit(0).cast("long"))
    for _ in range(depth):
        box = at.groupBy("node_id").agg(*(f(c).alias(f"_{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in geo.AXES))
        axis = longest_axis(geo.vec("_lx", "_ly", "_lz"), geo.vec("_hx", "_hy", "_hz"))
        at = at.join(beside(box.select("node_id", axis.alias("_axis")), "axes"), "node_id")
        at = at.withColumn("_v", F.when(F.col("_axis") == 0, F.col("x")).when(F.col("_axis") == 1, F.col("y")).otherwise(F.col("z")))
        runs = split_runs(at, "node_id", "_v", fan)
        at = cut(runs.withColumn("node_id", tree.child(F.col("node_id"), F.col("run"), fan)).select(*points.columns, "node_id"))
    return at


def centered(points: DataFrame) -> DataFrame:
    """Positions minus the floored centre of the box; the translation stays in tx, ty, tz."""
    box = points.agg(*(F.floor((F.min(c) + F.max(c)) / 2).cast("double").alias(f"t{c}") for c in geo.AXES))
    moved = points.join(F.broadcast(box), F.lit(True))  # one row
    return moved.withColumns({c: F.col(c) - F.col(f"t{c}") for c in geo.AXES})


def grid_cells(df: DataFrame, size: float) -> DataFrame:
    """Uniform cells of the whole box, numbered x first."""
    box = df.agg(*(F.min(c).alias(f"l{c}") for c in geo.AXES), *(F.greatest(F.lit(1), F.ceil((F.max(c) - F.min(c)) / size)).alias(f"n{c}") for c in geo.AXES))
    at = df.join(F.broadcast(box), F.lit(True))  # one row
    i = [F.least(F.floor((F.col(c) - F.col(f"l{c}")) / size), F.col(f"n{c}") - 1) for c in geo.AXES]
    cell = (i[2] * F.col("ny") + i[1]) * F.col("nx") + i[0]
    return at.withColumn("cell", cell.cast("long")).drop(*(f"{p}{c}" for p in "ln" for c in geo.AXES))


def view_cell(p: geo.Vec, low: tuple[float, ...], size: float, counts: tuple[int, int, int]) -> Column:
    """Cell of a regular view grid; null outside."""
    i = [F.floor((c - a) / size) for c, a in zip(p, low, strict=True)]
    inside = geo.every(*((k >= 0) & (k < n) for k, n in zip(i, counts, strict=True)))
    return F.when(inside, (i[2] * counts[1] + i[1]) * counts[0] + i[0]).cast("long")


def bounding_cell(p: geo.Vec, center: geo.Vec, half: geo.Vec) -> Column:
    """One of 27 cells around and including a centre cell, by the sign of the offset beyond half its size."""
    s = [F.when(c - m > h, 1).when(c - m < -h, -1).otherwise(0) for c, m, h in zip(p, center, half, strict=True)]
    return 9 * (1 + s[2]) + 3 * (1 + s[1]) + 1 + s[0]


def balanced_split(df: DataFrame, parts: int, buckets: int = 100) -> DataFrame:
    """``part`` of each row: parts are halved along their longest axis at a histogram cut until none is above the even size."""
    n = df.count()
    most = -(-n // parts) if parts else n
    at = df.withColumn("part", F.lit(1).cast("long"))
    for _ in range(40):
        box = at.groupBy("part").agg(F.count("*").alias("n"), *(f(c).alias(f"{m}{c}") for m, f in (("l", F.min), ("h", F.max)) for c in geo.AXES))
        axis = longest_axis(geo.vec("lx", "ly", "lz"), geo.vec("hx", "hy", "hz"))
        pick = lambda p: F.when(F.col("axis") == 0, F.col(f"{p}x")).when(F.col("axis") == 1, F.col(f"{p}y")).otherwise(F.col(f"{p}z"))
        big = box.where(F.col("n") > most).withColumn("axis", axis).withColumn("lo", pick("l")).withColumn("hi", pick("h")).where("hi > lo").select("part", "n", "axis", "lo", "hi")
        big = beside(big, "big")
        if big.isEmpty():
            break
        v = F.when(F.col("axis") == 0, F.col("x")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("z"))
        slot = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        placed = at.join(big, "part", "left").withColumn("slot", slot)
        hist = placed.where("n is not null").groupBy("part", "slot").agg(F.count("*").alias("c"), F.first("n").alias("n"))
        upto = F.sum("c").over(Window.partitionBy("part").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
        cuts = hist.withColumn("miss", F.abs(upto - F.col("n") / 2)).groupBy("part").agg(F.min(F.struct("miss", "slot")).alias("m"))
        # The lower side keeps slots up to the cut, but the last slot always goes up so that both sides have rows.
        cuts = cuts.select("part", F.least(F.col("m.slot"), F.lit(buckets - 2)).alias("edge"))
        placed = placed.join(beside(cuts, "cuts"), "part", "left")
        half = F.when(F.col("edge").isNull(), F.col("part")).otherwise(2 * F.col("part") + (F.col("slot") > F.col("edge")).cast("long"))
        at = cut(placed.withColumn("part", half).select(*df.columns, "part"))
    return at


def halved(df: DataFrame, max_points: int) -> DataFrame:
    """Sort a part on its longest axis and halve it, while it has more than max_points rows."""
    at = df.withColumn("part", F.lit(1).cast("long"))
    for _ in range(60):
        box = at.groupBy("part").agg(F.count("*").alias("n"), *(f(c).alias(f"{m}{c}") for m, f in (("l", F.min), ("h", F.max)) for c in geo.AXES))
        big = beside(box.where(F.col("n") > max_points).select("part", longest_axis(geo.vec("lx", "ly", "lz"), geo.vec("hx", "hy", "hz")).alias("_axis")), "big")
        if big.isEmpty():
            return at
        todo = at.join(big, "part")
        todo = todo.withColumn("_v", F.when(F.col("_axis") == 0, F.col("x")).when(F.col("_axis") == 1, F.col("y")).otherwise(F.col("z")))
        split = split_runs(todo, "part", "_v", 2).withColumn("part", 2 * F.col("part") + F.col("run")).select(*df.columns, "part")
        at = cut(at.join(big, "part", "left_anti").select(*df.columns, "part").unionByName(split))
    return at


# -- octrees ---------------------------------------------------------------


def cube(df: DataFrame, cubic: bool = True) -> dict[str, float]:
    """Low corner and edges of the box, made a cube around its centre if wanted; one row reaches the driver."""
    row = df.agg(*(F.min(c).alias(f"l{c}") for c in geo.AXES), *(F.max(c).alias(f"h{c}") for c in geo.AXES)).first()
    if row["lx"] is None:
        return {f"{p}{c}": 0.0 for p in "le" for c in geo.AXES}
    edge = {c: row[f"h{c}"] - row[f"l{c}"] for c in geo.AXES}
    if cubic:
        most = max(edge.values())
        return {f"l{c}": (row[f"l{c}"] + row[f"h{c}"]) / 2 - most / 2 for c in geo.AXES} | {f"e{c}": most for c in geo.AXES}
    return {f"l{c}": row[f"l{c}"] for c in geo.AXES} | {f"e{c}": edge[c] for c in geo.AXES}


def octree_key(box: dict[str, float], level: int) -> Column:
    """Cell number at a level, 3 bits a level."""
    side = 1 << level
    at = [F.least(F.greatest(F.floor((F.col(c) - F.lit(box[f"l{c}"])) / F.lit(box[f"e{c}"] or 1.0) * side), F.lit(0)), F.lit(side - 1)).cast("long") for c in geo.AXES]
    key = F.lit(0).cast("long")
    for b in range(level):
        for k, i in enumerate(at):
            key = key + F.shiftleft(F.shiftright(i, b).bitwiseAND(F.lit(1)), 3 * b + k)
    return key


def octree_leaves(points: DataFrame, max_depth: int, max_points: int, cubic: bool = True) -> DataFrame:
    """``level`` and ``leaf`` of each point: the first level at which its cell has at most ``max_points`` points, or the deepest.

    Keys of all levels are prefixes of the deepest one, so the counts of all
    levels come from one aggregation of the deepest cells.
    """
    box = cube(points, cubic)
    keyed = points.withColumn("_key", octree_key(box, max_depth))
    cells = keyed.groupBy("_key").agg(F.count("*").alias("c"))
    up = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    up = up.withColumn("cell", F.expr(f"shiftright(_key, 3 * ({max_depth} - level))"))
    small = up.groupBy("level", "cell").agg(F.sum("c").alias("n")).where((F.col("n") <= max_points) | (F.col("level") == max_depth))
    stops = up.join(small, ["level", "cell"]).groupBy("_key").agg(F.min(F.struct("level", "cell")).alias("s"))
    out = keyed.join(stops, "_key")
    return out.select(*points.columns, F.col("s.level").alias("level"), F.col("s.cell").alias("leaf"))


def octree_lookup(probes: DataFrame, leaves: DataFrame, box: dict[str, float], max_depth: int, closed: bool = False) -> DataFrame:
    """Deepest leaf (level, leaf) around each probe (pid, x, y, z); null outside the box.

    With ``closed``, the root (level 0) stands in for probes that no leaf holds.
    """
    inside = geo.box_contains_point(
        tuple(F.lit(box[f"l{c}"]) for c in geo.AXES), tuple(F.lit(box[f"l{c}"] + box[f"e{c}"]) for c in geo.AXES), geo.vec("x", "y", "z"), closed
    )
    at = probes.withColumn("_key", F.when(inside, octree_key(box, max_depth))).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    at = at.withColumn("leaf", F.expr(f"shiftright(_key, 3 * ({max_depth} - level))"))
    hit = at.join(leaves.select("level", "leaf").distinct(), ["level", "leaf"]).groupBy("pid").agg(F.max(F.struct("level", "leaf")).alias("s"))
    out = probes.join(hit, "pid", "left").select("pid", F.col("s.level").alias("level"), F.col("s.leaf").alias("leaf"))
    return out.fillna({"level": 0, "leaf": 0}) if closed else out


def regularized(points: DataFrame, d: float, max_depth: int = 20) -> DataFrame:
    """Voxel thinning: one point per leaf of the octree that stops at one point or at an edge of at most d.

    The point is the cell's centre with the mean normal and colour, and radius d.
    """
    box = cube(points)
    depth, edge = 0, box["ex"]
    while edge > d and depth < max_depth:
        depth, edge = depth + 1, edge / 2
    at = octree_leaves(points, depth, 1)
    side = F.lit(box["ex"]) / F.pow(F.lit(2.0), F.col("level"))
    out = at.groupBy("level", "leaf").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("nx", "ny", "nz", "r", "g", "b")))
    for k, c in enumerate(geo.AXES):
        bits = F.expr(f"aggregate(sequence(0, {max(depth - 1, 0)}), 0L, (s, b) -> s + shiftleft(shiftright(leaf, 3 * b + {k}) & 1, b))")
        out = out.withColumn(c, F.lit(box[f"l{c}"]) + (bits + 0.5) * side)
    return out.withColumn("radius", F.lit(d))
