"""Bounding boxes, node properties, statistics, histograms and provenance aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import geometry as geo


def bounding_box(df: DataFrame, *by: str) -> DataFrame:
    """Box of the positions per group; partial and final aggregation come with it, and nulls are ignored."""
    return df.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in geo.AXES))


def representative_radius(r: Column, kind: str = "arithmetic") -> Column:
    """Mean of the positive radii: arithmetic, geometric or harmonic."""
    r = F.when(r > 0, r)
    if kind == "arithmetic":
        return F.avg(r)
    return F.exp(F.avg(F.ln(r))) if kind == "geometric" else F.count(r) / F.sum(1.0 / r)


def node_properties(df: DataFrame, by: str, mean: str = "arithmetic") -> DataFrame:
    """Centroid, representative radius, disk-aware box and largest radius deviation; rows without a radius only count for the box."""
    some = F.col("radius") > 0
    low, high = geo.disk_box(geo.vec("x", "y", "z"), geo.vec("nx", "ny", "nz"), F.col("radius"))
    boxes = [F.min(F.when(some, a).otherwise(F.col(c))).alias(f"min_{c}") for a, c in zip(low, geo.AXES, strict=True)]
    boxes += [F.max(F.when(some, b).otherwise(F.col(c))).alias(f"max_{c}") for b, c in zip(high, geo.AXES, strict=True)]
    spread = [F.max(F.when(some, F.col("radius"))).alias("_top"), F.min(F.when(some, F.col("radius"))).alias("_low")]
    centre = [F.avg(F.when(some, F.col(c))).alias(f"c{c}") for c in geo.AXES]
    out = df.groupBy(by).agg(F.count("*").alias("n"), representative_radius(F.col("radius"), mean).alias("avg_radius"), *centre, *boxes, *spread)
    # The largest deviation from the mean is at one of the ends, so one pass is enough.
    deviation = F.greatest(F.col("_top") - F.col("avg_radius"), F.col("avg_radius") - F.col("_low"))
    return out.withColumn("max_radius_dev", deviation).drop("_top", "_low")


def node_statistics(df: DataFrame, by: str) -> DataFrame:
    """Means over rows with a radius and population deviations over all rows around those means.

    The deviation of a vector is the root of the mean squared distance from
    its mean; the mean normal is normalised first. Sums of squares give the
    deviations in the same pass: E|v - m|² = E|v|² - 2 m·E v + |m|².
    """
    some = F.col("radius") != 0
    pos, col, nor = geo.AXES, ("r", "g", "b"), ("nx", "ny", "nz")
    means = [F.avg(F.when(some, F.col(c))).alias(f"m_{c}") for c in (*pos, *col, *nor, "radius")]
    alls = [F.avg(c).alias(f"a_{c}") for c in (*pos, *col, *nor, "radius")]
    square = lambda cs: F.avg(sum(F.col(c) * F.col(c) for c in cs))
    squares = [square(cs).alias(f"q_{n}") for n, cs in (("pos", pos), ("col", col), ("nor", nor), ("rad", ("radius",)))]
    s = df.groupBy(by).agg(*means, *alls, *squares)
    size = F.sqrt(sum(F.col(f"m_{c}") ** 2 for c in nor))
    s = s.withColumns({f"m_{c}": F.when(size > 0, F.col(f"m_{c}") / size).otherwise(F.col(f"m_{c}")) for c in nor})

    def deviation(name: str, cs: tuple[str, ...]) -> Column:
        inner = sum(F.col(f"m_{c}") * F.col(f"a_{c}") for c in cs)
        own = sum(F.col(f"m_{c}") * F.col(f"m_{c}") for c in cs)
        return F.sqrt(F.greatest(F.lit(0.0), F.col(f"q_{name}") - 2 * inner + own))

    devs = {f"sd_{n}": deviation(n, cs) for n, cs in (("pos", pos), ("col", col), ("nor", nor), ("rad", ("radius",)))}
    return s.withColumns(devs).select(by, *(f"m_{c}" for c in (*pos, *col, *nor, "radius")), *devs)


def color_histogram(df: DataFrame, *by: str) -> DataFrame:
    """Counts per channel and value."""
    long = df.select(*by, F.explode(F.create_map(*(x for c in ("r", "g", "b") for x in (F.lit(c), F.col(c).cast("int"))))).alias("channel", "value"))
    return long.groupBy(*by, "channel", "value").agg(F.count("*").alias("n"))


def cluster_representative(df: DataFrame, by: str) -> DataFrame:
    """Mean position, normal and colour; the radius that encloses all members; the largest alpha."""
    mean = df.groupBy(by).agg(*(F.avg(c).alias(f"m_{c}") for c in (*geo.AXES, "nx", "ny", "nz", "r", "g", "b")), F.max("a").alias("a"))
    reach = F.sqrt(geo.distance2(geo.vec("x", "y", "z"), geo.vec("m_x", "m_y", "m_z"))) + F.col("radius")
    far = df.join(mean.select(by, "m_x", "m_y", "m_z"), by).groupBy(by).agg(F.max(reach).alias("radius"))
    return mean.join(far, by)


def boxes_up(nodes: DataFrame, fan: int, deepest: int) -> DataFrame:
    """Union of the leaf boxes for every node, by exploding each leaf's ancestors once."""
    from lodestone.functions import tree

    all_ids = F.concat(F.array("node_id"), tree.ancestors(F.col("node_id"), fan, deepest))
    up = nodes.withColumn("node_id", F.explode(all_ids))
    lows, highs = [f"min_{c}" for c in geo.AXES], [f"max_{c}" for c in geo.AXES]
    return up.groupBy("node_id").agg(*(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs), F.sum("n").alias("n"))


def normal_deviation(df: DataFrame, by: str) -> DataFrame:
    """Mean and root mean square angle between normals and the group's mean normal, and their ratio (-1 if the mean is 0)."""
    mean = df.groupBy(by).agg(*(F.avg(c).alias(f"m_{c}") for c in ("nx", "ny", "nz")))
    size = F.sqrt(sum(F.col(f"m_{c}") ** 2 for c in ("nx", "ny", "nz")))
    cosine = geo.dot(geo.vec("nx", "ny", "nz"), geo.vec("m_nx", "m_ny", "m_nz")) / F.when(size > 0, size)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    out = df.join(mean, by).groupBy(by).agg(F.avg(angle).alias("mad"), F.sqrt(F.avg(angle * angle)).alias("sd"))
    return out.withColumn("cv", F.when(F.col("mad") > 0, F.col("sd") / F.col("mad")).otherwise(-1.0))


def distinct_images(points: DataFrame, leaf: str, measurements: str = "measurements") -> DataFrame:
    """Sorted distinct camera ids per leaf."""
    long = points.select(leaf, F.explode(F.col(f"{measurements}.camera")).alias("camera"))
    return long.groupBy(leaf).agg(F.array_sort(F.collect_set("camera")).alias("images"))


def leaf_metadata(points: DataFrame, leaf: str) -> DataFrame:
    """Mean photometric consistency and the unions of the seen and unseen images per leaf."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return points.groupBy(leaf).agg(F.avg("ncc").alias("ncc"), union("seen").alias("seen"), union("not_seen").alias("not_seen"))


def pixel_histogram(pixels: DataFrame, *by: str) -> DataFrame:
    """Counts per model and node of packed pixel values; the model is 255 minus the top byte, and 255 is background."""
    model = F.lit(255) - F.shiftright(F.col("value"), 24).bitwiseAND(F.lit(255))
    node = F.col("value").bitwiseAND(F.lit(0xFFFFFF))
    seen = pixels.select(*by, model.cast("int").alias("model_id"), node.alias("node_id")).where(F.col("model_id") != 255)
    return seen.groupBy(*by, "model_id", "node_id").agg(F.count("*").alias("n"))


def visible_nodes(histogram: DataFrame, pixels: int, threshold: float) -> DataFrame:
    """Nodes whose share of the pixels, in per cent, reaches the threshold."""
    return histogram.where(F.col("n") / pixels * 100 >= threshold)


def occlusion_histogram(visible: DataFrame, cells: DataFrame, total_nodes: int, bins: int = 10) -> DataFrame:
    """Cells per equi-width bin of their occluded share in per cent."""
    seen = cells.join(visible.groupBy("cell_id").agg(F.count("*").alias("n")), "cell_id", "left")
    share = (1 - F.coalesce("n", F.lit(0)) / total_nodes) * 100
    width = 100 / bins
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.round((share - width / 2) / width).cast("int")))
    return seen.groupBy(bin_.alias("bin")).agg(F.count("*").alias("cells"), F.avg(share).alias("mean_occlusion"))


def compare_visibility(one: DataFrame, two: DataFrame) -> DataFrame:
    """Per cell, how many nodes are visible in both, only the first and only the second."""
    key = ["cell_id", "model_id", "node_id"]
    a, b = one.select(*key).distinct().withColumn("in1", F.lit(True)), two.select(*key).distinct().withColumn("in2", F.lit(True))
    both = a.join(b, key, "full")
    return both.groupBy("cell_id").agg(
        F.count_if(F.col("in1") & F.col("in2")).alias("common"),
        F.count_if(F.col("in1") & F.col("in2").isNull()).alias("only_one"),
        F.count_if(F.col("in2") & F.col("in1").isNull()).alias("only_two"),
    )


def series_extrema(df: DataFrame, sim: str, step: str, value: str) -> DataFrame:
    """Extrema per step and over all steps of a simulation, in one pass of grouping sets (a null step is the whole)."""
    return df.groupingSets([[sim, step], [sim]], sim, step).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def covariance(df: DataFrame, by: str) -> DataFrame:
    """Mean and the six covariance sums of the positions, all by partial aggregation."""
    axes = geo.AXES
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    s = df.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in axes), *(F.avg(F.col(a) * F.col(b)).alias(f"e{a}{b}") for a, b in pairs))
    return s.select(by, "n", *(f"m{a}" for a in axes), *((F.col(f"e{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}")).alias(f"c{a}{b}") for a, b in pairs))


def smallest_eigenvectors(cov: DataFrame) -> DataFrame:
    """Eigenvalues (ascending) and the unit eigenvector of the smallest one, first nonzero component positive, in Arrow batches."""
    names = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]
    schema = T.StructType(list(cov.schema.fields))
    for c in ("l0", "l1", "l2", "ex", "ey", "ez"):
        schema = schema.add(c, "double")

    def run(batches):
        import numpy as np

        for pdf in batches:
            m = pdf[names].to_numpy(float)
            full = m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(full) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            v = vectors[:, :, 0]
            lead = np.where(np.abs(v) > 1e-9, v, 0)
            first = np.take_along_axis(lead, (lead != 0).argmax(axis=1)[:, None], 1)
            v = v * np.where(first < 0, -1.0, 1.0)
            yield pdf.assign(l0=values[:, 0], l1=values[:, 1], l2=values[:, 2], ex=v[:, 0], ey=v[:, 1], ez=v[:, 2])

    return cov.mapInPandas(run, schema)


def mip_level(grid: DataFrame, channels: tuple[str, ...] = ("value",)) -> DataFrame:
    """The next level of a 2D grid (level, px, py): each cell the integer mean of four."""
    up = grid.groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("px") / 2).alias("px"), F.floor(F.col("py") / 2).alias("py"))
    return up.agg(*(F.shiftright(F.sum(c), 2).alias(c) for c in channels))


def gaps(values: DataFrame, by: str, run: str, value: str) -> DataFrame:
    """Cuts midway between the last row of a run and the first of the next."""
    from pyspark.sql.window import Window

    ends = values.groupBy(by, run).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    after = F.lead("low").over(Window.partitionBy(by).orderBy(run))
    return ends.withColumn("cut", (F.col("high") + after) / 2).where(F.col("cut").isNotNull()).select(by, run, "cut")
