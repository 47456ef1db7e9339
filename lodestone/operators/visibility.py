"""Visibility sets in long form (cell_id, model_id, node_id), and level-of-detail cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import tree

KEY = ["cell_id", "model_id", "node_id"]


def with_bits(visible: DataFrame, new: DataFrame) -> DataFrame:
    """Set bits: an append without repeats."""
    return visible.select(*KEY).unionByName(new.select(*KEY)).distinct()


def visible_ids(visible: DataFrame) -> DataFrame:
    """Sorted node ids per cell and model."""
    return visible.groupBy("cell_id", "model_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))


def propagated(visible: DataFrame, fan: int, deepest: int) -> DataFrame:
    """Adds all ancestors and all descendants down to a depth: arithmetic on ids, no loop over levels."""
    at = visible.select(*KEY, tree.depth_of(F.col("node_id"), fan, deepest).alias("depth"))
    up = at.select("cell_id", "model_id", F.explode(tree.ancestors(F.col("node_id"), fan, deepest)).alias("node_id"))
    down = at.withColumn("to", F.explode(F.sequence(F.col("depth"), F.lit(deepest))))
    steps = F.col("to") - F.col("depth")
    width = F.round(F.pow(F.lit(float(fan)), steps)).cast("long")
    first = F.col("node_id") * width + (steps if fan == 1 else F.floor((width - 1) / (fan - 1)))
    down = down.select("cell_id", "model_id", F.explode(F.sequence(first.cast("long"), (first + width - 1).cast("long"))).alias("node_id"))
    return up.unionByName(down).distinct()


def collapsed_cells(visible: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Parents of octree cells whose every child sees at least a share of what the children see together.

    ``cells`` has cell_id and parent_id; parents of which no child sees anything collapse too.
    """
    seen = cells.join(visible.select(*KEY).distinct(), "cell_id", "left")
    union = seen.groupBy("parent_id").agg(F.count_distinct("model_id", "node_id").alias("total"))
    own = seen.groupBy("parent_id", "cell_id").agg(F.count("node_id").alias("n"))
    worst = own.groupBy("parent_id").agg(F.min("n").alias("least"))
    return worst.join(union, "parent_id").where((F.col("total") == 0) | (F.col("least") >= threshold * F.col("total"))).select("parent_id")


def hoisted(visible: DataFrame, threshold: float = 0.0, children: int = 8) -> DataFrame:
    """One level up: ids seen by enough of a parent's children move to the parent; rows stay with the cell otherwise.

    A child's number is parent * children + 1 + k. At most children - round(children * threshold) of them may lack an id.
    """
    absent = children - round(children * threshold) if threshold > 0 else 0
    at = visible.select(*KEY).distinct().withColumn("parent", tree.parent(F.col("cell_id"), children))
    up = at.where("parent is not null").groupBy("parent", "model_id", "node_id").agg(F.count("*").alias("n")).where(F.col("n") >= children - absent)
    rest = at.join(up.drop("n"), ["parent", "model_id", "node_id"], "left_anti").select(*KEY)
    return rest.unionByName(up.select(F.col("parent").alias("cell_id"), "model_id", "node_id")).distinct()


def inherited(visible: DataFrame, leaves: DataFrame, deepest: int, children: int = 8) -> DataFrame:
    """What leaf cells see themselves or through any ancestor cell."""
    chain = leaves.select("cell_id", F.explode(F.concat(F.array("cell_id"), tree.ancestors(F.col("cell_id"), children, deepest))).alias("holder"))
    got = chain.join(visible.select(F.col("cell_id").alias("holder"), "model_id", "node_id"), "holder")
    return got.select(*KEY).distinct()


def merged_cells(visible: DataFrame, threshold: float, total_nodes: int) -> DataFrame:
    """Irregular grid: cell -> group, merging the pair of cells with the largest common share first, while it reaches the threshold.

    Similarity comes from an equi-join on nodes. A merged group keeps what all
    of its cells see; each round merges pairs that are each other's best, and
    rounds go on until no pair reaches the threshold. A round with such a pair
    has a mutual one (the first of all pairs), so it removes a group.
    """
    from lodestone.model import cut

    groups = cut(visible.select(F.col("cell_id")).distinct().withColumn("grp", F.col("cell_id")))
    bits = cut(visible.select(F.col("cell_id").alias("grp"), "model_id", "node_id").distinct())
    while True:
        a, b = bits.alias("a"), bits.alias("b")
        both = a.join(b, (F.col("a.model_id") == F.col("b.model_id")) & (F.col("a.node_id") == F.col("b.node_id")) & (F.col("a.grp") != F.col("b.grp")))
        pairs = both.groupBy(F.col("a.grp").alias("p"), F.col("b.grp").alias("q")).agg(F.count("*").alias("c"))
        sizes = bits.groupBy("grp").agg(F.count("*").alias("n"))
        pairs = pairs.join(sizes.select(F.col("grp").alias("p"), F.col("n").alias("np")), "p").join(sizes.select(F.col("grp").alias("q"), F.col("n").alias("nq")), "q")
        # Equal bits, seen or unseen, over all bits.
        share = (F.lit(total_nodes) - F.col("np") - F.col("nq") + 2 * F.col("c")) / F.lit(total_nodes)
        good = pairs.withColumn("share", share).where(F.col("share") >= threshold)
        best = good.groupBy("p").agg(F.max(F.struct("share", -F.least("p", "q"), -F.greatest("p", "q"), "q")).alias("m")).select("p", F.col("m.q").alias("q"))
        mutual = cut(best.alias("s").join(best.alias("t"), (F.col("s.q") == F.col("t.p")) & (F.col("t.q") == F.col("s.p"))).where("s.p > s.q").select(F.col("s.p").alias("grp"), F.col("s.q").alias("to")))
        if mutual.isEmpty():
            break
        groups = cut(groups.join(mutual, "grp", "left").select("cell_id", F.coalesce("to", "grp").alias("grp")))
        moved = bits.join(mutual, "grp", "left").select(F.coalesce("to", "grp").alias("grp"), "model_id", "node_id", F.col("to").isNotNull().alias("_m"))
        involved = mutual.select("to").withColumnRenamed("to", "grp").withColumn("_two", F.lit(True))
        kept = moved.join(involved, "grp", "left").groupBy("grp", "model_id", "node_id", "_two").agg(F.count("*").alias("c"))
        bits = cut(kept.where(F.col("_two").isNull() | (F.col("c") == 2)).select("grp", "model_id", "node_id"))
    return groups


def extrapolated(border: DataFrame) -> DataFrame:
    """The 26 outer cells: a face from the border cells of its direction, an edge from two faces, a corner from three.

    ``border`` has direction (0 to 5: -x, +x, -y, +y, -z, +z), model_id, node_id.
    """
    rows = []
    for sz in (-1, 0, 1):
        for sy in (-1, 0, 1):
            for sx in (-1, 0, 1):
                faces = [2 * k + (s > 0) for k, s in enumerate((sx, sy, sz)) if s]
                rows += [(9 * (1 + sz) + 3 * (1 + sy) + 1 + sx, f) for f in faces]
    spark = border.sparkSession
    table = F.broadcast(spark.createDataFrame(rows, "cell_id int, direction int"))  # 54 rows
    return border.join(table, "direction").select("cell_id", "model_id", "node_id").distinct()


def lod_cut(nodes: DataFrame, threshold: float, fan: int) -> DataFrame:
    """Nodes shown without state: own error at most the threshold while the parent's is above, or a leaf with all ancestors above.

    ``nodes`` has node_id, error (view included) and visible.
    """
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("error").alias("parent_error"), F.col("visible").alias("parent_visible"))
    at = nodes.withColumn("parent_id", tree.parent(F.col("node_id"), fan)).join(up, "parent_id", "left")
    inner = nodes.select(tree.parent(F.col("node_id"), fan).alias("node_id")).distinct().withColumn("inner", F.lit(True))
    at = at.join(inner, "node_id", "left")
    reached = F.col("parent_error").isNull() | ((F.col("parent_error") > threshold) & F.col("parent_visible"))
    stops = (F.col("error") <= threshold) | F.col("inner").isNull() | ~F.col("visible")
    return at.where(reached & stops).select("node_id", "error")


def cut_actions(nodes: DataFrame, threshold: float, hysteresis: float = 0.1) -> DataFrame:
    """Split, collapse or keep for the nodes of a cut: split above the threshold if the children would not collapse at once."""
    split = F.col("visible") & (F.col("error") > threshold + hysteresis) & F.coalesce(F.col("child_error") >= threshold - hysteresis, F.lit(False))
    collapse = ~F.col("visible") | (F.col("error") < threshold - hysteresis)
    return nodes.withColumn("action", F.when(split, "split").when(collapse, "collapse").otherwise("keep"))


def tile_cut(requests: DataFrame, budget: int) -> DataFrame:
    """Tiles to load: by requested level first, within the budget (a parameter of the cache)."""
    order = Window.orderBy(F.col("priority").desc(), "tile_id")
    top = requests.orderBy(F.col("priority").desc(), "tile_id").limit(budget)
    return top.withColumn("slot", F.row_number().over(order) - 1)


def collapsible_tiles(tiles: DataFrame, wanted: Column) -> DataFrame:
    """Parents all four of whose children are in the cut and not wanted."""
    at = tiles.withColumn("parent_id", tree.parent(F.col("tile_id"), 4)).where("parent_id is not null")
    return at.groupBy("parent_id").agg(F.count("*").alias("n"), F.count_if(wanted).alias("w")).where("n = 4 and w = 0").select("parent_id")


def packed_cells(visible: DataFrame, words: int) -> DataFrame:
    """Bit set per cell and model as 64-bit words (word, bits), for export."""
    at = visible.select(*KEY).distinct().withColumn("word", F.floor(F.col("node_id") / 64)).where(F.col("word") < words)
    return at.groupBy("cell_id", "model_id", "word").agg(F.bit_or(F.expr("shiftleft(1L, cast(node_id % 64 as int))")).alias("bits"))


def unpacked_cells(packed: DataFrame) -> DataFrame:
    """The long form of packed words."""
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1) = 1)"))
    return packed.withColumn("_i", bit).select("cell_id", "model_id", (F.col("word") * 64 + F.col("_i")).alias("node_id"))


def sampled_visibility(cells: DataFrame, boxes: DataFrame, samples: int, seed: int = 3) -> DataFrame:
    """Nodes that rays from seeded positions in each cell, in six directions, meet first.

    ``cells`` has cell_id, low corner lx, ly, lz and edge; ``boxes`` id and min/max. Rays stand in for a rendering.
    """
    from lodestone.operators.neighbors import rays_boxes

    u = lambda salt: F.pmod(F.xxhash64("cell_id", "sample", F.lit(seed), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    at = cells.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    at = at.withColumns({f"o{c}": F.col(f"l{c}") + u(c) * F.col("edge") for c in "xyz"})
    axes = F.array(*(F.struct(*(F.lit(float(s if k == a else 0)).alias(f"d{c}") for k, c in enumerate("xyz"))) for a in range(3) for s in (-1, 1)))
    at = at.select("*", F.posexplode(axes).alias("direction", "d")).select("cell_id", "ox", "oy", "oz", "d.*", F.concat_ws("_", "cell_id", "sample", "direction").alias("ray_id"))
    hits = rays_boxes(at.select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz"), boxes)
    return hits.select(F.split("ray_id", "_")[0].cast("long").alias("cell_id"), F.lit(0).alias("model_id"), F.col("node").alias("node_id")).distinct()


def atlas_level(tiles: DataFrame, level: int) -> DataFrame:
    """All tiles of a level with their places; the id range prunes the scan."""
    first = tree.first_of_depth(level, 4)
    at = tiles.where(F.col("tile_id").between(first, first + 4**level - 1))
    x, y = tree.quad_decoded(F.col("tile_id"), level)
    return at.withColumn("x", x).withColumn("y", y)
