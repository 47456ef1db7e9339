"""Queries of aggregates, histograms, visibility sets, series and grids over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import geometry as geo
from lodestone.functions import tree
from lodestone.model import PARTS_SQL, SURFELS_SQL, parts, read, rounded, surfels
from lodestone.operators import aggregates as agg
from lodestone.operators import visibility as vis
from lodestone.plans.registry import query

AXES = geo.AXES


def s(body: str) -> str:
    return f"WITH {SURFELS_SQL} {body}"


def noded(spark, d) -> DataFrame:
    return surfels(spark, d).withColumn("node_id", F.col("l_partkey") % 16)


NODED = ", n AS (SELECT *, l_partkey % 16 AS node_id FROM surfels)"


@query("agg01_bounding_box", s("SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM surfels"))
def bounding_box(spark, d) -> DataFrame:
    return agg.bounding_box(surfels(spark, d))


@query(
    "agg02_node_properties",
    s(NODED + """, p AS (SELECT node_id, count(*) AS n, avg(CASE WHEN radius > 0 THEN radius END) AS m,
      avg(CASE WHEN radius > 0 THEN x END) AS cx, avg(CASE WHEN radius > 0 THEN y END) AS cy, avg(CASE WHEN radius > 0 THEN z END) AS cz,
      min(CASE WHEN radius > 0 THEN x - abs(radius - radius * nx * nx) ELSE x END) AS min_x, max(CASE WHEN radius > 0 THEN z + abs(radius - radius * nz * nz) ELSE z END) AS max_z
      FROM n GROUP BY node_id)
    SELECT p.node_id, p.n, round(m, 6) AS avg_radius, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(min_x, 6) + 0.0 AS min_x, round(max_z, 6) AS max_z,
      round((SELECT max(abs(radius - m)) FROM n WHERE n.node_id = p.node_id AND radius > 0), 6) AS max_radius_dev FROM p"""),
)
def node_properties(spark, d) -> DataFrame:
    out = agg.node_properties(noded(spark, d), "node_id")
    return rounded(out.select("node_id", "n", "avg_radius", "cx", "cy", "cz", "min_x", "max_z", "max_radius_dev"), 6)


@query(
    "agg03_representative_radius",
    s(NODED + """ SELECT node_id, round(avg(radius), 6) AS arithmetic, round(exp(avg(ln(radius))), 6) AS geometric, round(count(*) / sum(1.0 / radius), 6) AS harmonic
    FROM n WHERE radius > 0 GROUP BY node_id"""),
)
def representative_radius(spark, d) -> DataFrame:
    kinds = ("arithmetic", "geometric", "harmonic")
    return rounded(noded(spark, d).groupBy("node_id").agg(*(agg.representative_radius(F.col("radius"), k).alias(k) for k in kinds)), 6)


@query(
    "agg04_node_statistics",
    s(NODED + """, m AS (SELECT node_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz, avg(radius) AS radius FROM n WHERE radius <> 0 GROUP BY node_id),
    u AS (SELECT node_id, x, y, z, radius, nx / sqrt(nx * nx + ny * ny + nz * nz) AS nx, ny / sqrt(nx * nx + ny * ny + nz * nz) AS ny, nz / sqrt(nx * nx + ny * ny + nz * nz) AS nz FROM m)
    SELECT n.node_id, round(any_value(u.x), 5) AS m_x, round(any_value(u.nz), 5) AS m_nz, round(any_value(u.radius), 5) AS m_radius,
      round(sqrt(avg((n.x - u.x) ** 2 + (n.y - u.y) ** 2 + (n.z - u.z) ** 2)), 5) AS sd_pos,
      round(sqrt(avg((n.nx - u.nx) ** 2 + (n.ny - u.ny) ** 2 + (n.nz - u.nz) ** 2)), 5) AS sd_nor,
      round(sqrt(avg((n.radius - u.radius) ** 2)), 5) AS sd_rad FROM n JOIN u ON n.node_id = u.node_id GROUP BY n.node_id"""),
)
def node_statistics(spark, d) -> DataFrame:
    out = agg.node_statistics(noded(spark, d), "node_id")
    return rounded(out.select("node_id", "m_x", "m_nz", "m_radius", "sd_pos", "sd_nor", "sd_rad"), 5)


@query(
    "agg05_color_histogram",
    s(NODED + """ SELECT node_id, 'r' AS channel, CAST(r AS INTEGER) AS value, count(*) AS n FROM n GROUP BY 1, 3 UNION ALL
    SELECT node_id, 'g', CAST(g AS INTEGER), count(*) FROM n GROUP BY 1, 3 UNION ALL SELECT node_id, 'b', CAST(b AS INTEGER), count(*) FROM n GROUP BY 1, 3"""),
)
def color_histogram(spark, d) -> DataFrame:
    return agg.color_histogram(noded(spark, d), "node_id")


@query(
    "agg06_cluster_representative",
    s(NODED + """, m AS (SELECT node_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(nx) AS nx, avg(r) AS r, max(a) AS a FROM n GROUP BY node_id)
    SELECT n.node_id, round(any_value(m.x), 6) AS m_x, round(any_value(m.nx), 6) + 0.0 AS m_nx, round(any_value(m.r), 6) AS m_r, any_value(m.a) AS a,
      round(max(sqrt((n.x - m.x) ** 2 + (n.y - m.y) ** 2 + (n.z - m.z) ** 2) + radius), 6) AS radius FROM n JOIN m ON n.node_id = m.node_id GROUP BY n.node_id"""),
)
def cluster_representative(spark, d) -> DataFrame:
    return rounded(agg.cluster_representative(noded(spark, d), "node_id").select("node_id", "m_x", "m_nx", "m_r", "a", "radius"), 6)


@query(
    "agg07_boxes_up",
    s(""", l AS (SELECT 15 + l_partkey % 16 AS leaf, min(x) AS min_x, max(y) AS max_y, count(*) AS n FROM surfels GROUP BY 1),
    u AS (SELECT unnest([leaf, (leaf - 1) // 2, ((leaf - 1) // 2 - 1) // 2, (((leaf - 1) // 2 - 1) // 2 - 1) // 2, 0]) AS node_id, min_x, max_y, n FROM l)
    SELECT node_id, min(min_x) AS min_x, max(max_y) AS max_y, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY node_id"""),
)
def boxes_up(spark, d) -> DataFrame:
    leaves = surfels(spark, d).withColumn("node_id", 15 + F.col("l_partkey") % 16)
    boxes = agg.bounding_box(leaves, "node_id").join(leaves.groupBy("node_id").agg(F.count("*").alias("n")), "node_id")
    return agg.boxes_up(boxes, 2, 5).select("node_id", "min_x", "max_y", "n")


@query(
    "agg08_normal_deviation",
    s(NODED + """, m AS (SELECT node_id, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM n GROUP BY node_id),
    a AS (SELECT n.node_id, acos(greatest(-1.0, least(1.0, (nx * mx + ny * my + nz * mz) / sqrt(mx * mx + my * my + mz * mz)))) AS t FROM n JOIN m ON n.node_id = m.node_id)
    SELECT node_id, round(avg(t), 5) AS mad, round(sqrt(avg(t * t)), 5) AS sd, round(sqrt(avg(t * t)) / avg(t), 5) AS cv FROM a GROUP BY node_id"""),
)
def normal_deviation(spark, d) -> DataFrame:
    return rounded(agg.normal_deviation(noded(spark, d), "node_id"), 5)


def sparse(spark, d) -> DataFrame:
    """Orders as sparse points: the lines of an order are its measurements."""
    lines = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("idx"), F.struct((F.col("l_suppkey") % 50).cast("int").alias("camera"), F.col("l_quantity").alias("u"), F.col("l_tax").alias("v")).alias("m")
    )
    return lines.groupBy("idx").agg(F.collect_list("m").alias("measurements"))


@query(
    "agg09_distinct_images",
    "SELECT l_orderkey % 64 AS leaf, list_sort(list(DISTINCT CAST(l_suppkey % 50 AS INTEGER))) AS images FROM lineitem GROUP BY 1",
)
def distinct_images(spark, d) -> DataFrame:
    return agg.distinct_images(sparse(spark, d).withColumn("leaf", F.col("idx") % 64), "leaf")


@query(
    "agg10_leaf_metadata",
    """WITH p AS (SELECT o_custkey % 40 AS leaf, o_totalprice / 600000.0 AS ncc, o_orderkey % 9 AS s, o_orderkey % 7 AS t FROM orders)
    SELECT leaf, round(avg(ncc), 6) AS ncc, list_sort(list_distinct(list(s) || list(s + 1))) AS seen, list_sort(list_distinct(list(t + 100))) AS not_seen FROM p GROUP BY leaf""",
)
def leaf_metadata(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    p = o.select((F.col("o_custkey") % 40).alias("leaf"), (F.col("o_totalprice") / 600000.0).alias("ncc"), F.array(k % 9, k % 9 + 1).alias("seen"), F.array(k % 7 + 100).alias("not_seen"))
    return rounded(agg.leaf_metadata(p, "leaf"), 6)


def pixels(spark, d) -> DataFrame:
    """Lines as pixels: a cell, and a packed model and node."""
    t = read(spark, d, "lineitem")
    value = F.shiftleft((F.col("l_linenumber") % 5 + 251).cast("long"), 24) + F.col("l_partkey") % 200
    return t.select((F.col("l_suppkey") % 27).alias("cell_id"), value.alias("value"))


PIXELS = """px AS (SELECT l_suppkey % 27 AS cell_id, CAST(255 - (l_linenumber % 5 + 251) AS INTEGER) AS model_id, l_partkey % 200 AS node_id FROM lineitem)"""
VISIBLE = """, v AS (SELECT cell_id, model_id, node_id, count(*) AS n FROM px WHERE model_id <> 255 GROUP BY ALL)"""


@query("agg11_pixel_histogram", f"WITH {PIXELS} SELECT cell_id, model_id, node_id, count(*) AS n FROM px GROUP BY ALL")
def pixel_histogram(spark, d) -> DataFrame:
    return agg.pixel_histogram(pixels(spark, d), "cell_id")


@query("agg12_visible_nodes", f"WITH {PIXELS} SELECT cell_id, model_id, node_id, count(*) AS n FROM px GROUP BY ALL HAVING count(*) / 2000.0 * 100 >= 0.15")
def visible_nodes(spark, d) -> DataFrame:
    return agg.visible_nodes(agg.pixel_histogram(pixels(spark, d), "cell_id"), 2000, 0.15)


def seen(spark, d, threshold: int = 3) -> DataFrame:
    return agg.pixel_histogram(pixels(spark, d), "cell_id").where(F.col("n") >= threshold).select("cell_id", "model_id", "node_id")


SEEN = f"WITH {PIXELS}, seen AS (SELECT cell_id, model_id, node_id FROM px GROUP BY ALL HAVING count(*) >= 3)"


@query(
    "agg13_occlusion",
    SEEN + """, c AS (SELECT cell_id, count(*) AS n FROM seen GROUP BY cell_id), a AS (SELECT k AS cell_id, coalesce(n, 0) AS n FROM range(0, 27) AS t(k) LEFT JOIN c ON k = cell_id),
    o AS (SELECT (1 - n / 1000.0) * 100 AS share FROM a)
    SELECT greatest(0, least(9, CAST(round((share - 5.0) / 10.0) AS INTEGER))) AS bin, count(*) AS cells, round(avg(share), 6) AS mean_occlusion FROM o GROUP BY 1""",
)
def occlusion(spark, d) -> DataFrame:
    cells = spark.range(27).withColumnRenamed("id", "cell_id")
    return rounded(agg.occlusion_histogram(seen(spark, d), cells, 1000), 6)


@query(
    "agg14_compare_visibility",
    SEEN + """, one AS (SELECT *, 1 AS p FROM seen WHERE node_id % 3 <> 0), two AS (SELECT *, 1 AS q FROM seen WHERE node_id % 3 <> 1),
    j AS (SELECT cell_id, p, q FROM one FULL JOIN two USING (cell_id, model_id, node_id))
    SELECT cell_id, count(*) FILTER (WHERE p IS NOT NULL AND q IS NOT NULL) AS common, count(*) FILTER (WHERE q IS NULL) AS only_one, count(*) FILTER (WHERE p IS NULL) AS only_two
    FROM j GROUP BY cell_id""",
)
def compare_visibility(spark, d) -> DataFrame:
    v = seen(spark, d)
    return agg.compare_visibility(v.where("node_id % 3 <> 0"), v.where("node_id % 3 <> 1"))


def series(spark, d) -> DataFrame:
    """Events as series: a simulation per type, a step per day, a vertex per user."""
    return read(spark, d, "events").select(F.col("event_type").alias("sim"), F.dayofmonth("ts").alias("step"), F.col("user_id").alias("vertex"), "value")


SERIES = "WITH e AS (SELECT event_type AS sim, CAST(day(ts) AS INTEGER) AS step, user_id AS vertex, value FROM events)"


@query("agg15_series_extrema", SERIES + " SELECT sim, step, min(value) AS low, max(value) AS high FROM e GROUP BY GROUPING SETS ((sim, step), (sim))")
def series_extrema(spark, d) -> DataFrame:
    return agg.series_extrema(series(spark, d), "sim", "step", "value")


@query("agg16_series_counts", SERIES + " SELECT sim, count(DISTINCT step) AS steps, count(*) AS elements, max(vertex) + 1 AS vertices FROM e GROUP BY sim")
def series_counts(spark, d) -> DataFrame:
    return series(spark, d).groupBy("sim").agg(F.count_distinct("step").alias("steps"), F.count("*").alias("elements"), (F.max("vertex") + 1).alias("vertices"))


@query(
    "agg17_18_level_radius",
    s(NODED + """, m AS (SELECT node_id, node_id % 4 AS level, avg(radius) AS mean, stddev_pop(radius) AS sd FROM n WHERE radius > 0 GROUP BY 1, 2)
    SELECT level, round(avg(mean), 6) AS mean_radius, round(sum(sd) / count(*), 6) AS mean_deviation FROM m GROUP BY level"""),
)
def level_radius(spark, d) -> DataFrame:
    nodes = noded(spark, d).where("radius > 0").groupBy("node_id").agg(F.avg("radius").alias("mean"), F.stddev_pop("radius").alias("sd"))
    return rounded(nodes.groupBy((F.col("node_id") % 4).alias("level")).agg(F.avg("mean").alias("mean_radius"), F.avg("sd").alias("mean_deviation")), 6)


@query(
    "agg19_tile_delta_e",
    s(""", t AS (SELECT l_partkey % 32 AS tile, sqrt((r - g) * (r - g) + (g - b) * (g - b) * 1.0) AS e FROM surfels) SELECT tile, round(avg(e), 6) AS error FROM t GROUP BY tile"""),
)
def tile_delta_e(spark, d) -> DataFrame:
    e = F.sqrt((F.col("r") - F.col("g")) * (F.col("r") - F.col("g")) + (F.col("g") - F.col("b")) * (F.col("g") - F.col("b")) * 1.0)
    return rounded(surfels(spark, d).groupBy((F.col("l_partkey") % 32).alias("tile")).agg(F.avg(e).alias("error")), 6)


@query(
    "agg20_information_loss",
    s(NODED + """, m AS (SELECT node_id, avg(y) AS m FROM n GROUP BY node_id) SELECT round(avg(abs(y - m)), 6) AS loss FROM n JOIN m ON n.node_id = m.node_id"""),
)
def information_loss(spark, d) -> DataFrame:
    at = noded(spark, d)
    mean = at.groupBy("node_id").agg(F.avg("y").alias("m"))
    return rounded(at.join(mean, "node_id").agg(F.avg(F.abs(F.col("y") - F.col("m"))).alias("loss")), 6)


@query(
    "agg21_covariance",
    s(NODED + """ SELECT node_id, count(*) AS n, round(avg(x), 5) AS mx, round(covar_pop(x, x), 5) AS cxx, round(covar_pop(x, y), 5) + 0.0 AS cxy, round(covar_pop(y, z), 5) + 0.0 AS cyz, round(covar_pop(z, z), 5) AS czz
    FROM n GROUP BY node_id"""),
)
def covariance(spark, d) -> DataFrame:
    return rounded(agg.covariance(noded(spark, d), "node_id").select("node_id", "n", "mx", "cxx", "cxy", "cyz", "czz"), 5)


@query("agg22_plane_fit")
def plane_fit(spark, d) -> DataFrame:
    e = agg.smallest_eigenvectors(agg.covariance(noded(spark, d), "node_id"))
    return rounded(e.select("node_id", "l0", "l1", "l2", "ex", "ey", "ez"), 4)


@query(
    "agg23_mip_level",
    """WITH g AS (SELECT o_orderkey % 64 AS px, o_custkey % 64 AS py, CAST(sum(o_custkey % 256) AS BIGINT) AS value FROM orders GROUP BY 1, 2)
    SELECT CAST(1 AS INTEGER) AS level, px // 2 AS px, py // 2 AS py, CAST(sum(value) AS BIGINT) >> 2 AS value FROM g GROUP BY 2, 3""",
)
def mip_level(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    g = o.groupBy((F.col("o_orderkey") % 64).alias("px"), (F.col("o_custkey") % 64).alias("py")).agg(F.sum(F.col("o_custkey") % 256).alias("value"))
    return agg.mip_level(g.withColumn("level", F.lit(0)))


@query("win01_cumulative_histogram", s("SELECT CAST(r AS INTEGER) AS value, CAST(sum(count(*)) OVER (ORDER BY r) AS BIGINT) AS upto FROM surfels GROUP BY r"))
def cumulative_histogram(spark, d) -> DataFrame:
    h = agg.color_histogram(surfels(spark, d)).where("channel = 'r'")
    # 256 rows at most.
    return h.select("value", F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query(
    "win03_run_gaps",
    s(NODED + """, e AS (SELECT node_id, CAST(floor(x / 10) AS BIGINT) AS run, min(y) AS low, max(y) AS high FROM n GROUP BY 1, 2),
    g AS (SELECT node_id, run, (high + lead(low) OVER (PARTITION BY node_id ORDER BY run)) / 2 AS cut FROM e) SELECT * FROM g WHERE cut IS NOT NULL"""),
)
def run_gaps(spark, d) -> DataFrame:
    return agg.gaps(noded(spark, d).withColumn("run", F.floor(F.col("x") / 10)), "node_id", "run", "y")


# -- visibility --------------------------------------------------------------


@query("vis01_set_bits", SEEN + ", w AS (SELECT cell_id, model_id, node_id FROM seen UNION SELECT cell_id, 9, node_id FROM seen WHERE node_id < 20) SELECT * FROM w")
def set_bits(spark, d) -> DataFrame:
    v = seen(spark, d)
    return vis.with_bits(v, v.where("node_id < 20").withColumn("model_id", F.lit(9)))


@query("vis02_visible_ids", SEEN + " SELECT cell_id, model_id, list_sort(list(node_id)) AS nodes FROM seen GROUP BY 1, 2")
def visible_ids(spark, d) -> DataFrame:
    return vis.visible_ids(seen(spark, d))


@query(
    "vis03_propagate",
    SEEN.replace("WITH ", "WITH RECURSIVE ", 1) + """, up AS (SELECT cell_id, model_id, node_id FROM seen UNION SELECT cell_id, model_id, (node_id - 1) // 2 FROM up WHERE node_id > 0),
    down AS (SELECT cell_id, model_id, node_id FROM seen UNION SELECT cell_id, model_id, 2 * node_id + 1 + k FROM down, range(0, 2) AS t(k) WHERE 2 * node_id + 1 + k < 255)
    SELECT cell_id, model_id, node_id FROM up UNION SELECT cell_id, model_id, node_id FROM down""",
)
def propagate(spark, d) -> DataFrame:
    return vis.propagated(seen(spark, d), 2, 7)


@query(
    "vis04_collapse",
    SEEN + """, c AS (SELECT k AS cell_id, CASE WHEN k > 0 THEN (k - 1) // 8 END AS parent_id FROM range(1, 27) AS t(k)),
    j AS (SELECT parent_id, c.cell_id, model_id, node_id FROM c LEFT JOIN seen ON c.cell_id = seen.cell_id),
    u AS (SELECT parent_id, count(DISTINCT model_id * 1000 + node_id) AS total FROM j GROUP BY 1),
    w AS (SELECT parent_id, min(n) AS least FROM (SELECT parent_id, cell_id, count(node_id) AS n FROM j GROUP BY 1, 2) GROUP BY 1)
    SELECT parent_id FROM u JOIN w USING (parent_id) WHERE total = 0 OR least >= 0.1 * total""",
)
def collapse(spark, d) -> DataFrame:
    cells = spark.range(1, 27).select(F.col("id").alias("cell_id"), tree.parent(F.col("id"), 8).alias("parent_id"))
    return vis.collapsed_cells(seen(spark, d), cells, 0.1)


@query("vis05_irregular_merge")
def irregular_merge(spark, d) -> DataFrame:
    return vis.merged_cells(seen(spark, d), 0.75, 1000)


@query(
    "vis06_hoist",
    SEEN + """, p AS (SELECT *, (cell_id - 1) // 8 AS parent FROM seen WHERE cell_id > 0),
    up AS (SELECT parent, model_id, node_id FROM p GROUP BY ALL HAVING count(*) >= 2)
    SELECT cell_id, model_id, node_id FROM seen WHERE NOT EXISTS (SELECT 1 FROM up WHERE seen.cell_id > 0 AND up.parent = (seen.cell_id - 1) // 8 AND up.model_id = seen.model_id AND up.node_id = seen.node_id)
    UNION SELECT parent, model_id, node_id FROM up""",
)
def hoist(spark, d) -> DataFrame:
    return vis.hoisted(seen(spark, d), 0.25)


@query(
    "vis11_inherited",
    SEEN + """, l AS (SELECT k AS cell_id FROM range(9, 27) AS t(k)), h AS (SELECT cell_id, unnest([cell_id, (cell_id - 1) // 8, 0]) AS holder FROM l)
    SELECT DISTINCT h.cell_id, model_id, node_id FROM h JOIN seen ON seen.cell_id = h.holder""",
)
def inherited(spark, d) -> DataFrame:
    leaves = spark.range(9, 27).withColumnRenamed("id", "cell_id")
    return vis.inherited(seen(spark, d), leaves, 3)


@query(
    "vis07_pack_words",
    SEEN + " SELECT cell_id, model_id, CAST(node_id // 64 AS BIGINT) AS word, CAST(bit_or(CASE WHEN node_id % 64 = 63 THEN (-9223372036854775807 - 1) ELSE 1::BIGINT << CAST(node_id % 64 AS INTEGER) END) AS BIGINT) AS bits FROM seen GROUP BY 1, 2, 3",
)
def pack_words(spark, d) -> DataFrame:
    return vis.packed_cells(seen(spark, d), 4)


@query("vis07_unpack_words", SEEN + " SELECT cell_id, model_id, CAST(node_id AS BIGINT) AS node_id FROM seen")
def unpack_words(spark, d) -> DataFrame:
    return vis.unpacked_cells(vis.packed_cells(seen(spark, d), 4))


@query(
    "vis08_extrapolate",
    SEEN + """, b AS (SELECT DISTINCT CAST(cell_id % 6 AS INTEGER) AS direction, model_id, node_id FROM seen),
    c AS (SELECT CAST(9 * (1 + sz) + 3 * (1 + sy) + 1 + sx AS INTEGER) AS cell_id, sx, sy, sz FROM range(-1, 2) AS a(sx), range(-1, 2) AS e(sy), range(-1, 2) AS f(sz)),
    m AS (SELECT cell_id, CASE WHEN sx > 0 THEN 1 ELSE 0 END AS direction FROM c WHERE sx <> 0 UNION SELECT cell_id, CASE WHEN sy > 0 THEN 3 ELSE 2 END FROM c WHERE sy <> 0
      UNION SELECT cell_id, CASE WHEN sz > 0 THEN 5 ELSE 4 END FROM c WHERE sz <> 0)
    SELECT DISTINCT cell_id, model_id, node_id FROM m JOIN b USING (direction)""",
)
def extrapolate(spark, d) -> DataFrame:
    return vis.extrapolated(seen(spark, d).select((F.col("cell_id") % 6).cast("int").alias("direction"), "model_id", "node_id").distinct())


@query("vis09_sampled_visibility")
def sampled_visibility(spark, d) -> DataFrame:
    from lodestone.plans.join_queries import part_boxes

    k = F.col("id")
    cells = spark.range(8).select(k.alias("cell_id"), (k % 2 * 50.0).alias("lx"), (45.0 + F.floor(k / 2) % 2 * 30.0).alias("ly"), (F.floor(k / 4) * 50.0).alias("lz"), F.lit(40.0).alias("edge"))
    return vis.sampled_visibility(cells, part_boxes(spark, d), 16)


@query(
    "src22_atlas_level",
    """SELECT o_orderkey AS tile_id, o_totalprice AS payload, CAST(list_sum(list_transform(range(0, 5), lambda i: (((o_orderkey - 341) >> (2 * i)) & 1) << i)) AS BIGINT) AS x,
      CAST(list_sum(list_transform(range(0, 5), lambda i: (((o_orderkey - 341) >> (2 * i + 1)) & 1) << i)) AS BIGINT) AS y FROM orders WHERE o_orderkey BETWEEN 341 AND 1364""",
)
def atlas_level(spark, d) -> DataFrame:
    return vis.atlas_level(read(spark, d, "orders").select(F.col("o_orderkey").alias("tile_id"), F.col("o_totalprice").alias("payload")), 5)


@query("vis10_cell_data", SEEN + " SELECT cell_id, model_id, node_id FROM seen WHERE cell_id = 13")
def cell_data(spark, d) -> DataFrame:
    return seen(spark, d).where("cell_id = 13")


@query(
    "set02_bitset_ops",
    SEEN + """, a AS (SELECT model_id, node_id FROM seen WHERE cell_id = 3), b AS (SELECT model_id, node_id FROM seen WHERE cell_id = 4)
    SELECT 'or' AS op, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'and', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'minus', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def bitset_ops(spark, d) -> DataFrame:
    v = seen(spark, d)
    a, b = (v.where(F.col("cell_id") == c).select("model_id", "node_id") for c in (3, 4))
    out = [a.union(b).distinct(), a.intersect(b), a.exceptAll(b)]
    tagged = [df.select(F.lit(op).alias("op"), "*") for op, df in zip(("or", "and", "minus"), out, strict=True)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("set04_distinct_images", "SELECT DISTINCT CAST(l_suppkey % 50 AS INTEGER) AS camera FROM lineitem")
def distinct_cameras(spark, d) -> DataFrame:
    return sparse(spark, d).select(F.explode("measurements.camera").alias("camera")).distinct()


@query("set05_siblings", f"WITH {PARTS_SQL} SELECT node, pid, count(*) OVER (PARTITION BY node) AS siblings FROM parts")
def siblings(spark, d) -> DataFrame:
    return parts(spark, d).select("node", "pid", F.count("*").over(Window.partitionBy("node")).alias("siblings"))


# -- attributes of grids and series -------------------------------------------


@query(
    "att08_histogram_match",
    s(""", a AS (SELECT l_partkey % 4 AS depth, pid, r FROM surfels), b AS (SELECT l_partkey % 4 AS depth, g AS r FROM surfels),
    ha AS (SELECT depth, r, sum(count(*)) OVER (PARTITION BY depth ORDER BY r) / sum(count(*)) OVER (PARTITION BY depth) AS share FROM a GROUP BY depth, r),
    hb AS (SELECT depth, r AS too, sum(count(*)) OVER (PARTITION BY depth ORDER BY r) / sum(count(*)) OVER (PARTITION BY depth) AS share FROM b GROUP BY depth, r),
    t AS (SELECT ha.depth, ha.r, min(too) AS too FROM ha JOIN hb ON ha.depth = hb.depth AND hb.share >= ha.share - 1e-12 GROUP BY 1, 2)
    SELECT pid, CAST(round(a.r * 0.25 + too * 0.75) AS BIGINT) AS r FROM a JOIN t ON a.depth = t.depth AND a.r = t.r"""),
)
def histogram_match(spark, d) -> DataFrame:
    from lodestone.operators.attributes import histogram_matched

    at = surfels(spark, d).withColumn("depth", F.col("l_partkey") % 4)
    return histogram_matched(at, at.withColumn("r", F.col("g")), "depth", 0.75).select("pid", "r")


@query(
    "att10_magnitudes",
    SERIES + """, u AS (SELECT sim, step, vertex, value AS x, value * 0.5 AS y, vertex / 100.0 AS z FROM e)
    SELECT sim, step, vertex, round(sqrt(x * x + y * y + z * z), 7) AS mag_u, round(0.6 * x - 0.8 * y + 0.0, 7) + 0.0 AS u_x FROM u""",
)
def magnitudes(spark, d) -> DataFrame:
    from lodestone.operators.attributes import magnitudes as op
    from lodestone.plans.scalar_queries import FRAME

    u = series(spark, d).select("sim", "step", "vertex", F.col("value").alias("u_x"), (F.col("value") * 0.5).alias("u_y"), (F.col("vertex") / 100.0).alias("u_z"))
    return rounded(op(u, FRAME).select("sim", "step", "vertex", "mag_u", "u_x"), 7)
