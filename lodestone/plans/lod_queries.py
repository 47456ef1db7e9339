"""Queries of splits, trees, reductions, cuts and meshes over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geometry as geo
from lodestone.functions import tree
from lodestone.model import PARTS_SQL, SURFELS_SQL, parts, read, rounded, surfels
from lodestone.operators import aggregates as agg
from lodestone.operators import mesh, partition, reductions
from lodestone.operators import visibility as vis
from lodestone.plans.registry import query

AXES = geo.AXES


def s(body: str) -> str:
    return f"WITH {SURFELS_SQL} {body}"


AXIS_SQL = "CASE WHEN {h}x - {l}x >= {h}y - {l}y AND {h}x - {l}x >= {h}z - {l}z THEN x WHEN {h}y - {l}y >= {h}z - {l}z THEN y ELSE z END"


def levels_sql(depth: int, source: str = "surfels") -> str:
    """CTEs t0 .. t<depth> of the downsweep: a window per level, as the plain definition."""
    out = [f"t0 AS (SELECT *, CAST(0 AS BIGINT) AS node_id FROM {source})"]
    for i in range(depth):
        box = "max(x) OVER w - min(x) OVER w AS ex, max(y) OVER w - min(y) OVER w AS ey, max(z) OVER w - min(z) OVER w AS ez"
        out.append(f"b{i} AS (SELECT *, {box} FROM t{i} WINDOW w AS (PARTITION BY node_id))")
        out.append(f"v{i} AS (SELECT *, CASE WHEN ex >= ey AND ex >= ez THEN x WHEN ey >= ez THEN y ELSE z END AS v FROM b{i})")
        out.append(f"t{i + 1} AS (SELECT * EXCLUDE (ex, ey, ez, v, node_id), node_id * 2 + ntile(2) OVER (PARTITION BY node_id ORDER BY v, pid) AS node_id FROM v{i})")
    return ", ".join(out)


@query(
    "min_slice_nodes",
    s(""", f AS (SELECT * FROM surfels WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND NOT (x = 0 AND y = 0 AND z = 0)),
    t AS (SELECT floor((min(x) + max(x)) / 2) AS tx, floor((min(y) + max(y)) / 2) AS ty, floor((min(z) + max(z)) / 2) AS tz FROM f),
    c AS (SELECT pid, x - tx AS x, y - ty AS y, z - tz AS z, nx, ny, nz, radius FROM f, t),
    e AS (SELECT max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM c),
    r AS (SELECT c.*, ntile(4) OVER (ORDER BY CASE WHEN ex >= ey AND ex >= ez THEN x WHEN ey >= ez THEN y ELSE z END, pid) AS node_id FROM c, e)
    SELECT node_id, count(*) AS n, round(avg(CASE WHEN radius > 0 THEN radius END), 6) AS avg_radius, round(avg(CASE WHEN radius > 0 THEN x END), 6) + 0.0 AS cx,
      round(min(CASE WHEN radius > 0 THEN x - abs(radius - radius * nx * nx) ELSE x END), 6) + 0.0 AS min_x, round(max(CASE WHEN radius > 0 THEN x + abs(radius - radius * nx * nx) ELSE x END), 6) + 0.0 AS max_x
    FROM r GROUP BY node_id"""),
)
def min_slice_nodes(spark, d) -> DataFrame:
    """Filter, centre, split once along the longest axis, and describe each part."""
    p = geo.vec("x", "y", "z")
    cloud = surfels(spark, d).where(geo.finite(*p) & ~geo.every(*(c == 0 for c in p)))
    at = partition.centered(cloud.select("pid", *AXES, "nx", "ny", "nz", "radius"))
    box = at.agg(*(f(c).alias(f"_{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in AXES))
    axis = partition.longest_axis(geo.vec("_lx", "_ly", "_lz"), geo.vec("_hx", "_hy", "_hz"))
    at = at.join(F.broadcast(box.select(axis.alias("axis"))), F.lit(True))  # one row
    at = at.withColumn("v", F.when(F.col("axis") == 0, F.col("x")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("z"))).withColumn("root", F.lit(0))
    runs = partition.split_runs(at, "root", "v", 4).withColumn("node_id", F.col("run") + 1)
    out = agg.node_properties(runs, "node_id")
    return rounded(out.select("node_id", "n", "avg_radius", "cx", "min_x", "max_x"), 6)


@query("srt01_rank_by_axis", s("SELECT pid, row_number() OVER (ORDER BY y, pid) AS rank FROM surfels"))
def rank_by_axis(spark, d) -> DataFrame:
    at = surfels(spark, d).select("pid", "y").withColumn("all", F.lit(0))
    return partition.ranked(at, "all", "y").select("pid", "rank")


@query("srt03_split_runs", s("SELECT pid, l_partkey % 5 AS node, CAST(ntile(7) OVER (PARTITION BY l_partkey % 5 ORDER BY y, pid) - 1 AS BIGINT) AS run FROM surfels"))
def split_runs(spark, d) -> DataFrame:
    at = surfels(spark, d).withColumn("node", F.col("l_partkey") % 5)
    return partition.split_runs(at, "node", "y", 7).select("pid", "node", "run")


@query("srt04_downsweep", s(f", {levels_sql(4)} SELECT pid, node_id FROM t4"))
def downsweep(spark, d) -> DataFrame:
    return partition.downsweep(surfels(spark, d).select("pid", *AXES), 4).select("pid", "node_id")


@query(
    "srt05_tree_size",
    s(""", n AS (SELECT count(*) AS n FROM surfels), c AS (SELECT n, CAST(unnest([64, 256, 1024, 4096]) AS INTEGER) AS k FROM n), f AS (SELECT n, k, CAST(unnest(range(2, 9)) AS INTEGER) AS fan FROM c),
    d AS (SELECT n, k, fan, len(list_filter(range(0, 64), lambda i: n / pow(fan, i) > k)) AS depth FROM f), e AS (SELECT n, k, fan, CAST(unnest([depth, greatest(depth - 1, 0)]) AS INTEGER) AS depth FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(k - n / pow(fan, depth)), fan, depth) AS rn FROM e) SELECT n, k AS surfels_per_node, fan, depth FROM r WHERE rn = 1"""),
)
def tree_size(spark, d) -> DataFrame:
    n = surfels(spark, d).count()
    return spark.createDataFrame([(n, k, *partition.choose_tree(n, k, 8)) for k in (64, 256, 1024, 4096)], "n long, surfels_per_node int, fan int, depth int")


@query("srt06_axes", s(""", b AS (SELECT l_partkey % 16 AS node, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM surfels GROUP BY 1)
    SELECT node, CASE WHEN ex >= ey AND ex >= ez THEN 0 WHEN ey >= ez THEN 1 ELSE 2 END AS longest, CASE WHEN ex <= ey AND ex <= ez THEN 0 WHEN ey <= ez THEN 1 ELSE 2 END AS shortest FROM b"""))
def axes(spark, d) -> DataFrame:
    b = agg.bounding_box(surfels(spark, d).withColumn("node", F.col("l_partkey") % 16), "node")
    low, high = (geo.vec(*(f"{m}_{c}" for c in AXES)) for m in ("min", "max"))
    return b.select("node", partition.longest_axis(low, high).alias("longest"), partition.shortest_axis(low, high).alias("shortest"))


@query(
    "srt09_grid_cells",
    s(""", b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(1, ceil((max(x) - min(x)) / 7.0)) AS nx_, greatest(1, ceil((max(y) - min(y)) / 7.0)) AS ny_, greatest(1, ceil((max(z) - min(z)) / 7.0)) AS nz_ FROM surfels)
    SELECT pid, CAST((least(floor((z - lz) / 7.0), nz_ - 1) * ny_ + least(floor((y - ly) / 7.0), ny_ - 1)) * nx_ + least(floor((x - lx) / 7.0), nx_ - 1) AS BIGINT) AS cell FROM surfels, b"""),
)
def grid_cells(spark, d) -> DataFrame:
    return partition.grid_cells(surfels(spark, d).select("pid", *AXES), 7.0).select("pid", "cell")


@query("srt10_balanced_split")
def balanced_split(spark, d) -> DataFrame:
    out = partition.balanced_split(surfels(spark, d).select("pid", *AXES), 12)
    return out.groupBy("part").agg(F.count("*").alias("n"))


def halved_sql(levels: int, most: int) -> str:
    """CTEs h0 .. h<levels>: a part with more than ``most`` rows is halved on its longest axis."""
    out = ["h0 AS (SELECT pid, x, y, z, CAST(1 AS BIGINT) AS part FROM parts)"]
    for i in range(levels):
        box = "max(x) OVER w - min(x) OVER w AS ex, max(y) OVER w - min(y) OVER w AS ey, max(z) OVER w - min(z) OVER w AS ez, count(*) OVER w AS n"
        out.append(f"i{i} AS (SELECT *, {box} FROM h{i} WINDOW w AS (PARTITION BY part))")
        out.append(f"j{i} AS (SELECT *, CASE WHEN ex >= ey AND ex >= ez THEN x WHEN ey >= ez THEN y ELSE z END AS v FROM i{i})")
        out.append(f"h{i + 1} AS (SELECT pid, x, y, z, CASE WHEN n > {most} THEN part * 2 + ntile(2) OVER (PARTITION BY part ORDER BY v, pid) - 1 ELSE part END AS part FROM j{i})")
    return ", ".join(out)


@query("srt11_halved", f"WITH {PARTS_SQL}, {halved_sql(12, 300)} SELECT pid, part FROM h12")
def halved(spark, d) -> DataFrame:
    out = partition.halved(parts(spark, d).select("pid", *AXES), 300)
    return out.select("pid", "part")


_CELL = ", ".join(f"CAST(greatest(0, least((1 << dep) - 1, floor((p.{c} - l{c}) / e * (1 << dep)))) AS BIGINT) AS i{c}" for c in AXES)
_BITS = " + ".join(f"((((i{c} >> (dep - level)) >> CAST(i AS INTEGER)) & 1) << CAST(3 * i + {k} AS INTEGER))" for k, c in enumerate(AXES))
_CENTER = ", ".join(f"round(l{c} + ((i{c} >> (dep - level)) + 0.5) * (e / pow(2, level)), 5) + 0.0 AS {c}" for c in AXES)


@query(
    "srt14_regularized",
    s(f""", b AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM surfels),
    c AS (SELECT e, mx - e / 2 AS lx, my - e / 2 AS ly, mz - e / 2 AS lz, CAST(len(list_filter(range(0, 20), lambda i: e / pow(2, i) > 4.0)) AS INTEGER) AS dep FROM b),
    k AS (SELECT p.pid, c.*, {_CELL} FROM surfels p, c), u AS (SELECT k.*, CAST(unnest(range(0, dep + 1)) AS INTEGER) AS level FROM k),
    v AS (SELECT *, count(*) OVER (PARTITION BY level, ix >> (dep - level), iy >> (dep - level), iz >> (dep - level)) AS n FROM u),
    w AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY level) AS rn FROM v WHERE n <= 1 OR level = dep),
    m AS (SELECT level, n, {_CENTER}, coalesce(CAST(list_sum(list_transform(range(0, level), lambda i: {_BITS})) AS BIGINT), 0) AS leaf FROM w WHERE rn = 1)
    SELECT DISTINCT level, leaf, n, x, y, z, 4.0 AS radius FROM m"""),
)
def regularized(spark, d) -> DataFrame:
    return rounded(partition.regularized(surfels(spark, d), 4.0).select("level", "leaf", "n", *AXES, "radius"), 5)


@query("srt15_16_triangle_tree")
def triangle_tree(spark, d) -> DataFrame:
    from lodestone.plans.join_queries import triangles

    return mesh.triangle_tree(triangles(spark, d), vertices(spark, d), 3).select("pid", "node_id")


def vertices(spark, d) -> DataFrame:
    """600 vertices on three sheets."""
    v = F.col("id")
    return spark.range(600).select(v.alias("vid"), (v % 20 * 1.0).alias("x"), (F.floor(v / 20) % 10 * 1.0).alias("y"), (F.floor(v / 200) + F.sin(v * 1.0)).alias("z"))


@query("srt17_budget", "SELECT o_orderkey AS tile_id, o_totalprice AS priority, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS slot FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def budget(spark, d) -> DataFrame:
    return vis.tile_cut(read(spark, d, "orders").select(F.col("o_orderkey").alias("tile_id"), F.col("o_totalprice").alias("priority")), 100)


@query("srt18_packing")
def packing(spark, d) -> DataFrame:
    r = read(spark, d, "part").select((F.col("p_partkey") % 4).alias("page"), F.col("p_partkey").alias("rect_id"), (F.col("p_size") + 4).cast("long").alias("w"), (F.col("p_size") % 9 + 2).cast("long").alias("h"))
    return mesh.packed(r, "page", 256)


@query(
    "red04_every_second",
    s(""", n AS (SELECT *, l_partkey % 8 AS node_id, l_suppkey % 2 AS child FROM surfels), k AS (SELECT *, row_number() OVER (PARTITION BY node_id, child ORDER BY pid) - 1 AS rn FROM n)
    SELECT pid, node_id, child, radius * sqrt(1.5) AS radius FROM k WHERE rn >= child AND (rn - child) % 2 = 0"""),
)
def every_second(spark, d) -> DataFrame:
    at = surfels(spark, d).withColumn("node_id", F.col("l_partkey") % 8).withColumn("child", F.col("l_suppkey") % 2)
    return reductions.every_second(at, 2).select("pid", "node_id", "child", "radius")


@query(
    "red05_random",
    s(""", n AS (SELECT *, l_partkey % 32 AS node_id FROM surfels WHERE radius > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ((pid % 4294967296) * 2654435 + 7) % 4294967291, pid) AS rn FROM n) SELECT pid, node_id FROM k WHERE rn <= 128"""),
)
def random(spark, d) -> DataFrame:
    return reductions.random_sample(surfels(spark, d).withColumn("node_id", F.col("l_partkey") % 32), 128).select("pid", "node_id")


def _reduction(number: str, name: str, budget: int = 12) -> None:
    @query(f"{number}_{name}")
    def run(spark, d) -> DataFrame:
        p = parts(spark, d).withColumn("node_id", F.floor(F.col("pid") / 64)).withColumn("radius", F.col("radius") * 2)
        unit = F.sqrt(1 + (F.col("pid") % 3) * (F.col("pid") % 3) * 1.0)
        p = p.withColumns({"nx": (F.col("pid") % 3) / unit, "ny": F.lit(0.0), "nz": 1.0 / unit})
        return rounded(reductions.reduce_level(p, name, budget, seed=5), 4)


for _number, _name in (
    ("red01", "normal_deviation"), ("red03", "constant"), ("red06", "spatial_random"), ("red07", "entropy"), ("red08", "particles"), ("red09", "hierarchical"),
    ("red10", "hierarchical_extended"), ("red11", "hierarchical_normal"), ("red12", "k_clustering"), ("red13", "pair_contraction"), ("red14", "region_growing"),
):
    _reduction(_number, _name)


@query("red02_normal_deviation_provenance")
def normal_deviation_provenance(spark, d) -> DataFrame:
    p = parts(spark, d).withColumn("node_id", F.floor(F.col("pid") / 64)).withColumn("mad", F.col("radius") / 10)
    p = p.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.6), "nz": F.lit(0.8)})
    return rounded(reductions.reduce_level(p, "normal_deviation_provenance", 12, attributes=("mad",)), 4)


@query("red15_interpolation")
def interpolation(spark, d) -> DataFrame:
    from lodestone.operators.attributes import interpolated

    p = parts(spark, d).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.6), "nz": F.lit(0.8)})
    return rounded(interpolated(p, "node"), 4)


@query("red16_mesh_simplification")
def mesh_simplification(spark, d) -> DataFrame:
    from lodestone.plans.join_queries import triangles

    t = triangles(spark, d).withColumn("grp", F.pmod(F.xxhash64("tri_id"), F.lit(64)))
    return rounded(mesh.simplified(t, vertices(spark, d), "grp"), 4)


@query("red17_charts")
def charts(spark, d) -> DataFrame:
    from lodestone.plans.join_queries import triangles

    t = triangles(spark, d).withColumn("grp", F.pmod(F.xxhash64("a"), F.lit(64)))
    n = t.select("tri_id", (F.col("tri_id") % 5 + 1.0).alias("area"), F.lit(0.0).alias("nx"), F.when(F.col("tri_id") % 2 == 0, 0.6).otherwise(0.0).alias("ny"), F.when(F.col("tri_id") % 2 == 0, 0.8).otherwise(1.0).alias("nz"))
    return mesh.charts(t, n, "grp", 0.05)


@query("red18_grid_charts")
def grid_charts(spark, d) -> DataFrame:
    at = surfels(spark, d).select("pid", *AXES, "nx", "ny", "nz", (F.col("radius") + 0.1).alias("area"))
    return mesh.grid_charts(at, 4, 0.02)


@query("flt13_mesh_cleaning")
def mesh_cleaning(spark, d) -> DataFrame:
    from lodestone.plans.join_queries import triangles

    return mesh.cleaned(triangles(spark, d), vertices(spark, d), least_faces=1)[0]


@query("att11_surface_samples")
def surface_samples(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    t = read(spark, d, "part").select(
        k.alias("tri_id"), (k % 10 * 1.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"), (k % 10 + 1.0).alias("bx"), F.lit(0.0).alias("by"), F.lit(1.0).alias("bz"),
        (k % 10 * 1.0).alias("cx"), F.lit(1.0).alias("cy"), F.lit(0.0).alias("cz"), F.lit(0.1).alias("as"), F.lit(0.1).alias("at"), F.lit(0.4).alias("bs"), F.lit(0.1).alias("bt"), F.lit(0.1).alias("cs"), F.lit(0.5).alias("ct"),
    )
    return rounded(mesh.sampled(t, 32), 6)


@query(
    "cut01_lod_cut",
    f"""WITH {PARTS_SQL}, n AS (SELECT pid - 1 AS node_id, 64.0 / (1 + length(bin(pid)) * length(bin(pid))) + (pid % 7) / 10.0 AS error, pid % 11 <> 0 AS visible FROM parts),
    j AS (SELECT n.node_id, n.error, n.visible, p.error AS pe, p.visible AS pv, EXISTS (SELECT 1 FROM n c WHERE c.node_id > 0 AND (c.node_id - 1) // 2 = n.node_id) AS inr
      FROM n LEFT JOIN n p ON n.node_id > 0 AND p.node_id = (n.node_id - 1) // 2)
    SELECT node_id, error FROM j WHERE (pe IS NULL OR (pe > 2.5 AND pv)) AND (error <= 2.5 OR NOT inr OR NOT visible)""",
)
def lod_cut(spark, d) -> DataFrame:
    return vis.lod_cut(errors(spark, d), 2.5, 2)


def errors(spark, d) -> DataFrame:
    bits = F.length(F.bin("pid"))
    return parts(spark, d).select((F.col("pid") - 1).alias("node_id"), (64.0 / (1 + bits * bits) + (F.col("pid") % 7) / 10.0).alias("error"), (F.col("pid") % 11 != 0).alias("visible"))


@query(
    "cut01_actions",
    f"""WITH {PARTS_SQL}, n AS (SELECT pid - 1 AS node_id, 64.0 / (1 + length(bin(pid)) * length(bin(pid))) + (pid % 7) / 10.0 AS error, pid % 11 <> 0 AS visible FROM parts)
    SELECT node_id, CASE WHEN visible AND error > 2.6 AND error / 2 >= 2.4 THEN 'split' WHEN NOT visible OR error < 2.4 THEN 'collapse' ELSE 'keep' END AS action FROM n""",
)
def cut_actions(spark, d) -> DataFrame:
    return vis.cut_actions(errors(spark, d).withColumn("child_error", F.col("error") / 2), 2.5).select("node_id", "action")


@query("cut02_scheduler")
def scheduler(spark, d) -> DataFrame:
    from lodestone.streaming.cut_scheduler import schedule

    frames = errors(spark, d).select("node_id", "error", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("frame"))
    views = frames.withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("error", F.col("error") * (1 + F.col("frame")) / (1 + F.col("view_id")))
    return schedule(views.select(*(F.col(c).cast(t) for c, t in (("view_id", "long"), ("frame", "long"), ("node_id", "long"), ("error", "double")))), 2, 2.5, 64)


@query(
    "cut03_collapsible_tiles",
    """WITH t AS (SELECT DISTINCT o_custkey AS tile_id FROM orders WHERE o_custkey > 0), p AS (SELECT (tile_id - 1) // 4 AS parent_id, tile_id % 13 = 0 AS wanted FROM t)
    SELECT parent_id FROM p GROUP BY parent_id HAVING count(*) = 4 AND count(*) FILTER (WHERE wanted) = 0""",
)
def collapsible_tiles(spark, d) -> DataFrame:
    t = read(spark, d, "orders").select(F.col("o_custkey").alias("tile_id")).distinct()
    return vis.collapsible_tiles(t, F.col("tile_id") % 13 == 0)


@query("snk09_extract_depth", s(f", {levels_sql(3)} SELECT pid, node_id, x + 5.0 AS x FROM t3 WHERE radius > 0"))
def extract_depth(spark, d) -> DataFrame:
    from lodestone.sources.structured import extract_depth as op

    at = partition.downsweep(surfels(spark, d).select("pid", *AXES, "radius"), 3)
    return op(at, 3, 2, (5.0, 0.0, 0.0)).select("pid", "node_id", "x")


@query("tree_leaf_boxes", s(f", {levels_sql(3)} SELECT node_id, count(*) AS n, min(x) AS min_x, max(y) AS max_y, (node_id - 1) // 2 AS parent FROM t3 GROUP BY node_id"))
def tree_leaf_boxes(spark, d) -> DataFrame:
    at = partition.downsweep(surfels(spark, d).select("pid", *AXES), 3)
    out = at.groupBy("node_id").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("y").alias("max_y"))
    return out.withColumn("parent", tree.parent(F.col("node_id"), 2))
