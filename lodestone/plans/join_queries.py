"""Queries of neighbours, spatial joins, rays and photogrammetry joins over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geometry as geo
from lodestone.model import ORDERS_SQL, PARTS_SQL, SURFELS_SQL, orders_cloud, parts, read, rounded, surfels
from lodestone.operators import attributes as att
from lodestone.operators import joins
from lodestone.operators import neighbors as near
from lodestone.operators import partition
from lodestone.operators.vectors import nearest_vector
from lodestone.plans.registry import query

AXES = geo.AXES
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
KNN = f"""knn AS (SELECT * FROM (SELECT a.pid, b.pid AS neighbor, {D2} AS d2, CAST(row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS INTEGER) AS rank
  FROM parts a JOIN parts b ON a.pid <> b.pid) WHERE rank <= 10)"""
#: Means of sums that do not depend on the order of rows.
MEAN = "m AS (SELECT pid, CAST(sum(CAST(d2 AS DECIMAL(28, 9))) AS DOUBLE) / count(*) AS mean_d2 FROM knn GROUP BY pid)"
LOCAL = f"""loc AS (SELECT * FROM (SELECT a.node, a.pid, b.pid AS neighbor, {D2} AS d2, CAST(row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS INTEGER) AS rank
  FROM parts a JOIN parts b ON a.node = b.node AND a.pid <> b.pid) WHERE rank <= 10)"""


@query("jn01_knn", f"WITH {PARTS_SQL}, {KNN} SELECT pid, neighbor, round(d2, 6) AS d2, rank FROM knn WHERE rank <= 8")
def knn(spark, d) -> DataFrame:
    p = parts(spark, d)
    return rounded(near.knn(p, p, 8, same=True), 6)


@query("jn02_04_knn_in_node", f"WITH {PARTS_SQL}, {LOCAL} SELECT node, pid, neighbor, round(d2, 6) AS d2, rank FROM loc WHERE rank <= 6")
def knn_in_node(spark, d) -> DataFrame:
    return rounded(near.knn_in_group(parts(spark, d), "node", 6), 6)


@query(
    "jn03_knn_in_nodes",
    f"""WITH {PARTS_SQL}, k AS (SELECT * FROM (SELECT a.pid, b.pid AS neighbor, CAST(row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS INTEGER) AS rank
      FROM parts a JOIN parts b ON a.pid <> b.pid WHERE b.node IN (1, 4, 6)) WHERE rank <= 4) SELECT pid, neighbor, rank FROM k""",
)
def knn_in_nodes(spark, d) -> DataFrame:
    p = parts(spark, d)
    return near.knn(p, p.where(F.col("node").isin(1, 4, 6)), 4, same=True).select("pid", "neighbor", "rank")


@query(
    "jn05_transfer",
    f"""WITH {PARTS_SQL}, {ORDERS_SQL}, k AS (SELECT a.pid, b.pid AS neighbor, b.r, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM cloud2 a, parts b)
    SELECT pid, neighbor, r FROM k WHERE rank = 1""",
)
def transfer(spark, d) -> DataFrame:
    return near.transfer(orders_cloud(spark, d), parts(spark, d), ["r"])


@query(
    "jn06_transfer_by_depth",
    f"""WITH {PARTS_SQL}, {ORDERS_SQL}, k AS (SELECT a.pid, a.r % 4 AS depth, b.r, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM cloud2 a, parts b)
    SELECT pid, round(coalesce(avg(CASE WHEN r >= 216 THEN r END), 0.0) / 255, 6) AS value FROM k WHERE rank <= 4 - depth GROUP BY pid""",
)
def transfer_by_depth(spark, d) -> DataFrame:
    q = orders_cloud(spark, d).withColumn("depth", F.col("r") % 4)
    return rounded(near.transfer_by_depth(q, parts(spark, d), 3), 6)


DISKS = """disks AS (SELECT pid, x, y, z, 0.3 + radius / 2.0 AS radius, 0.6 AS nx, CASE WHEN pid % 2 = 0 THEN 0.0 ELSE 0.8 END AS ny, CASE WHEN pid % 2 = 0 THEN 0.8 ELSE 0.0 END AS nz FROM parts)"""


def disks(spark, d) -> DataFrame:
    odd = F.col("pid") % 2 != 0
    return parts(spark, d).select("pid", *AXES, (0.3 + F.col("radius") / 2.0).alias("radius"), F.lit(0.6).alias("nx"), F.when(odd, 0.8).otherwise(0.0).alias("ny"), F.when(odd, 0.0).otherwise(0.8).alias("nz"))


@query(
    "jn07_overlap",
    f"""WITH {PARTS_SQL}, {DISKS}, t AS (SELECT *, sqrt((nx + 0.001) * (nx + 0.001) + ny * ny + nz * nz) AS s1, sqrt(nx * nx + ny * ny + (nz + 0.001) * (nz + 0.001)) AS s2 FROM disks),
    u AS (SELECT *, (nx + 0.001) / s1 AS ax, ny / s1 AS ay, nz / s1 AS az, nx / s2 AS bx, ny / s2 AS by_, (nz + 0.001) / s2 AS bz FROM t),
    p AS (SELECT a.pid, b.pid AS other, a.radius AS r1, b.radius AS r2, b.x - a.x AS gx, b.y - a.y AS gy, b.z - a.z AS gz, a.ax, a.ay, a.az, b.bx, b.by_, b.bz,
      a.ay * b.bz - a.az * b.by_ AS dx, a.az * b.bx - a.ax * b.bz AS dy, a.ax * b.by_ - a.ay * b.bx AS dz FROM u a JOIN u b ON a.pid < b.pid AND {D2} <= (a.radius + b.radius) * (a.radius + b.radius)),
    h AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2, gx * bx + gy * by_ + gz * bz AS h, gx * ax + gy * ay + gz * az AS off FROM p),
    l AS (SELECT *, h * (dy * az - dz * ay) / nullif(d2, 0) AS qx, h * (dz * ax - dx * az) / nullif(d2, 0) AS qy, h * (dx * ay - dy * ax) / nullif(d2, 0) AS qz FROM h),
    w AS (SELECT *, (gx - qx) * dx + (gy - qy) * dy + (gz - qz) * dz AS along FROM l)
    SELECT pid, other FROM w WHERE CASE WHEN d2 <= 1e-18 THEN off = 0
      ELSE qx * qx + qy * qy + qz * qz <= r1 * r1 AND (gx - qx) * (gx - qx) + (gy - qy) * (gy - qy) + (gz - qz) * (gz - qz) - along * along / d2 <= r2 * r2 END""",
)
def overlap(spark, d) -> DataFrame:
    return near.overlapping(disks(spark, d), 1.6)


BOXES_A = "a AS (SELECT pid AS id, x - radius AS min_x, y - radius AS min_y, z - radius AS min_z, x + radius AS max_x, y + radius AS max_y, z + radius AS max_z FROM parts)"
BOXES_B = "b AS (SELECT pid AS id, x AS min_x, y AS min_y, z AS min_z, x + 3.0 AS max_x, y + 3.0 AS max_y, z + 3.0 AS max_z FROM cloud2)"


def part_boxes(spark, d) -> DataFrame:
    r = F.col("radius")
    return parts(spark, d).select(F.col("pid").alias("id"), *((F.col(c) - r).alias(f"min_{c}") for c in AXES), *((F.col(c) + r).alias(f"max_{c}") for c in AXES))


def cloud_boxes(spark, d) -> DataFrame:
    return orders_cloud(spark, d).select(F.col("pid").alias("id"), *(F.col(c).alias(f"min_{c}") for c in AXES), *((F.col(c) + 3.0).alias(f"max_{c}") for c in AXES))


@query(
    "jn08_box_join",
    f"""WITH {PARTS_SQL}, {ORDERS_SQL}, {BOXES_A}, {BOXES_B} SELECT a.id AS a, b.id AS b FROM a JOIN b ON a.min_x <= b.max_x AND a.max_x >= b.min_x AND a.min_y <= b.max_y
      AND a.max_y >= b.min_y AND a.min_z <= b.max_z AND a.max_z >= b.min_z""",
)
def box_join(spark, d) -> DataFrame:
    return near.boxes_joined(part_boxes(spark, d), cloud_boxes(spark, d))


@query(
    "jn09_spatial_anti_join",
    f"""WITH {PARTS_SQL}, {ORDERS_SQL}, {BOXES_B} SELECT pid, CASE WHEN EXISTS (SELECT 1 FROM b WHERE x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y AND z BETWEEN min_z AND max_z)
      THEN 0.0 ELSE radius END AS radius FROM parts""",
)
def spatial_anti_join(spark, d) -> DataFrame:
    return near.spatial_anti_join(parts(spark, d), cloud_boxes(spark, d)).select("pid", "radius")


CUBE = """c AS (SELECT (min(x) + max(x)) / 2 - greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 AS lx, (min(y) + max(y)) / 2 - greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 AS ly,
  (min(z) + max(z)) / 2 - greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM parts)"""


def key_sql(level: str, source: str = "p") -> str:
    at = {k: f"CAST(greatest(0, least((1 << ({level})) - 1, floor(({source}.{k} - l{k}) / e * (1 << ({level}))))) AS BIGINT)" for k in AXES}
    return f"list_sum(list_transform(range(0, {level}), lambda i: (((({at['x']}) >> i) & 1) << (3 * i)) + (((({at['y']}) >> i) & 1) << (3 * i + 1)) + (((({at['z']}) >> i) & 1) << (3 * i + 2))))"


OCTREE = f"""{CUBE}, k AS (SELECT p.pid, coalesce(CAST({key_sql('6')} AS BIGINT), 0) AS key FROM parts p, c),
  u AS (SELECT pid, key, CAST(l AS INTEGER) AS level, key >> CAST(3 * (6 - l) AS INTEGER) AS cell FROM k, range(0, 7) AS t(l)),
  n AS (SELECT level, cell, count(*) AS n FROM u GROUP BY 1, 2),
  leaves AS (SELECT pid, min(u.level) AS level FROM u JOIN n ON u.level = n.level AND u.cell = n.cell WHERE n <= 16 OR u.level = 6 GROUP BY pid),
  oct AS (SELECT leaves.pid, CAST(leaves.level AS INTEGER) AS level, key >> CAST(3 * (6 - leaves.level) AS INTEGER) AS leaf FROM leaves JOIN k USING (pid))"""


@query("srt12_13_octree", f"WITH {PARTS_SQL}, {OCTREE} SELECT pid, level, leaf FROM oct")
def octree(spark, d) -> DataFrame:
    return partition.octree_leaves(parts(spark, d), 6, 16).select("pid", "level", "leaf")


LOOKUP = f"""{OCTREE}, pr AS (SELECT q.pid, CASE WHEN q.x >= lx AND q.x < lx + e AND q.y >= ly AND q.y < ly + e AND q.z >= lz AND q.z < lz + e THEN coalesce(CAST({key_sql('6', 'q')} AS BIGINT), 0) END AS key FROM cloud2 q, c),
  h AS (SELECT pr.pid, max(o.level) AS level, max(key >> CAST(3 * (6 - o.level) AS INTEGER)) AS leaf FROM pr JOIN (SELECT DISTINCT level, leaf FROM oct) o ON key >> CAST(3 * (6 - o.level) AS INTEGER) = o.leaf GROUP BY pr.pid)"""


@query("jn10_octree_lookup", f"WITH {PARTS_SQL}, {ORDERS_SQL}, {LOOKUP} SELECT cloud2.pid, h.level, h.leaf FROM cloud2 LEFT JOIN h ON h.pid = cloud2.pid")
def octree_lookup(spark, d) -> DataFrame:
    p = parts(spark, d).select("pid", *AXES)
    return partition.octree_lookup(orders_cloud(spark, d), partition.octree_leaves(p, 6, 16), partition.cube(p), 6)


CLOSED = LOOKUP.replace("< lx + e", "<= lx + e").replace("< ly + e", "<= ly + e").replace("< lz + e", "<= lz + e")


@query("jn11_octree_lookup_closed", f"WITH {PARTS_SQL}, {ORDERS_SQL}, {CLOSED} SELECT cloud2.pid, coalesce(h.level, 0) AS level, coalesce(h.leaf, 0) AS leaf FROM cloud2 LEFT JOIN h ON h.pid = cloud2.pid")
def octree_lookup_closed(spark, d) -> DataFrame:
    p = parts(spark, d).select("pid", *AXES)
    return partition.octree_lookup(orders_cloud(spark, d), partition.octree_leaves(p, 6, 16), partition.cube(p), 6, closed=True)


@query(
    "jn12_13_view_cells",
    f"""WITH {SURFELS_SQL} SELECT pid, CASE WHEN x >= 5 AND x < 45 AND y >= 5 AND y < 45 AND z >= 5 AND z < 45
      THEN CAST((floor((z - 5.0) / 10.0) * 4 + floor((y - 5.0) / 10.0)) * 4 + floor((x - 5.0) / 10.0) AS BIGINT) END AS cell,
      9 * (1 + CASE WHEN z - 25 > 10 THEN 1 WHEN z - 25 < -10 THEN -1 ELSE 0 END) + 3 * (1 + CASE WHEN y - 25 > 10 THEN 1 WHEN y - 25 < -10 THEN -1 ELSE 0 END)
      + 1 + CASE WHEN x - 25 > 10 THEN 1 WHEN x - 25 < -10 THEN -1 ELSE 0 END AS outer_cell FROM surfels""",
)
def view_cells(spark, d) -> DataFrame:
    p = geo.vec("x", "y", "z")
    mid, half = (F.lit(25.0),) * 3, (F.lit(10.0),) * 3
    return surfels(spark, d).select("pid", partition.view_cell(p, (5.0, 5.0, 5.0), 10.0, (4, 4, 4)).alias("cell"), partition.bounding_cell(p, mid, half).alias("outer_cell"))


@query(
    "jn13_cell_lookup",
    f"WITH {PARTS_SQL}, {ORDERS_SQL}, {BOXES_B} SELECT pid, b.id FROM parts JOIN b ON x >= min_x AND x < max_x AND y >= min_y AND y < max_y AND z >= min_z AND z < max_z",
)
def cell_lookup(spark, d) -> DataFrame:
    return near.in_boxes(parts(spark, d), cloud_boxes(spark, d), closed=False)


@query(
    "jn14_15_measurements",
    """SELECT l_orderkey AS idx, CAST(l_suppkey % 50 AS INTEGER) AS camera, l_quantity AS u, l_tax AS v, s_acctbal AS focal FROM lineitem JOIN supplier ON s_suppkey = l_suppkey % 50""",
)
def measurements(spark, d) -> DataFrame:
    from lodestone.plans.set_queries import sparse

    cameras = read(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("camera"), F.col("s_acctbal").alias("focal"))
    return joins.camera_measurements(sparse(spark, d), cameras)


@query("jn16_atlas_tiles", "SELECT c_custkey AS camera_id, c_name AS name, CAST(n_nationkey * 10 AS INTEGER) AS tx FROM customer JOIN nation ON c_nationkey = n_nationkey")
def atlas_tiles(spark, d) -> DataFrame:
    tiles = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("name"), (F.col("n_nationkey") * 10).cast("int").alias("tx"))
    views = read(spark, d, "customer").select(F.col("c_custkey").alias("camera_id"), F.col("c_name").alias("name"))
    return joins.tiles_of_views(views, tiles.dropDuplicates(["name"])).select("camera_id", "name", "tx")


RAYS = """rays AS (SELECT n_nationkey AS ray_id, n_nationkey * 4.0 AS ox, n_regionkey * 10.0 AS oy, -50.0 AS oz, 0.0 AS dx, 0.6 AS dy, 0.8 AS dz FROM nation)"""


def rays(spark, d) -> DataFrame:
    n = read(spark, d, "nation")
    at = {"ox": F.col("n_nationkey") * 4.0, "oy": F.col("n_regionkey") * 10.0, "oz": F.lit(-50.0), "dx": F.lit(0.0), "dy": F.lit(0.6), "dz": F.lit(0.8)}
    return n.select(F.col("n_nationkey").alias("ray_id"), F.col("n_regionkey").alias("bundle"), *(v.alias(k) for k, v in at.items()))


@query(
    "jn17_ray_disks",
    f"""WITH {PARTS_SQL}, {DISKS}, {RAYS}, h AS (SELECT ray_id, pid, radius, x, y, z, ox, oy, oz, dx, dy, dz,
      ((x - ox) * nx + (y - oy) * ny + (z - oz) * nz) / nullif(dx * nx + dy * ny + dz * nz, 0) AS t FROM rays, disks),
    e AS (SELECT ray_id, pid, radius, t, sqrt((ox + t * dx - x) ** 2 + (oy + t * dy - y) ** 2 + (oz + t * dz - z) ** 2) AS off FROM h WHERE t >= 0),
    r AS (SELECT ray_id, pid, 0.01 * t + off AS error, t, row_number() OVER (PARTITION BY ray_id ORDER BY 0.01 * t + off, pid) AS rn FROM e WHERE off <= radius AND 0.01 * t + off <= 6.0)
    SELECT ray_id, pid, round(error, 6) AS error, round(t, 6) AS t FROM r WHERE rn = 1""",
)
def ray_disks(spark, d) -> DataFrame:
    return rounded(near.rays_hit_all(rays(spark, d), disks(spark, d)), 6)


@query("jn18_ray_bundle")
def ray_bundle(spark, d) -> DataFrame:
    big = disks(spark, d).withColumn("radius", F.col("radius") * 3.0)
    hits = near.rays_hit_all(rays(spark, d), big, cap=60.0)
    return near.ray_bundle(hits.select("ray_id", "t"), rays(spark, d)).select("bundle", "n", "mx", "my", "mz")


@query(
    "jn19_ray_boxes",
    f"""WITH {PARTS_SQL}, {BOXES_A}, {RAYS}, s AS (SELECT ray_id, id AS node, greatest(least((min_x - ox) / 1e-12, (max_x - ox) / 1e-12), least((min_y - oy) / dy, (max_y - oy) / dy), least((min_z - oz) / dz, (max_z - oz) / dz)) AS t0,
      least(greatest((min_x - ox) / 1e-12, (max_x - ox) / 1e-12), greatest((min_y - oy) / dy, (max_y - oy) / dy), greatest((min_z - oz) / dz, (max_z - oz) / dz)) AS t1 FROM rays, a),
    r AS (SELECT ray_id, node, greatest(0.0, t0) AS t, row_number() OVER (PARTITION BY ray_id ORDER BY greatest(0.0, t0), node) AS rn FROM s WHERE t0 <= t1 AND t1 >= 0)
    SELECT ray_id, node, round(t, 6) AS t FROM r WHERE rn = 1""",
)
def ray_boxes(spark, d) -> DataFrame:
    return rounded(near.rays_boxes(rays(spark, d), part_boxes(spark, d)), 6)


@query("jn20_21_natural_neighbours")
def natural_neighbours(spark, d) -> DataFrame:
    """Among the 24 nearest of all points (JN-20) and among those of the point's node (JN-21)."""
    p = parts(spark, d)
    found = [att.tree_natural_neighbours(p).withColumn("among", F.lit("all")), att.natural_neighbours(p, "node").withColumn("among", F.lit("node"))]
    return rounded(found[0].unionByName(found[1]), 5)


@query(
    "jn22_triangle_adjacency",
    """WITH t AS (SELECT o_orderkey AS tri_id, o_custkey % 200 AS a, 200 + o_orderkey % 200 AS b, 400 + (o_custkey + o_orderkey) % 200 AS c FROM orders),
    e AS (SELECT tri_id, unnest([a, b, a]) AS u, unnest([b, c, c]) AS v FROM t)
    SELECT DISTINCT p.tri_id, q.tri_id AS other FROM e p JOIN e q ON p.u = q.u AND p.v = q.v AND p.tri_id < q.tri_id""",
)
def triangle_adjacency(spark, d) -> DataFrame:
    from lodestone.operators import mesh

    return mesh.adjacent(triangles(spark, d))


def triangles(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, d, "orders").select(k.alias("tri_id"), (c % 200).alias("a"), (200 + k % 200).alias("b"), (400 + (c + k) % 200).alias("c"))


@query(
    "jn23_views",
    """SELECT s_suppkey AS camera_id, s_name AS name, s_acctbal AS focal, c_acctbal AS tx, 0.0 AS distortion FROM supplier JOIN customer ON c_custkey = s_suppkey JOIN part ON p_partkey = s_suppkey""",
)
def views(spark, d) -> DataFrame:
    s = read(spark, d, "supplier")
    names = s.select(F.col("s_suppkey").alias("camera_id"), F.col("s_name").alias("name"))
    inner = s.select(F.col("s_suppkey").alias("camera_id"), F.col("s_acctbal").alias("focal"))
    bent = read(spark, d, "part").select(F.col("p_partkey").alias("camera_id"), F.col("p_retailprice").alias("k1"))
    poses = read(spark, d, "customer").select(F.col("c_custkey").alias("camera_id"), F.col("c_acctbal").alias("tx"))
    return joins.views(names, inner, bent, poses).select("camera_id", "name", "focal", "tx", "distortion")


@query(
    "jn24_points_features",
    """WITH p AS (SELECT o_orderkey AS point_id, o_totalprice AS x FROM orders), er AS (SELECT o_orderkey AS point_id, o_custkey / 10.0 AS error FROM orders WHERE o_custkey % 5 <> 0),
    ob AS (SELECT DISTINCT l_orderkey AS point_id, l_suppkey AS camera_id, l_partkey AS feature_id FROM lineitem),
    ft AS (SELECT s_suppkey AS camera_id, p_partkey AS feature_id, s_acctbal AS u, p_retailprice AS v FROM supplier, part WHERE p_partkey % 40 = s_suppkey % 40),
    f AS (SELECT ob.point_id, count(*) AS features, sum(coalesce(u, 0.0)) AS su, min(ob.camera_id) AS first_camera FROM ob LEFT JOIN ft USING (camera_id, feature_id) GROUP BY 1)
    SELECT p.point_id, x, error, CAST(coalesce(features, -1) AS INTEGER) AS features, round(su, 4) + 0.0 AS su, first_camera FROM p JOIN er USING (point_id) LEFT JOIN f USING (point_id)""",
)
def points_features(spark, d) -> DataFrame:
    o, ln = read(spark, d, "orders"), read(spark, d, "lineitem")
    points = o.select(F.col("o_orderkey").alias("point_id"), F.col("o_totalprice").alias("x"))
    errors = o.where("o_custkey % 5 <> 0").select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") / 10.0).alias("error"))
    seen = ln.select(F.col("l_orderkey").alias("point_id"), F.col("l_suppkey").alias("camera_id"), F.col("l_partkey").alias("feature_id")).distinct()
    s, p = read(spark, d, "supplier"), read(spark, d, "part")
    # Only features that are seen meet an observation, so suppliers and parts need not all meet.
    cameras = s.select(F.col("s_suppkey").alias("camera_id"), F.col("s_acctbal").alias("u"))
    features = p.select(F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("v"))
    feats = seen.select("camera_id", "feature_id").distinct().where(F.col("feature_id") % 40 == F.col("camera_id") % 40).join(cameras, "camera_id").join(features.hint("merge"), "feature_id")
    out = joins.points_with_features(points, errors, seen, feats)
    size = F.when(F.col("features").isNull(), -1).otherwise(F.size("features"))
    total = F.aggregate("features", F.lit(0.0), lambda a, f: a + f["u"])
    return rounded(out.select("point_id", "x", "error", total.alias("su"), F.get("features", F.lit(0))["camera_id"].alias("first_camera"), size.alias("features")), 4)


@query("att01_05_normals")
def normals(spark, d) -> DataFrame:
    return rounded(att.plane_normals(parts(spark, d), 16), 4)


@query("att02_radius", f"WITH {PARTS_SQL}, {KNN} SELECT pid, round(avg(sqrt(d2)) * 0.7, 6) AS radius FROM knn WHERE rank <= 8 GROUP BY pid")
def radius(spark, d) -> DataFrame:
    return rounded(att.neighbour_radius(parts(spark, d), 8), 6)


@query("att03_natural_radius")
def natural_radius(spark, d) -> DataFrame:
    return rounded(att.natural_radius(parts(spark, d), "node"), 5)


@query("att04_normals_and_radii")
def normals_and_radii(spark, d) -> DataFrame:
    return rounded(att.normals_and_radii(parts(spark, d), 10, 6), 4)


@query(
    "att06_resample_candidates",
    f"""WITH {PARTS_SQL}, {LOCAL}, c AS (SELECT loc.pid, count(*) FILTER (WHERE sqrt(d2) * 1.6 < p.radius * 8.0) AS close FROM loc JOIN parts p ON p.pid = loc.pid GROUP BY 1)
    SELECT pid, close FROM c WHERE close >= 3""",
)
def resample_candidates(spark, d) -> DataFrame:
    return att.resample_candidates(parts(spark, d).withColumn("radius", F.col("radius") * 8.0), "node")


@query(
    "att07_resample",
    f"""WITH {SURFELS_SQL}, k AS (SELECT pid, radius, unnest(range(0, 3)) AS ring FROM surfels), q AS (SELECT pid, radius, ring, unnest(range(0, greatest(ring * 6, 1))) AS slot FROM k)
    SELECT CAST(ring AS INTEGER) AS ring, CAST(slot AS INTEGER) AS slot, count(*) AS n, round(avg(radius / 3.0), 6) AS radius FROM q GROUP BY 1, 2""",
)
def resample(spark, d) -> DataFrame:
    out = att.resampled(surfels(spark, d))
    return rounded(out.groupBy("ring", "slot").agg(F.count("*").alias("n"), F.avg("radius").alias("radius")), 6)


@query("att09_multiply_radii", f"WITH {SURFELS_SQL} SELECT pid, radius * 1.25 AS radius FROM surfels")
def multiply_radii(spark, d) -> DataFrame:
    return surfels(spark, d).select("pid", (F.col("radius") * 1.25).alias("radius"))


@query(
    "srt07_outliers",
    f"WITH {PARTS_SQL}, {KNN}, {MEAN} SELECT pid, round(mean_d2, 4) AS mean_d2 FROM m ORDER BY m.mean_d2 DESC, pid LIMIT 20",
)
def outliers(spark, d) -> DataFrame:
    return rounded(near.outliers(parts(spark, d), 10, 20), 4)


@query("srt08_without_outliers", f"WITH {PARTS_SQL}, {KNN}, {MEAN}, o AS (SELECT pid FROM m ORDER BY mean_d2 DESC, pid LIMIT 20) SELECT pid, x + 3.0 AS x FROM parts WHERE pid NOT IN (SELECT pid FROM o)")
def without_outliers(spark, d) -> DataFrame:
    p = parts(spark, d)
    return p.join(near.outliers(p, 10, 20), "pid", "left_anti").select("pid", (F.col("x") + 3.0).alias("x"))


@query(
    "knn_embeddings",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT)) AS v FROM embeddings),
    p AS (SELECT a.vec_id, b.vec_id AS neighbor, list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT vec_id, neighbor, CAST(d2 AS BIGINT) AS d2, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbor) AS rn FROM p) SELECT vec_id, neighbor, d2 FROM r WHERE rn = 1""",
)
def embeddings_neighbor(spark, d) -> DataFrame:
    """The nearest other vector of each: all pairs, in tiles of bounded size."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v"))
    return nearest_vector(e)
