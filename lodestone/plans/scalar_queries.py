"""Queries of projections, filters, codecs and tree arithmetic over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import color, tree
from lodestone.functions import geometry as geo
from lodestone.model import PARTS_SQL, SURFELS_SQL, orders_cloud, parts, read, rounded, surfels
from lodestone.operators import partition
from lodestone.plans.registry import query

#: A rotation by the 3-4-5 triangle with a translation: the frame change of the affine queries.
FRAME = [[0.6, -0.8, 0.0, 1.5], [0.8, 0.6, 0.0, -2.0], [0.0, 0.0, 1.0, 0.25]]
LOW, HIGH = (5.0, 5.0, 5.0), (30.0, 30.0, 40.0)


def pos() -> geo.Vec:
    return geo.vec("x", "y", "z")


def nor() -> geo.Vec:
    return geo.vec("nx", "ny", "nz")


def lits(v: tuple[float, ...]) -> geo.Vec:
    return tuple(F.lit(c) for c in v)


def s(body: str) -> str:
    return f"WITH {SURFELS_SQL} {body}"


@query("prj01_scale", s("SELECT pid, x * 2.5 AS x, y * 2.5 AS y, z * 2.5 AS z, radius * 2.5 AS radius FROM surfels"))
def scale(spark, d) -> DataFrame:
    return surfels(spark, d).select("pid", *((F.col(c) * 2.5).alias(c) for c in ("x", "y", "z", "radius")))


@query("prj02_translate", s("SELECT pid, x + 10.0 AS x, y + -3.5 AS y, z + 0.25 AS z FROM surfels"))
def translate(spark, d) -> DataFrame:
    return surfels(spark, d).select("pid", *((F.col(c) + t).alias(c) for c, t in (("x", 10.0), ("y", -3.5), ("z", 0.25))))


@query("prj03_override", s("SELECT pid, x, 0.75 AS radius, 10 AS r, 20 AS g, 30 AS b FROM surfels"))
def override(spark, d) -> DataFrame:
    return surfels(spark, d).select("pid", "x", F.lit(0.75).alias("radius"), *(F.lit(v).alias(c) for c, v in (("r", 10), ("g", 20), ("b", 30))))


@query(
    "prj04_center",
    s(""", t AS (SELECT floor((min(x) + max(x)) / 2) AS tx, floor((min(y) + max(y)) / 2) AS ty, floor((min(z) + max(z)) / 2) AS tz FROM surfels)
    SELECT pid, x - tx AS x, y - ty AS y, z - tz AS z, tx, ty, tz FROM surfels, t"""),
)
def center(spark, d) -> DataFrame:
    return partition.centered(surfels(spark, d).select("pid", *geo.AXES))


@query("prj05_cli_translate", s("SELECT pid, x + 1.0 AS x, y + 2.0 AS y, z + 3.0 AS z, r, g, b, radius FROM surfels"))
def cli_translate(spark, d) -> DataFrame:
    moved = surfels(spark, d).withColumns({c: F.col(c) + t for c, t in zip(geo.AXES, (1.0, 2.0, 3.0), strict=True)})
    return moved.select("pid", *geo.AXES, "r", "g", "b", "radius")


@query(
    "prj06_normal_color",
    s("""SELECT pid, CAST(trunc(255 * (nx * 0.5 + 0.5)) AS INTEGER) AS r, CAST(trunc(255 * (ny * 0.5 + 0.5)) AS INTEGER) AS g,
    CAST(trunc(255 * (nz * 0.5 + 0.5)) AS INTEGER) AS b FROM surfels"""),
)
def normal_color(spark, d) -> DataFrame:
    return surfels(spark, d).select("pid", *(color.normal_rgb(F.col(n)).alias(c) for n, c in zip(("nx", "ny", "nz"), "rgb", strict=True)))


@query(
    "prj07_affine",
    s("""SELECT pid, round(0.6 * x + -0.8 * y + 0.0 * z + 1.5, 7) + 0.0 AS x, round(0.8 * x + 0.6 * y + 0.0 * z + -2.0, 7) + 0.0 AS y,
    round(0.0 * x + 0.0 * y + 1.0 * z + 0.25, 7) + 0.0 AS z FROM surfels"""),
)
def affine(spark, d) -> DataFrame:
    moved = geo.affine(FRAME, pos())
    return rounded(surfels(spark, d).select("pid", *(m.alias(c) for m, c in zip(moved, geo.AXES, strict=True))), 7)


@query(
    "prj07_affine_box",
    s(""", b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM surfels),
    c AS (SELECT px, py, pz FROM b, unnest([lx, hx]) AS a(px), unnest([ly, hy]) AS e(py), unnest([lz, hz]) AS f(pz))
    SELECT round(min(0.6 * px - 0.8 * py + 1.5), 6) AS min_x, round(min(0.8 * px + 0.6 * py - 2.0), 6) AS min_y, round(min(pz + 0.25), 6) AS min_z,
      round(max(0.6 * px - 0.8 * py + 1.5), 6) AS max_x, round(max(0.8 * px + 0.6 * py - 2.0), 6) AS max_y, round(max(pz + 0.25), 6) AS max_z FROM c"""),
)
def affine_box(spark, d) -> DataFrame:
    box = surfels(spark, d).agg(*(f(c).alias(f"{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in geo.AXES))
    low, high = geo.affine_box(FRAME, geo.vec("lx", "ly", "lz"), geo.vec("hx", "hy", "hz"))
    return rounded(box.select(*(v.alias(f"min_{c}") for v, c in zip(low, geo.AXES, strict=True)), *(v.alias(f"max_{c}") for v, c in zip(high, geo.AXES, strict=True))), 6)


@query(
    "prj08_quaternion",
    """WITH q AS (SELECT p_partkey AS pid, cos(p_size / 50.0) AS w, sin(p_size / 50.0) * 0.6 AS x, 0.0 AS y, sin(p_size / 50.0) * 0.8 AS z FROM part)
    SELECT pid, round(1 - 2 * (y * y + z * z), 6) + 0.0 AS m00, round(2 * (x * y - z * w), 6) + 0.0 AS m01, round(2 * (x * z + y * w), 6) + 0.0 AS m02,
      round(2 * (x * y + z * w), 6) + 0.0 AS m10, round(1 - 2 * (x * x + z * z), 6) + 0.0 AS m11, round(2 * (y * z - x * w), 6) + 0.0 AS m12,
      round(2 * (x * z - y * w), 6) + 0.0 AS m20, round(2 * (y * z + x * w), 6) + 0.0 AS m21, round(1 - 2 * (x * x + y * y), 6) + 0.0 AS m22 FROM q""",
)
def quaternion(spark, d) -> DataFrame:
    half = F.col("p_size") / 50.0
    q = read(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.cos(half).alias("w"), (F.sin(half) * 0.6).alias("x"), F.lit(0.0).alias("y"), (F.sin(half) * 0.8).alias("z"))
    m = geo.quaternion_matrix(*(F.col(c) for c in "wxyz"))
    return rounded(q.select("pid", *(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3))), 6)


LAB_SQL = """l AS (SELECT pid, r, g, b,
    100.0 * CASE WHEN r / 255.0 > 0.04045 THEN pow((r / 255.0 + 0.055) / 1.055, 2.4) ELSE r / 255.0 / 12.92 END AS lr,
    100.0 * CASE WHEN g / 255.0 > 0.04045 THEN pow((g / 255.0 + 0.055) / 1.055, 2.4) ELSE g / 255.0 / 12.92 END AS lg,
    100.0 * CASE WHEN b / 255.0 > 0.04045 THEN pow((b / 255.0 + 0.055) / 1.055, 2.4) ELSE b / 255.0 / 12.92 END AS lb FROM surfels),
  t AS (SELECT pid, r, g, b, (0.4124 * lr + 0.3576 * lg + 0.1805 * lb) / 95.047 AS x, (0.2126 * lr + 0.7152 * lg + 0.0722 * lb) / 100.0 AS y,
    (0.0193 * lr + 0.1192 * lg + 0.9505 * lb) / 108.883 AS z FROM l),
  f AS (SELECT pid, r, g, b,
    CASE WHEN x > 216.0 / 24389.0 THEN pow(x, 1.0 / 3.0) ELSE 841.0 / 108.0 * x + 4.0 / 29.0 END AS fx,
    CASE WHEN y > 216.0 / 24389.0 THEN pow(y, 1.0 / 3.0) ELSE 841.0 / 108.0 * y + 4.0 / 29.0 END AS fy,
    CASE WHEN z > 216.0 / 24389.0 THEN pow(z, 1.0 / 3.0) ELSE 841.0 / 108.0 * z + 4.0 / 29.0 END AS fz FROM t),
  lab AS (SELECT pid, r, g, b, greatest(0.0, 116.0 * fy - 16.0) AS cl, 500.0 * (fx - fy) AS ca, 200.0 * (fy - fz) AS cb FROM f)"""


@query("prj09_lab", s(f", {LAB_SQL} SELECT pid, round(cl, 6) + 0.0 AS cl, round(ca, 6) + 0.0 AS ca, round(cb, 6) + 0.0 AS cb FROM lab"))
def lab(spark, d) -> DataFrame:
    values = color.lab(*(F.col(c) for c in "rgb"))
    return rounded(surfels(spark, d).select("pid", *(v.alias(n) for v, n in zip(values, ("cl", "ca", "cb"), strict=True))), 6)


@query("prj10_delta_e", s(f", {LAB_SQL} SELECT pid, round(sqrt((cl - 50.0) * (cl - 50.0) + (ca - 10.0) * (ca - 10.0) + (cb - -20.0) * (cb - -20.0)), 6) AS delta FROM lab"))
def delta_e(spark, d) -> DataFrame:
    values = color.lab(*(F.col(c) for c in "rgb"))
    return rounded(surfels(spark, d).select("pid", color.delta_e(values, lits((50.0, 10.0, -20.0))).alias("delta")), 6)


@query(
    "prj11_13_quantize",
    s(""", n AS (SELECT l_partkey % 16 AS node, min(x) AS lx, max(x) AS hx FROM surfels GROUP BY 1),
    v AS (SELECT s.*, n.* FROM surfels s JOIN n ON s.l_partkey % 16 = n.node)
    SELECT pid, CAST(greatest(0, least(65535, round((x - lx) / (hx - lx) * 65535))) AS INTEGER) AS qx,
      CAST(least(127, round(r / 2.0)) AS INTEGER) AS qr, CAST(least(127, round(g / 2.0)) AS INTEGER) AS qg,
      CASE WHEN radius = 0 THEN 2047 ELSE CAST(greatest(0, least(2046, round((radius - (0.1 - 0.25)) / 0.5 * 2046))) AS INTEGER) END AS qradius FROM v"""),
)
def quantize(spark, d) -> DataFrame:
    at = surfels(spark, d).withColumn("node", F.col("l_partkey") % 16)
    box = at.groupBy("node").agg(F.min("x").alias("lx"), F.max("x").alias("hx"))
    return at.join(box, "node").select(
        "pid", color.quantize_position(F.col("x"), F.col("lx"), F.col("hx")).alias("qx"), color.quantize_channel(F.col("r")).alias("qr"),
        color.quantize_channel(F.col("g")).alias("qg"), color.quantize_radius(F.col("radius"), F.lit(0.1), F.lit(0.25)).alias("qradius"),
    )


@query(
    "prj14_quantize_normal",
    s(""", f AS (SELECT pid, nx, ny, nz, abs(nx) >= abs(ny) AND abs(nx) >= abs(nz) AS on_x, abs(ny) >= abs(nz) AS on_y FROM surfels),
    m AS (SELECT *, CASE WHEN on_x THEN nx WHEN on_y THEN ny ELSE nz END AS main FROM f),
    q AS (SELECT pid, (CASE WHEN on_x THEN 0 WHEN on_y THEN 1 ELSE 2 END) * 2 + CASE WHEN main > 0 THEN 1 ELSE 0 END AS face,
      CASE WHEN on_x THEN ny ELSE nx END / abs(main) AS u, CASE WHEN on_x OR on_y THEN nz ELSE ny END / abs(main) AS v FROM m)
    SELECT pid, CAST(face * 10920 + round((v + 1.0) / 2.0 * 104) * 104 + round((u + 1.0) / 2.0 * 103) AS INTEGER) AS code FROM q"""),
)
def quantize_normal(spark, d) -> DataFrame:
    return surfels(spark, d).select("pid", color.quantize_normal(*nor()).alias("code"))


@query(
    "prj15_hemi_oct",
    s(""", h AS (SELECT pid, nx / (abs(nx) + abs(ny) + abs(nz)) + ny / (abs(nx) + abs(ny) + abs(nz)) AS u,
      nx / (abs(nx) + abs(ny) + abs(nz)) - ny / (abs(nx) + abs(ny) + abs(nz)) AS v FROM surfels)
    SELECT pid, round(u, 7) + 0.0 AS u, round(v, 7) + 0.0 AS v,
      round((u + v) / 2.0 / sqrt((u + v) / 2.0 * (u + v) / 2.0 + (u - v) / 2.0 * (u - v) / 2.0 + pow(1.0 - abs((u + v) / 2.0) - abs((u - v) / 2.0), 2)), 7) + 0.0 AS nx FROM h"""),
)
def hemi_oct(spark, d) -> DataFrame:
    u, v = color.hemi_oct(*nor())
    at = surfels(spark, d).select("pid", u.alias("u"), v.alias("v"))
    return rounded(at.withColumn("nx", color.hemi_oct_decoded(F.col("u"), F.col("v"))[0]), 7)


@query(
    "prj16_tree_ids",
    """WITH n AS (SELECT o_orderkey AS node FROM orders)
    SELECT node, node * 2 + 1 AS left_child, node * 2 + 2 AS right_child, CASE WHEN node > 0 THEN (node - 1) // 2 END AS parent,
      CAST(length(bin(node + 1)) - 1 AS INTEGER) AS depth FROM n""",
)
def tree_ids(spark, d) -> DataFrame:
    n = F.col("node")
    at = read(spark, d, "orders").select(F.col("o_orderkey").alias("node"))
    return at.select("node", tree.child(n, 0, 2).alias("left_child"), tree.child(n, 1, 2).alias("right_child"), tree.parent(n, 2).alias("parent"), tree.depth_of(n, 2, 40).alias("depth"))


@query(
    "prj17_morton",
    """WITH v AS (SELECT o_orderkey AS k, o_orderkey % 256 AS x, o_custkey % 256 AS y FROM orders),
    m AS (SELECT k, x, y, list_sum(list_transform(range(0, 8), lambda i: (((x >> i) & 1) << (2 * i)) | (((y >> i) & 1) << (2 * i + 1)))) AS code FROM v)
    SELECT k, CAST(code AS BIGINT) AS code, CAST(code + 21845 AS BIGINT) AS quad, x AS dx, y AS dy FROM m""",
)
def morton(spark, d) -> DataFrame:
    at = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 256).alias("x"), (F.col("o_custkey") % 256).alias("y"))
    at = at.select("k", tree.morton(F.col("x"), F.col("y")).alias("code"), tree.quad_id(8, F.col("x"), F.col("y")).alias("quad"))
    dx, dy = tree.quad_decoded(F.col("quad"), 8)
    return at.withColumn("dx", dx).withColumn("dy", dy)


@query(
    "prj18_quad_neighbor",
    """WITH v AS (SELECT o_orderkey AS k, o_orderkey % 16 AS x, o_custkey % 16 AS y FROM orders),
    m AS (SELECT k, least(15, x + 1) AS rx, y AS ry, x AS ux, greatest(0, y - 1) AS uy FROM v)
    SELECT k, CAST(85 + list_sum(list_transform(range(0, 4), lambda i: (((rx >> i) & 1) << (2 * i)) | (((ry >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS right_tile,
      CAST(85 + list_sum(list_transform(range(0, 4), lambda i: (((ux >> i) & 1) << (2 * i)) | (((uy >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS upper_tile FROM m""",
)
def quad_neighbor(spark, d) -> DataFrame:
    at = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), tree.quad_id(4, F.col("o_orderkey") % 16, F.col("o_custkey") % 16).alias("t"))
    return at.select("k", tree.quad_neighbor(F.col("t"), 4, 1, 0).alias("right_tile"), tree.quad_neighbor(F.col("t"), 4, 0, -1).alias("upper_tile"))


@query(
    "prj19_20_plane",
    s("""SELECT pid, round(abs((x - 10.0) * 0.0 + (y - 10.0) * 0.6 + (z - 10.0) * 0.8) / sqrt(0.0 * 0.0 + 0.6 * 0.6 + 0.8 * 0.8), 7) AS distance,
      round((z - 10.0) * 0.6 - (y - 10.0) * 0.8, 7) + 0.0 AS u, round(x - 10.0, 7) + 0.0 AS v FROM surfels"""),
)
def plane(spark, d) -> DataFrame:
    origin, normal = lits((10.0, 10.0, 10.0)), lits((0.0, 0.6, 0.8))
    u, v = geo.project_to_plane(pos(), origin, normal)
    return rounded(surfels(spark, d).select("pid", geo.plane_distance(pos(), origin, normal).alias("distance"), u.alias("u"), v.alias("v")), 7)


@query(
    "prj21_orient",
    s(""", sc AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 100.0), (1, 60.0, 60.0, -20.0), (2, -10.0, 30.0, 25.0)) AS t(scan, sx, sy, sz)),
    j AS (SELECT s.*, sc.*, nx * (sx - x) + ny * (sy - y) + nz * (sz - z) AS facing FROM surfels s JOIN sc ON l_partkey % 3 = scan)
    SELECT pid, CASE WHEN facing <= 0 THEN -nx ELSE nx END + 0.0 AS nx, CASE WHEN facing <= 0 THEN -ny ELSE ny END + 0.0 AS ny,
      CASE WHEN facing <= 0 THEN -nz ELSE nz END + 0.0 AS nz FROM j"""),
)
def orient(spark, d) -> DataFrame:
    from lodestone.operators.attributes import toward_scanner

    scanners = spark.createDataFrame([(0, 0.0, 0.0, 100.0), (1, 60.0, 60.0, -20.0), (2, -10.0, 30.0, 25.0)], "scan int, sx double, sy double, sz double")
    at = surfels(spark, d).withColumn("scan", (F.col("l_partkey") % 3).cast("int"))
    return toward_scanner(at, scanners).select("pid", *((F.col(n) + 0.0).alias(n) for n in ("nx", "ny", "nz")))


@query("prj22_disk_points")
def disk_points(spark, d) -> DataFrame:
    from lodestone.operators.attributes import disk_points as op

    return op(surfels(spark, d).select("pid", *geo.AXES, "nx", "ny", "nz", "radius"), 11)


@query(
    "prj23_node_error",
    """SELECT p_partkey AS node_id, CASE WHEN p_size % 7 < 2 THEN 100.0 ELSE abs(2.0 * (p_size / 10.0) * 0.5 / -(-1.0 - p_retailprice / 100.0) * 1080.0) END AS error FROM part""",
)
def node_error(spark, d) -> DataFrame:
    t = read(spark, d, "part")
    return t.select(F.col("p_partkey").alias("node_id"), geo.node_error(F.col("p_size") / 10.0, -1.0 - F.col("p_retailprice") / 100.0, 0.5, 1080.0, F.col("p_size") % 7, 2).alias("error"))


@query("prj25_camera_file", "SELECT c_custkey AS camera, lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.jpg' AS file, c_name || '.jpg' AS named FROM customer")
def camera_file(spark, d) -> DataFrame:
    from lodestone.sources.text import camera_file as op

    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("camera"), op(k).alias("file"), op(k, F.col("c_name")).alias("named"))


@query("prj26_pixel_formats", s("SELECT pid, CAST(floor((r + g + b) / 3) AS INTEGER) AS grey, r, g, b, 255 AS a FROM surfels"))
def pixel_formats(spark, d) -> DataFrame:
    return surfels(spark, d).select("pid", color.to_grey(*(F.col(c) for c in "rgb")).alias("grey"), "r", "g", "b", F.lit(255).alias("a"))


@query(
    "flt01_04_filters",
    s("SELECT pid, x, y, z, radius FROM surfels WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND NOT (x = 0 AND y = 0 AND z = 0) AND radius > 0 AND r < 200"),
)
def filters(spark, d) -> DataFrame:
    keep = geo.finite(*pos()) & ~geo.every(*(c == 0 for c in pos())) & (F.col("radius") > 0) & (F.col("r") < 200)
    return surfels(spark, d).where(keep).select("pid", *geo.AXES, "radius")


@query(
    "flt05_radius_outliers",
    s(""", l AS (SELECT g % 12 AS level, avg(radius) AS m FROM surfels GROUP BY 1)
    SELECT pid, CASE WHEN radius > 1.5 * m THEN 0.0 ELSE radius END AS radius FROM surfels JOIN l ON g % 12 = level"""),
)
def radius_outliers(spark, d) -> DataFrame:
    at = surfels(spark, d).withColumn("level", F.col("g") % 12)
    mean = at.groupBy("level").agg(F.avg("radius").alias("m"))
    return at.join(mean, "level").select("pid", F.when(F.col("radius") > 1.5 * F.col("m"), 0.0).otherwise(F.col("radius")).alias("radius"))


@query(
    "flt06_09_containment",
    s("""SELECT pid, x BETWEEN 5 AND 30 AND y BETWEEN 5 AND 30 AND z BETWEEN 5 AND 40 AS in_box,
      x - radius >= 5 AND x + radius <= 30 AND y - radius >= 5 AND y + radius <= 30 AND z - radius >= 5 AND z + radius <= 40 AS box_holds_sphere,
      x - radius <= 30 AND x + radius >= 5 AND y - radius <= 30 AND y + radius >= 5 AND z - radius <= 40 AND z + radius >= 5 AS boxes_meet,
      pow(x - greatest(5, least(30, x)), 2) + pow(y - greatest(5, least(30, y)), 2) + pow(z - greatest(5, least(40, z)), 2) <= radius * radius AS sphere_meets_box,
      (x - 20) * (x - 20) + (y - 20) * (y - 20) + (z - 20) * (z - 20) <= 225 AS in_sphere FROM surfels"""),
)
def containment(spark, d) -> DataFrame:
    low, high, r = lits(LOW), lits(HIGH), F.col("radius")
    low2, high2 = tuple(c - r for c in pos()), tuple(c + r for c in pos())
    return surfels(spark, d).select(
        "pid", geo.box_contains_point(low, high, pos()).alias("in_box"), geo.box_contains_sphere(low, high, pos(), r).alias("box_holds_sphere"),
        geo.boxes_intersect(low2, high2, low, high).alias("boxes_meet"), geo.sphere_intersects_box(pos(), r, low, high).alias("sphere_meets_box"),
        geo.sphere_contains_point(lits((20.0, 20.0, 20.0)), F.lit(15.0), pos()).alias("in_sphere"),
    )


@query(
    "flt11_disk_box",
    s("""SELECT pid, x - abs(radius - radius * nx * nx) AS min_x, y - abs(radius - radius * ny * ny) AS min_y, z - abs(radius - radius * nz * nz) AS min_z,
      x + abs(radius - radius * nx * nx) AS max_x, y + abs(radius - radius * ny * ny) AS max_y, z + abs(radius - radius * nz * nz) AS max_z FROM surfels"""),
)
def disk_box(spark, d) -> DataFrame:
    low, high = geo.disk_box(pos(), nor(), F.col("radius"))
    return surfels(spark, d).select("pid", *(v.alias(f"min_{c}") for v, c in zip(low, geo.AXES, strict=True)), *(v.alias(f"max_{c}") for v, c in zip(high, geo.AXES, strict=True)))


@query(
    "flt12_frustum",
    f"""WITH {PARTS_SQL} SELECT pid FROM parts WHERE (x + radius) * 0.8 + 0.0 * (y + radius) + (z + radius) * 0.6 - 40.0 >= 0
      AND (x - radius) * -0.8 + 0.0 * (y + radius) + 0.6 * (z + radius) + 30.0 >= 0 AND (y + radius) * 1.0 - 48.0 >= 0""",
)
def frustum(spark, d) -> DataFrame:
    r = F.col("radius")
    planes = [(0.8, 0.0, 0.6, -40.0), (-0.8, 0.0, 0.6, 30.0), (0.0, 1.0, 0.0, -48.0)]
    return parts(spark, d).where(geo.in_frustum(tuple(c - r for c in pos()), tuple(c + r for c in pos()), planes)).select("pid")


@query(
    "set01_concat",
    f"WITH {PARTS_SQL}, cloud2 AS (SELECT o_orderkey AS pid, (o_orderkey * 53 % 1013) / 10.0 AS x FROM orders) SELECT 0 AS source, pid, x FROM parts UNION ALL SELECT 1, pid, x FROM cloud2",
)
def concat(spark, d) -> DataFrame:
    one = parts(spark, d).select(F.lit(0).alias("source"), "pid", "x")
    return one.unionByName(orders_cloud(spark, d).select(F.lit(1).alias("source"), "pid", "x"))
