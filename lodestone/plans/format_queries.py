"""Queries of file formats: rows of the tables are written as files of the format by the executors, and read back through its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.model import PARTS_SQL, parts, read, rounded, scratch_path
from lodestone.plans.registry import query
from lodestone.sources import binary, structured

#: Rows of a file: files are written from groups, which this bounds.
BLOCK = 64
BLOCKS_SQL = f"{PARTS_SQL}, blocks AS (SELECT *, pid // {BLOCK} AS block, row_number() OVER (PARTITION BY pid // {BLOCK} ORDER BY pid) - 1 AS ord FROM parts)"


def f4(name: str, digits: int = 4) -> str:
    """SQL of a column that went through four bytes."""
    return f"round(CAST(CAST({name} AS FLOAT) AS DOUBLE), {digits}) + 0.0"


def blocks(spark, d) -> DataFrame:
    return parts(spark, d).withColumn("block", F.floor(F.col("pid") / BLOCK))


def block_of(path: str = "path"):
    """The block that a file's name ends with."""
    return F.regexp_extract(binary.file_name(path), r"(\d+)\.[a-z.]+$", 1).cast("long").alias("block")


def packed(df: DataFrame, spark, ending: str, pack) -> str:
    """One file a block, its bytes made by ``pack`` of the block's rows in the order of pid; gives the folder."""

    def make(pdf):
        return f"block-{int(pdf['block'].iloc[0]):08d}.{ending}", pack(pdf)

    binary.write_files(binary.in_files(df, F.col("block"), ["pid"], make), path := scratch_path(spark, ending))
    return path


def written(lines: DataFrame, spark, ending: str, head: str = "") -> str:
    """One text file a block of (block, at, value), the lines in the order of ``at``."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda r: r["value"]), "\n")
    files = lines.groupBy("block").agg(F.concat(F.lit(head), text, F.lit("\n")).cast("binary").alias("content"))
    name = F.format_string(f"block-%08d.{ending}", "block").alias("name")
    binary.write_files(files.select(name, "content"), path := scratch_path(spark, ending))
    return path


@query("src05_xyz_bin", f"WITH {PARTS_SQL} SELECT {f4('x')} AS x, {f4('y')} AS y, {f4('z')} AS z, CAST(r AS INTEGER) AS r, CAST(b AS INTEGER) AS b, 200 AS a, {f4('radius')} AS radius, {f4('0.6')} AS ny FROM parts")
def xyz_bin(spark, d) -> DataFrame:
    """Fixed records in files of bounded size, read in slices."""
    p = parts(spark, d).withColumns({"a": F.lit(200), "nx": F.lit(0.0), "ny": F.lit(0.6), "nz": F.lit(0.8)})
    binary.write_records(p, binary.XYZ_BIN, path := scratch_path(spark, "bin"), "pid")
    return rounded(binary.read_xyz_bin(spark, path).select("x", "y", "z", "r", "b", "a", "radius", "ny"), 4)


@query("src09_snk03_lod", f"WITH {BLOCKS_SQL} SELECT block AS node_id, {f4('x')} AS x, {f4('radius')} AS radius FROM blocks WHERE pid % 3 <> 0")
def node_file(spark, d) -> DataFrame:
    """Nodes padded to one size, a bounded number of them a file."""
    p = parts(spark, d).where("pid % 3 <> 0").withColumn("node_id", F.floor(F.col("pid") / BLOCK))
    p = p.withColumns({"a": F.lit(255), "nx": F.lit(0.0), "ny": F.lit(0.6), "nz": F.lit(0.8)})
    binary.write_nodes(p, BLOCK, path := scratch_path(spark, "lod"), nodes_per_file=4)
    return rounded(binary.read_lod(spark, path, BLOCK).select("node_id", "x", "radius"), 4)


@query(
    "src11_snk07_sparse",
    f"""WITH {BLOCKS_SQL} SELECT block, pid AS idx, {f4('y')} AS y, {f4('g')} AS g, CAST(pid % 3 AS INTEGER) AS n, CASE WHEN pid % 3 > 0 THEN CAST(pid % 50 AS INTEGER) END AS camera,
      CASE WHEN pid % 3 > 0 THEN {f4('x')} END AS u FROM blocks""",
)
def sparse_file(spark, d) -> DataFrame:
    def pack(pdf):
        points = [(int(p.pid), p.x, p.y, p.z, p.r, p.g, p.b, [(int(p.pid % 50) + k, p.x, p.z) for k in range(p.pid % 3)]) for p in pdf.itertuples()]
        return binary.write_sparse(points, [])

    rows = binary.read_sparse(spark, packed(blocks(spark, d), spark, "prov", pack))
    first = F.get("measurements", F.lit(0))
    return rounded(rows.select(block_of(), "idx", F.col("y").cast("double"), F.col("g").cast("double"), F.size("measurements").alias("n"), first["camera"].alias("camera"), first["u"].cast("double").alias("u")), 4)


@query(
    "src11_cameras",
    f"SELECT n_regionkey AS block, CAST(n_nationkey AS INTEGER) AS camera, {f4('n_nationkey / 8.0')} AS focal, {f4('n_nationkey * 3.5')} AS cz, n_name AS name FROM nation",
)
def camera_block(spark, d) -> DataFrame:
    def pack(pdf):
        return binary.write_sparse([], [(int(c.pid), c.pid / 8.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, c.pid * 3.5, c.name) for c in pdf.itertuples(index=False)])

    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("pid"), F.col("n_regionkey").alias("block"), F.col("n_name").alias("name"))
    rows = binary.read_cameras(spark, packed(n, spark, "prov", pack))
    return rounded(rows.select(block_of(), "camera", F.col("focal").cast("double"), F.col("cz").cast("double"), "name"), 4)


@query(
    "src12_snk07_dense",
    f"""WITH {BLOCKS_SQL} SELECT block, ord AS pid, {f4('x')} AS x, {f4('b')} AS b, {f4('pid % 9 / 8.0')} AS ncc, CAST(pid % 4 AS INTEGER) AS seen, CASE WHEN pid % 4 > 0 THEN CAST(pid % 1000 AS INTEGER) END AS first_seen,
      CAST(pid % 3 AS INTEGER) AS not_seen FROM blocks""",
)
def dense_file(spark, d) -> DataFrame:
    """Points and side records in step, as a join on file and ordinal; every side record is as wide as the widest."""

    def side(pdf):
        return binary.write_dense_meta([(p % 9 / 8.0, [p % 1000] * (p % 4), [7] * (p % 3)) for p in pdf["pid"].tolist()], width)[0]

    width = 12 + 4 * (3 + 2)
    p = blocks(spark, d).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.6), "nz": F.lit(0.8)})
    points = binary.read_dense(spark, packed(p, spark, "prov", lambda pdf: binary.write_dense(pdf, width)))
    meta = binary.read_dense_meta(spark, packed(p, spark, "prov.meta", side), width)
    both = binary.dense_with_meta(points, meta)
    return rounded(both.select(block_of(), "pid", "x", "b", F.col("ncc").cast("double"), F.size("seen").alias("seen"), F.get("seen", F.lit(0)).alias("first_seen"), F.size("not_seen").alias("not_seen")), 4)


@query(
    "src14_27_nvm",
    f"""WITH {BLOCKS_SQL} SELECT block, ord AS idx, {f4('x')} AS x, {f4('g')} AS g, CAST(1 + pid % 2 AS INTEGER) AS uses, CAST(pid % 10 AS INTEGER) AS camera, {f4('y')} AS v, 0.0 AS error_x FROM blocks""",
)
def nvm(spark, d) -> DataFrame:
    """Model files of points with their measurements, as container points with features."""
    feature = F.concat_ws(" ", (F.col("pid") % 10).cast("string"), F.col("pid").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"))
    n = 1 + F.col("pid") % 2
    value = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x", "y", "z", "r", "g", "b")), n.cast("string"), F.array_repeat(feature, n.cast("int")))
    lines = blocks(spark, d).select("block", F.col("pid").alias("at"), value.alias("value"))
    counts = lines.groupBy("block").agg(F.lit(-1).cast("long").alias("at"), F.concat(F.lit("\n"), F.count("*").cast("string")).alias("value"))
    path = written(lines.unionByName(counts), spark, "nvm", "NVM_V3\n\n1\ncam0 0.5 1 0 0 0 1 2 3 0 0\n")
    points = structured.sparse_to_views(structured.read_nvm_points(spark, path), structured.read_nvm_cameras(spark, path))[0]
    first = F.get("features", F.lit(0))
    return rounded(points.select(block_of(), "idx", F.col("x").cast("double"), F.col("g").cast("double"), F.size("features").alias("uses"), first["camera"].alias("camera"), first["v"].cast("double").alias("v"), first["error_x"].alias("error_x")), 4)


@query(
    "src15_patches",
    f"WITH {BLOCKS_SQL} SELECT block, ord AS ordinal, {f4('x')} AS x, {f4('pid % 7 / 8.0')} AS ncc, CAST(2 AS INTEGER) AS seen, CAST(pid % 100 AS INTEGER) AS first_seen, CAST(pid % 5 AS INTEGER) AS unseen FROM blocks",
)
def patches(spark, d) -> DataFrame:
    """Patch records and binary PLY files in step."""
    p = blocks(spark, d)
    k = lambda m: (F.col("pid") % m).cast("string")
    value = F.concat_ws("\n", F.lit("PATCHS"), F.lit("0 0 0 1"), F.lit("0 0 1 0"), F.concat((F.col("pid") % 7 / 8.0).cast("string"), F.lit(" 0 0")), F.lit("2"), F.concat(k(100), F.lit(" 3")), F.lit("1"), k(5))
    path = written(p.select("block", F.col("pid").alias("at"), value.alias("value")), spark, "patch", "PATCHES\n")
    rows = structured.read_patches(spark, path, packed(p, spark, "ply", ply_bytes))
    return rounded(rows.select(block_of(), "ordinal", "x", F.col("ncc").cast("double"), F.size("seen").alias("seen"), F.get("seen", F.lit(0)).alias("first_seen"), F.get("not_seen", F.lit(0)).alias("unseen")), 4)


def ply_bytes(pdf) -> bytes:
    """A big-endian PLY file with faces after the vertices."""
    head = ["ply", "format binary_big_endian 1.0", f"element vertex {len(pdf)}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue"))]
    head += ["element face 0", "property list uchar int vertex_index", "end_header", ""]
    return "\n".join(head).encode() + binary.pack_records(pdf, [(c, ">f4") for c in "xyz"] + [(c, "u1") for c in "rgb"])


@query("src06_ply_binary", f"WITH {BLOCKS_SQL} SELECT block, ord AS ordinal, {f4('x')} AS x, {f4('z')} AS z, CAST(r AS DOUBLE) AS r, CAST(b AS DOUBLE) AS b, 255.0 AS a FROM blocks")
def ply_binary(spark, d) -> DataFrame:
    rows = structured.read_ply(spark, packed(blocks(spark, d), spark, "ply", ply_bytes))
    return rounded(rows.select(block_of(), "ordinal", "x", "z", "r", "b", "a"), 4)


@query("src18_snk10_fem_bin", f"WITH {BLOCKS_SQL} SELECT block, ord AS vertex, {f4('x')} AS u_x, {f4('radius')} AS mag_u, {f4('y')} AS eps_x FROM blocks")
def fem_bin(spark, d) -> DataFrame:
    """Step files of whole columns, one after the other."""
    from lodestone.model import FEM_ATTRIBUTES

    p = blocks(spark, d).withColumns({c: F.col("radius") for c in FEM_ATTRIBUTES} | {"u_x": F.col("x"), "eps_x": F.col("y")})
    rows = binary.read_fem_bin(spark, packed(p, spark, "bin", binary.write_fem_bin))
    return rounded(rows.select(block_of(), "vertex", "u_x", "mag_u", "eps_x"), 4)


@query(
    "src20_snk08_grid",
    "SELECT DISTINCT l_suppkey % 40 AS cell_id, CAST(l_linenumber % 2 AS INTEGER) AS model_id, l_partkey % 100 AS node_id FROM lineitem",
)
def grid(spark, d) -> DataFrame:
    """Bits of a visibility grid, some of its cells a file."""
    t = read(spark, d, "lineitem")
    seen = t.select((F.col("l_suppkey") % 40).alias("cell_id"), (F.col("l_linenumber") % 2).cast("int").alias("model_id"), (F.col("l_partkey") % 100).alias("node_id")).distinct()
    binary.write_cells(seen, [100, 100], path := scratch_path(spark, "pvs"), cells_per_file=16)
    return binary.read_grid(spark, path, [100, 100]).select("cell_id", "model_id", "node_id")


@query(
    "src21_obj",
    f"""WITH {BLOCKS_SQL}, v AS (SELECT block, ord // 3 AS face, ord % 3 AS corner, x, y, z FROM blocks)
    SELECT p.block, CASE WHEN p.face % 2 = 0 THEN 'even' ELSE 'odd' END AS material, round(p.x, 6) AS x0, round(q.y, 6) AS y1, round(r.z, 6) AS z2, 0.25 AS s0, 0.75 AS t2
    FROM v p JOIN v q ON q.block = p.block AND q.face = p.face AND q.corner = 1 JOIN v r ON r.block = p.block AND r.face = p.face AND r.corner = 2 WHERE p.corner = 0""",
)
def obj(spark, d) -> DataFrame:
    """Three vertices a face, the material changing with each."""
    p = blocks(spark, d).withColumn("at", F.col("pid"))
    value = F.concat_ws(" ", F.lit("v"), *(F.col(c).cast("string") for c in "xyz"))
    lines = p.select("block", "at", value.alias("value"))
    face = F.explode(F.expr("if(count >= 3, sequence(0, int(count / 3) - 1), array())")).alias("face")
    faces = lines.groupBy("block").agg(F.count("*").cast("int").alias("count")).select("block", face)
    refs = F.concat_ws(" ", F.lit("f"), *(F.concat((3 * F.col("face") + k).cast("string"), F.lit("/1" if k == 1 else "/2")) for k in (1, 2, 3)))
    body = F.concat_ws("\n", F.when(F.col("face") % 2 == 0, "usemtl even").otherwise("usemtl odd"), refs)
    lines = lines.unionByName(faces.select("block", (F.col("face") + F.lit(1 << 40)).alias("at"), body.alias("value")))
    rows = structured.read_obj(spark, written(lines, spark, "obj", "vt 0.25 0.5\nvt 0.5 0.75\n"))
    return rounded(rows.select(block_of(), "material", "x0", "y1", "z2", "s0", "t2"), 6)


@query("src21_materials", "SELECT n_regionkey AS block, replace(n_name, ' ', '_') AS material, replace(n_name, ' ', '_') || '.png' AS texture FROM nation")
def materials(spark, d) -> DataFrame:
    name = F.replace("n_name", F.lit(" "), F.lit("_"))
    value = F.concat(F.lit("newmtl "), name, F.lit("\nKd 1 1 1\nmap_Kd "), name, F.lit(".png"))
    lines = read(spark, d, "nation").select(F.col("n_regionkey").alias("block"), F.col("n_nationkey").alias("at"), value.alias("value"))
    return structured.read_materials(spark, written(lines, spark, "mtl")).select(block_of(), "material", "texture")


@query(
    "src25_dequantized",
    f"""WITH {PARTS_SQL} SELECT pid, node, CASE WHEN pid % 2048 = 2047 THEN 0.0 WHEN pid % 2048 = 1023 AND node = 0 THEN 1.5 ELSE round(1.5 - node / 10.0 + (pid % 2048) / 2046.0 * 2 * (node / 10.0), 6) + 0.0 END AS radius FROM parts""",
)
def dequantized(spark, d) -> DataFrame:
    p = parts(spark, d).select("pid", F.col("node").alias("node_id"), (F.col("pid") % 2048).alias("code"))
    nodes = spark.range(8).select(F.col("id").alias("node_id"), F.lit(1.5).alias("avg_radius"), (F.col("id") / 10.0).alias("max_radius_dev"))
    return rounded(binary.dequantized(p, nodes).select("pid", F.col("node_id").alias("node"), "radius"), 6)
