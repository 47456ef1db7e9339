"""Queries of text and binary formats: rows of the tables are written out in a format and read back through its reader."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.model import PARTS_SQL, SURFELS_SQL, parts, read, rounded, scratch_path, surfels
from lodestone.plans.registry import query
from lodestone.sources import structured, text

POINT = """round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b"""


def _points(spark, df: DataFrame, layout: str, *cols: str) -> DataFrame:
    """Points of text files that hold the columns of df; the files' ending names the layout."""
    lines = df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in cols)).alias("value"))
    lines.write.text(path := scratch_path(spark, f"points.{layout}"))
    return text.read_points(spark, path)


@query("src01_xyz", f"WITH {SURFELS_SQL} SELECT x, y, z, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, 255 AS a, 0.0 AS radius FROM surfels")
def xyz(spark, d) -> DataFrame:
    return _points(spark, surfels(spark, d), "xyz", "x", "y", "z", "r", "g", "b").select("x", "y", "z", "r", "g", "b", "a", "radius")


@query("src02_xyz_all", f"WITH {SURFELS_SQL} SELECT x, y, z, nx, ny, nz, CAST(r AS INTEGER) AS r, radius FROM surfels")
def xyz_all(spark, d) -> DataFrame:
    return _points(spark, surfels(spark, d), "xyz_all", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "radius").select("x", "y", "z", "nx", "ny", "nz", "r", "radius")


@query("src03_xyz_cpn", f"WITH {SURFELS_SQL} SELECT x, y, z, CAST(b AS INTEGER) AS b, radius, nz FROM surfels")
def xyz_cpn(spark, d) -> DataFrame:
    return _points(spark, surfels(spark, d), "xyz_cpn", "x", "y", "z", "r", "g", "b", "radius", "nx", "ny", "nz").select("x", "y", "z", "b", "radius", "nz")


@query("src04_xyz_grey", f"WITH {SURFELS_SQL} SELECT x, y, z, CAST(r AS INTEGER) AS r, CAST(r AS INTEGER) AS g, CAST(r AS INTEGER) AS b FROM surfels")
def xyz_grey(spark, d) -> DataFrame:
    return _points(spark, surfels(spark, d), "xyz_grey", "x", "y", "z", "r").select("x", "y", "z", "r", "g", "b")


@query("src07_provenance", "SELECT l_orderkey AS k, CAST(len([l_tax, l_discount]) AS INTEGER) AS n, round(CAST(CAST(l_tax AS FLOAT) AS DOUBLE), 5) AS first FROM lineitem")
def provenance(spark, d) -> DataFrame:
    t = read(spark, d, "lineitem")
    line = F.concat_ws(" ", F.lit("1 2 3 4 5 6"), F.concat_ws(", ", F.col("l_tax").cast("string"), F.col("l_discount").cast("string")))
    rows = text.parse_provenance(t.select(F.col("l_orderkey").alias("k"), line.alias("value")), skip=6, width=2)
    return rounded(rows.select("k", F.size("values").alias("n"), F.get("values", F.lit(0)).cast("double").alias("first")), 5)


@query("src13_range_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 400")
def range_scan(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").where("l_orderkey >= 100 and l_orderkey < 400").select("l_orderkey", "l_partkey", "l_quantity")


@query("src17_19_fem", "SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS step, user_id AS vertex, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS u_x FROM events")
def fem(spark, d) -> DataFrame:
    """Events written as one folder a type, read back as steps in the order of the names."""
    path = scratch_path(spark, "fem")
    e = read(spark, d, "events")
    line = F.concat_ws(" ", F.col("user_id").cast("string"), F.col("value").cast("string"), *(F.lit("0") for _ in range(8)))
    e.select("event_type", line.alias("value")).write.partitionBy("event_type").text(path)
    lines = spark.read.text(path)
    steps = lines.select("event_type").distinct()
    from pyspark.sql.window import Window

    steps = steps.withColumn("step", F.row_number().over(Window.orderBy("event_type")) - 1)  # one row a step
    rows = text.parse_fem(lines).join(steps, "event_type")
    return rounded(rows.select("step", "vertex", F.col("u_x").cast("double").alias("u_x")), 3)


@query("src24_scanners", "SELECT c_custkey AS k, c_acctbal AS sx, 1.5 AS sy, -2.0 AS sz FROM customer WHERE length(CAST(c_acctbal AS VARCHAR) || ' 1.5 -2.0') > 9")
def scanners(spark, d) -> DataFrame:
    lines = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.col("c_acctbal").cast("string"), F.lit(" 1.5 -2.0")).alias("value"))
    return text.scanner_positions(lines)


@query(
    "src26_tables",
    """WITH r AS (SELECT o_custkey AS point_id, o_orderkey, o_totalprice / 100.0 AS error, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
    SELECT point_id, round(error, 4) AS error FROM r WHERE rn = 1""",
)
def tables(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    lines = o.select(F.col("o_orderkey").alias("line"), F.concat_ws(" ", F.col("o_custkey").cast("string"), (F.col("o_totalprice") / 100.0).cast("string")).alias("value"))
    noise = spark.createDataFrame([(-1, "// a comment"), (-2, "x")], "line long, value string")
    return rounded(text.parse_table(lines.unionByName(noise), "worldPointDetectionError").select("point_id", "error"), 4)


@query("src06_ply", f"WITH {PARTS_SQL} SELECT row_number() OVER (ORDER BY pid) - 1 AS ordinal, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM parts")
def ply(spark, d) -> DataFrame:
    """Parts as one ASCII PLY file and back; a file of this format has one count of vertices, so one task writes it."""
    path = scratch_path(spark, "ply")
    p = parts(spark, d)
    n = p.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property float {c}" for c in "xyz"), "property uchar red", "property uchar green", "property uchar blue", "end_header"]
    first = spark.createDataFrame([(-1, "\n".join(head))], "pid long, value string")
    body = first.unionByName(p.select("pid", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x", "y", "z", "r", "g", "b"))).alias("value")))
    body.coalesce(1).sortWithinPartitions("pid").select("value").write.text(path)
    return rounded(structured.read_ply(spark, path + "/part-*").select("ordinal", "x", "y", "z", "r", "g", "b"), 4)


@query("snk01_text", f"WITH {PARTS_SQL} SELECT pid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, CAST(r AS INTEGER) AS r FROM parts")
def text_sink(spark, d) -> DataFrame:
    """Lines of the writer, parsed again."""
    lines = text.format_points(parts(spark, d).withColumn("a", F.lit(255)), "xyz", keep=("pid",))
    return rounded(text.parse_points(lines, "xyz").select("pid", "x", "y", "z", "r"), 9)


@query("snk02_04_14_parquet", f"WITH {PARTS_SQL} SELECT pid, x, y, z, radius, node FROM parts")
def parquet_sink(spark, d) -> DataFrame:
    path = scratch_path(spark, "tree")
    structured.write_tree(parts(spark, d).withColumn("node_id", F.col("node")), {"fan": 2, "depth": 3}, path)
    return spark.read.parquet(f"{path}/nodes").select("pid", "x", "y", "z", "radius", "node")


@query(
    "prj24_provenance_schema",
    "SELECT CAST(i AS INTEGER) AS i, name, 'float' AS type FROM (VALUES (0, 'mean_absolute_deviation'), (1, 'standard_deviation'), (2, 'coefficient_of_variation'), (3, 'value_0'), (4, 'value_1')) AS t(i, name)",
)
def provenance_schema(spark, d) -> DataFrame:
    schema = text.provenance_schema(text.provenance_descriptor(2))
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)], "i int, name string, type string")
