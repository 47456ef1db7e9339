"""Point-set views of the driver tables, and the schemas of the data model.

Points are flat columns, so that scans prune columns and use min/max
statistics. Schemas are DDL texts, which every reader takes. A missing value is NULL inside; sentinels are converted at sources
and sinks only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SURFEL = (
    "pid long, x double, y double, z double, r short, g short, b short, a short, radius double, nx double, ny double, nz double"
)
NODE = (
    "node_id long, depth int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, "
    "cx double, cy double, cz double, avg_radius double, max_radius_dev double, reduction_error double, n long"
)
PROV = ("pid long, mad float, sd float, cv float, values array<float>")
DENSE = ("pid long, x float, y float, z float, r float, g float, b float, nx float, ny float, nz float")
DENSE_META = ("pid long, ncc float, seen array<int>, not_seen array<int>")
SPARSE = (
    "idx long, x float, y float, z float, r float, g float, b float, measurements array<struct<camera:int,u:float,v:float>>"
)
CAMERA = ("camera int, focal float, qw float, qx float, qy float, qz float, cx float, cy float, cz float, path string")
VISIBILITY = ("cell_id long, model_id int, node_id long")
FEM_ATTRIBUTES = ("u_x", "u_y", "u_z", "mag_u", "sig_xx", "tau_xy", "tau_xz", "tau_abs", "sig_v", "eps_x")
INVALID_NODE = 4294967295

#: The same view in SQL, for the checks.
SURFELS_SQL = """surfels AS (
  SELECT l_orderkey * 65536 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pid,
    l_quantity AS x, l_extendedprice / 2000.0 AS y, l_discount * 500.0 AS z,
    l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b, 255 AS a,
    CASE WHEN l_tax = 0 THEN 0.0 ELSE 0.05 + l_tax END AS radius,
    (l_discount - 0.05) / sqrt((l_discount - 0.05) * (l_discount - 0.05) + (l_tax - 0.04) * (l_tax - 0.04) + 0.01) AS nx,
    (l_tax - 0.04) / sqrt((l_discount - 0.05) * (l_discount - 0.05) + (l_tax - 0.04) * (l_tax - 0.04) + 0.01) AS ny,
    0.1 / sqrt((l_discount - 0.05) * (l_discount - 0.05) + (l_tax - 0.04) * (l_tax - 0.04) + 0.01) AS nz,
    l_shipdate, l_suppkey, l_partkey
  FROM lineitem
)"""
PARTS_SQL = """parts AS (
  SELECT p_partkey AS pid, (p_partkey * 37 % 1009) / 10.0 AS x, p_retailprice / 20.0 AS y, p_size * 2.0 AS z,
    p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b, 0.5 + p_size / 20.0 AS radius,
    p_partkey % 8 AS node
  FROM part
)"""
ORDERS_SQL = """cloud2 AS (
  SELECT o_orderkey AS pid, (o_orderkey * 53 % 1013) / 10.0 AS x, o_totalprice / 5000.0 AS y, (o_custkey % 101) * 1.0 AS z,
    o_custkey * 11 % 256 AS r
  FROM orders
)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surfels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as surfels. ``pid`` numbers the lines of an order, so no window spans the table."""
    t = read(spark, sf_dir, "lineitem")
    own = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    d, t_ = F.col("l_discount") - 0.05, F.col("l_tax") - 0.04
    norm = F.sqrt(d * d + t_ * t_ + 0.01)
    return t.select(
        (F.col("l_orderkey") * 65536 + F.row_number().over(own)).alias("pid"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000.0).alias("y"), (F.col("l_discount") * 500.0).alias("z"),
        (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"), F.lit(255).alias("a"),
        F.when(F.col("l_tax") == 0, 0.0).otherwise(0.05 + F.col("l_tax")).alias("radius"),
        (d / norm).alias("nx"), (t_ / norm).alias("ny"), (F.lit(0.1) / norm).alias("nz"), "l_shipdate", "l_suppkey", "l_partkey",
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a small cloud with radii and an eight-way node."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("pid"), ((k * 37 % 1009) / 10.0).alias("x"), (F.col("p_retailprice") / 20.0).alias("y"), (F.col("p_size") * 2.0).alias("z"),
        (k * 7 % 256).alias("r"), (k * 13 % 256).alias("g"), (k * 29 % 256).alias("b"), (0.5 + F.col("p_size") / 20.0).alias("radius"),
        (k % 8).alias("node"),
    )


def orders_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a second cloud."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("pid"), ((k * 53 % 1013) / 10.0).alias("x"), (F.col("o_totalprice") / 5000.0).alias("y"),
        ((F.col("o_custkey") % 101) * 1.0).alias("z"), (F.col("o_custkey") * 11 % 256).alias("r"),
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; adding 0.0 makes a negative zero positive."""
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a local master may do without: it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lodestone-")
    return "file://" + _LOCAL[app]


_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove the scratch tables written so far; frames that read them are of no use afterwards. It is also done at exit."""
    while _WRITTEN:
        path = _WRITTEN.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder is scratch space
            pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, removed by release()."""
    if not _WRITTEN:
        atexit.unregister(release)
        atexit.register(release, spark)
    _WRITTEN.append(path := f"{scratch_dir(spark)}/lodestone-{uuid.uuid4().hex}-{name}")
    return path


def cut(df: DataFrame, name: str = "level") -> DataFrame:
    """Write df to the shared scratch folder and read it again: driver loops over levels keep short plans and survive lost executors."""
    df.write.parquet(path := scratch_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
