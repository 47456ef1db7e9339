"""Text readers and writers of point clouds, series, scanner positions and photogrammetry tables.

Lines are read by Spark's text source, so files split; fields are cast in the
JVM. Lines with too few fields give nulls, which the finite filter drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The column orders of the text formats.
LAYOUTS = {
    "xyz": ("x", "y", "z", "r", "g", "b", "a"),
    "xyz_all": ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "radius", "a"),
    "xyz_cpn": ("x", "y", "z", "r", "g", "b", "radius", "nx", "ny", "nz"),
    "xyz_grey": ("x", "y", "z", "grey"),
}
COLOR = ("r", "g", "b", "a", "grey")
FEM = ("vertex", "u_x", "u_y", "u_z", "sig_xx", "tau_xy", "tau_xz", "tau_abs", "sig_v", "eps_x")


def fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def parse_points(lines: DataFrame, layout: str, value: str = "value") -> DataFrame:
    """Surfel columns of text lines; radius and normal default to 0, alpha to 255."""
    part = fields(F.col(value))
    get = lambda i: F.get(part, F.lit(i))
    cols = {}
    for i, name in enumerate(LAYOUTS[layout]):
        cols[name] = get(i).try_cast("int" if name in COLOR else "double")
    if "grey" in cols:
        cols |= {c: cols["grey"] for c in "rgb"}
        del cols["grey"]
    cols["a"] = F.coalesce(cols.get("a", F.lit(None).cast("int")), F.lit(255))
    for name in ("radius", "nx", "ny", "nz"):
        cols[name] = F.coalesce(cols.get(name, F.lit(None).cast("double")), F.lit(0.0))
    keep = [c for c in lines.columns if c != value]
    order = ("x", "y", "z", "r", "g", "b", "a", "radius", "nx", "ny", "nz")
    return lines.where(F.trim(value) != "").select(*keep, *(cols[c].alias(c) for c in order))


def read_points(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """Points of a text file; the layout is that of the file's ending unless named."""
    return parse_points(spark.read.text(path), layout or path.rstrip("/").rsplit(".", 1)[-1])


def parse_provenance(lines: DataFrame, skip: int = 0, width: int | None = None, value: str = "value") -> DataFrame:
    """``values`` of lines separated by commas or spaces, without the first ``skip``; more than ``width`` is an error."""
    part = F.filter(F.split(F.trim(value), "[,\\s]+"), lambda t: t != "")
    values = F.transform(F.slice(part, skip + 1, 1_000_000), lambda t: t.try_cast("float"))
    if width is not None:
        values = F.when(F.size(values) > width, F.raise_error(F.lit("too many provenance values"))).otherwise(values)
    return lines.select(*(c for c in lines.columns if c != value), values.alias("values"))


def format_points(df: DataFrame, layout: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One text line per point with 15 significant digits, beside the ``keep`` columns."""
    return df.select(*keep, F.concat_ws(" ", *(F.col(c).cast("int").cast("string") if c in COLOR else significant(F.col(c)) for c in LAYOUTS[layout])).alias("value"))


def significant(v: Column) -> Column:
    """A number with 15 significant digits, without trailing zeros."""
    d = v.cast("double")
    places = F.greatest(F.lit(0), F.lit(14) - F.when(d == 0, 0).otherwise(F.floor(F.log10(F.abs(d)))).cast("int"))
    digits = [F.when(places == k, F.format_string(f"%.{k}f", d)) for k in range(21)]
    text = F.coalesce(*digits, F.format_string("%.14e", d))
    return F.when(text.contains(".") & ~text.contains("e"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def write_points(df: DataFrame, path: str, layout: str) -> None:
    format_points(df, layout).write.option("lineSep", "\r\n").mode("overwrite").text(path)


def parse_fem(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of a series step; the header line has no leading number."""
    part = fields(F.col(value))
    cols = [F.get(part, F.lit(i)).try_cast("long" if i == 0 else "float").alias(c) for i, c in enumerate(FEM)]
    return lines.select(*(c for c in lines.columns if c != value), *cols).where(F.col("vertex").isNotNull() & F.col("eps_x").isNotNull())


def read_fem(spark: SparkSession, path: str) -> DataFrame:
    """A folder of step files; steps are numbered by file name."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    rows = parse_fem(lines)
    steps = rows.select("file").distinct().withColumn("step", F.row_number().over(Window.orderBy("file")) - 1)  # one row a file
    return rows.join(steps, "file")


def scanner_positions(lines: DataFrame, value: str = "value") -> DataFrame:
    """Positions of lines with more than nine characters."""
    part = fields(F.col(value))
    good = lines.where(F.length(value) > 9)
    return good.select(*(c for c in lines.columns if c != value), *(F.get(part, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("sx", "sy", "sz"))))


# The columns of the photogrammetry tables, the first ``keys`` of them being the key.
TABLES = {
    "cameraNames": ("camera_id int, name string", 1),
    "cameraIntrinsics": ("camera_id int, focal double, px double, py double", 1),
    "cameraDistortions": ("camera_id int, k1 double, k2 double", 1),
    "cameraPoses": ("camera_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double", 1),
    "worldPoints": ("point_id long, x double, y double, z double, r int, g int, b int", 1),
    "worldPointDetectionError": ("point_id long, error double", 1),
    "features": ("camera_id int, feature_id long, u double, v double", 2),
}


def parse_table(lines: DataFrame, name: str, line: str = "line", value: str = "value", offset: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """A table of space-separated lines; comment and short lines go, and of equal keys the last line stays."""
    columns, keys = TABLES[name]
    names = [c.split() for c in columns.split(", ")]
    part = fields(F.col(value))
    good = lines.where(~F.trim(value).startswith("//") & (F.length(value) > 1))
    rows = good.select(F.col(line).alias("_line"), *(F.get(part, F.lit(i)).try_cast(t).alias(c) for i, (c, t) in enumerate(names)))
    key = [c for c, _ in names[:keys]]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_line").desc()))
    rows = rows.withColumn("_last", last).where("_last = 1").drop("_last", "_line")
    if name == "worldPoints":
        rows = rows.withColumns({c: (F.col(c) + o).cast("float") for c, o in zip("xyz", offset, strict=True)})
    return rows


def camera_file(camera: Column, name: Column | None = None) -> Column:
    """File name of a camera: its name or the id padded to eight digits, with .jpg."""
    return F.concat(name if name is not None else F.lpad(camera.cast("string"), 8, "0"), F.lit(".jpg"))


def provenance_schema(descriptor: str):
    """Struct type of a provenance descriptor: a JSON list of {name, type} with int, float, vec3i and vec3f."""
    import json

    from pyspark.sql import types as T

    kinds = {"int": T.IntegerType(), "float": T.FloatType(), "vec3i": T.ArrayType(T.IntegerType()), "vec3f": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(e["name"], kinds[e["type"]]) for e in json.loads(descriptor)])


def provenance_descriptor(width: int) -> str:
    """Descriptor of the three deviation values and ``width`` more, all float."""
    import json

    names = ["mean_absolute_deviation", "standard_deviation", "coefficient_of_variation", *(f"value_{i}" for i in range(width))]
    return json.dumps([{"name": n, "type": "float"} for n in names])
