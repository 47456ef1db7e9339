"""Self-describing and mixed text formats: PLY, NVM, patches, OBJ with materials, packing logs, containers as tables."""

from __future__ import annotations

import io
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.binary import file_name, gathered, store
from lodestone.sources.text import fields

# Property types and the names that become surfel columns.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
PLY_COLUMNS = {
    "x": "x", "y": "y", "z": "z", "red": "r", "green": "g", "blue": "b", "diffuse_red": "r", "diffuse_green": "g", "diffuse_blue": "b",
    "nx": "nx", "ny": "ny", "nz": "nz", "radius": "radius", "alpha": "a",
}
SURFEL = ("x", "y", "z", "r", "g", "b", "a", "radius", "nx", "ny", "nz")


def _lines(stream, first: bytes):
    """Lines of a byte stream after its first bytes; a line end may be cut by the pieces read."""
    held, piece = "", first
    while piece:
        got = (held + piece.decode("latin-1")).splitlines(True)
        held = got.pop()
        yield from got
        piece = stream.read(1 << 20)
    if held:
        yield held


def ply_frames(stream, step: int = 50_000):
    """Vertices of an ASCII or binary PLY file in bounded frames; elements before them must have fixed width, later ones (faces) are skipped."""
    head = b""
    while b"end_header" not in head:
        if not (piece := stream.read(1 << 16)):
            raise ValueError("a PLY file without an end of its header")
        head += piece
    head, body = head.split(b"end_header", 1)
    while not body.lstrip(b"\r") and (piece := stream.read(1 << 16)):
        body += piece
    body = body.lstrip(b"\r").removeprefix(b"\n") or stream.read(1 << 16)
    kind, elements = "ascii", []
    for line in head.decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"] and elements:
            if w[1] == "list":
                elements[-1][2].append((w[4], None))
            elif w[1] not in PLY_TYPES:
                raise ValueError(f"unknown property type {w[1]}")
            else:
                elements[-1][2].append((w[2], PLY_TYPES[w[1]]))
    lines = _lines(stream, body) if kind == "ascii" else None

    def taken(n: int) -> bytes:
        nonlocal body
        if len(body) < n:
            body += stream.read(n - len(body))
        out, body = body[:n], body[n:]
        return out

    for name, n, props in elements:
        if name != "vertex":
            if any(t is None for _, t in props) and kind != "ascii":
                raise ValueError("a list stands before the vertices")
            width = 0 if kind == "ascii" else np.dtype([(p, t) for p, t in props]).itemsize
            for m in _steps(n, step):
                if kind == "ascii":
                    for _ in itertools.islice(lines, m):
                        pass
                else:
                    taken(m * width)
            continue
        unknown = [p for p, _ in props if p not in PLY_COLUMNS]
        if unknown:
            raise ValueError(f"unknown properties: {', '.join(unknown)}")
        order = np.dtype([(p, (">" if kind == "binary_big_endian" else "<") + t) for p, t in props]) if kind != "ascii" else None
        for m in _steps(n, step):
            if kind == "ascii":
                rows = np.array([ln.split()[: len(props)] for ln in itertools.islice(lines, m)], float).reshape(m, len(props))
                out = pd.DataFrame({PLY_COLUMNS[p]: rows[:, i] for i, (p, _) in enumerate(props)})
            else:
                rec = np.frombuffer(taken(m * order.itemsize), order, m)
                out = pd.DataFrame({PLY_COLUMNS[p]: rec[p].astype(float) for p, _ in props})
            for c in SURFEL:
                if c not in out:
                    out[c] = 255.0 if c == "a" else 0.0
            yield out[list(SURFEL)]
        return


def _steps(n: int, step: int):
    return (min(step, n - i) for i in range(0, n, step))


def ply_vertices(content: bytes) -> pd.DataFrame:
    """All vertices of a PLY file's bytes."""
    frames = list(ply_frames(io.BytesIO(content)))
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=list(SURFEL), dtype=float)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of PLY files, streamed by the executors: a file is a task's, but never whole in memory."""

    def frames(batches):
        for b in batches:
            for at in b["path"]:
                files, name = store(at)
                n = 0
                with files.open_input_stream(name) as stream:
                    for rows in ply_frames(stream):
                        yield rows.assign(path=at, ordinal=np.arange(n, n + len(rows)))[["path", "ordinal", *SURFEL]]
                        n += len(rows)

    named = spark.read.format("binaryFile").load(path).select("path")
    return named.mapInPandas(lambda batches: gathered(frames(batches)), "path string, ordinal long, " + ", ".join(f"{c} double" for c in SURFEL))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0) and value: whole files are read for their order, then their lines are rows."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    return whole.select("path", F.posexplode(lines).alias("line", "value"))


def read_nvm_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of an NVM_V3 file with measurements (camera, u, v); the feature index between them is dropped."""
    lines = _numbered(spark, path).where(F.trim("value") != "")
    numbered = lines.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line")))
    # The first line names the format, the second counts the cameras; a count of points follows those.
    cameras = numbered.where("n = 2").select("path", F.trim("value").cast("int").alias("cameras"))
    rows = numbered.join(cameras, "path").where(F.col("n") > F.col("cameras") + 3)
    f = fields(F.col("value"))
    rows = rows.where(F.size(f) >= 7)
    m = F.transform(
        F.sequence(F.lit(0), F.get(f, F.lit(6)).cast("int") - 1),
        lambda i: F.struct(
            F.get(f, 7 + 4 * i).cast("int").alias("camera"), F.get(f, 9 + 4 * i).cast("float").alias("u"), F.get(f, 10 + 4 * i).cast("float").alias("v")
        ),
    )
    has = F.get(f, F.lit(6)).cast("int") > 0
    none = F.array().cast("array<struct<camera:int,u:float,v:float>>")
    cols = [F.get(f, F.lit(i)).cast("float").alias(c) for i, c in enumerate(("x", "y", "z", "r", "g", "b"))]
    return rows.select("path", (F.col("n") - F.col("cameras") - 4).cast("long").alias("idx"), *cols, F.when(has, m).otherwise(none).alias("measurements"))


def read_nvm_cameras(spark: SparkSession, path: str) -> DataFrame:
    lines = _numbered(spark, path).where(F.trim("value") != "")
    numbered = lines.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line")))
    cameras = numbered.where("n = 2").select("path", F.trim("value").cast("int").alias("cameras"))
    f = fields(F.col("value"))
    names = ("focal", "qw", "qx", "qy", "qz", "cx", "cy", "cz")
    rows = numbered.join(cameras, "path").where((F.col("n") > 2) & (F.col("n") <= F.col("cameras") + 2))
    return rows.select("path", (F.col("n") - 3).cast("int").alias("camera"), F.get(f, F.lit(0)).alias("name"), *(F.get(f, F.lit(i + 1)).cast("float").alias(c) for i, c in enumerate(names)))


def sparse_to_views(points: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Container tables: points with features (one use, no error) and views with their poses."""
    features = F.transform("measurements", lambda m: F.struct(m["camera"].alias("camera"), F.lit(1).alias("uses"), m["u"].alias("u"), m["v"].alias("v"), F.lit(0.0).alias("error_x"), F.lit(0.0).alias("error_y")))
    return points.withColumn("features", features).drop("measurements"), cameras.select(F.col("camera").alias("camera_id"), *(c for c in cameras.columns if c != "camera"))


def read_patches(spark: SparkSession, patches: str, points: str) -> DataFrame:
    """Patch records (consistency, seen and unseen images) in step with the vertices of the PLY file of the same name and order."""
    # A file is cut at its marks where it is read, so no lines are shuffled or sorted.
    whole = spark.read.text(patches, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    records = F.slice(F.split("value", "(?md)^ *PATCHS *$"), 2, 2**31 - 1)
    # After the mark: position, normal, consistency; a count and the seen images; a count and the unseen ones.
    got = whole.select("path", F.posexplode(records).alias("patch", "value")).withColumn("at", F.split("value", "\n"))
    line = lambda k: fields(F.get("at", F.lit(k)))
    ints = lambda k: F.transform(line(k), lambda t: t.try_cast("int"))
    got = got.select("path", F.col("patch").cast("long").alias("patch"), F.get(line(3), F.lit(0)).try_cast("float").alias("ncc"), ints(5).alias("seen"), ints(7).alias("not_seen"))
    stem = F.regexp_extract(file_name(), r"^([^/]*)\.[^.]*$", 1).alias("_stem")
    got = got.select(stem, F.col("patch").alias("ordinal"), "ncc", "seen", "not_seen")
    return read_ply(spark, points).select(stem, "*").join(got, ["_stem", "ordinal"]).drop("_stem")


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of OBJ files with positions, texture coordinates and the material in force; polygons become fans."""
    lines = _numbered(spark, path).withColumn("f", fields(F.col("value"))).withColumn("kind", F.get("f", F.lit(0)))
    order = Window.partitionBy("path", "kind").orderBy("line")
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    v = lines.where("kind = 'v'").select("path", F.row_number().over(order).alias("v"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"))
    vt = lines.where("kind = 'vt'").select("path", F.row_number().over(order).alias("vt"), number(1).alias("s"), number(2).alias("t"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("material", F.last(F.when(F.col("kind") == "usemtl", F.get("f", F.lit(1))), ignorenulls=True).over(before))
    faces = lines.where("kind = 'f'").select("path", "line", "material", "f", F.explode(F.sequence(F.lit(2), F.size("f") - 2)).alias("fan"))
    corner = F.array(F.get("f", F.lit(1)), F.get("f", F.col("fan")), F.get("f", F.col("fan") + 1))
    long = faces.select("path", "line", "fan", "material", F.posexplode(corner).alias("corner", "ref"))
    part = F.split("ref", "/")
    long = long.withColumn("v", F.get(part, F.lit(0)).try_cast("int")).withColumn("vt", F.get(part, F.lit(1)).try_cast("int"))
    long = long.join(v, ["path", "v"]).join(vt, ["path", "vt"], "left")
    wide = long.groupBy("path", "line", "fan", "material").agg(
        *(F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in ("x", "y", "z", "s", "t"))
    )
    return wide


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """Material names with their texture files, and the file that names them."""
    lines = _numbered(spark, path).withColumn("f", fields(F.col("value")))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("material", F.last(F.when(F.get("f", F.lit(0)) == "newmtl", F.get("f", F.lit(1))), ignorenulls=True).over(before))
    return lines.where(F.get("f", F.lit(0)) == "map_Kd").select("path", "material", F.get("f", F.lit(1)).alias("texture"))


def parse_packing(lines: DataFrame, line: str = "line", value: str = "value") -> DataFrame:
    """Tiles of a packing log (name, x, y, width, height); comments go, and the first other line describes the atlas."""
    good = lines.where(~F.trim(value).startswith("#") & (F.trim(value) != ""))
    first = good.agg(F.min(line).alias("_first"))
    f = fields(F.col(value))
    rows = good.join(F.broadcast(first), F.col(line) > F.col("_first"))  # one row
    return rows.select(F.get(f, F.lit(0)).alias("name"), *(F.get(f, F.lit(i + 1)).try_cast("int").alias(c) for i, c in enumerate(("tx", "ty", "tw", "th"))))


# The container's segments are tables; writing is Parquet per segment, reading the same.
CONTAINER = ("views", "sparse_points", "atlas", "atlas_tiles", "octree")


def write_container(tables: dict[str, DataFrame], path: str) -> None:
    for name in CONTAINER:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def read_container(spark: SparkSession, path: str, names: tuple[str, ...] = CONTAINER) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_tree(nodes: DataFrame, tree: dict, path: str) -> None:
    """Nodes sorted by id, so that reads of a node or depth skip row groups, and the one-row tree table."""
    nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").write.mode("overwrite").parquet(f"{path}/nodes")
    nodes.sparkSession.createDataFrame([tuple(tree.values())], list(tree)).write.mode("overwrite").parquet(f"{path}/tree")


def extract_depth(nodes_points: DataFrame, depth: int, fan: int, translation: tuple[float, float, float]) -> DataFrame:
    """Points with a radius of one depth of the tree, moved back by the translation; the id range prunes the scan."""
    from lodestone.functions.tree import first_of_depth, length_of_depth

    first = first_of_depth(depth, fan)
    at = nodes_points.where(F.col("node_id").between(first, first + length_of_depth(depth, fan) - 1) & (F.col("radius") > 0))
    return at.withColumns({c: F.col(c) + t for c, t in zip("xyz", translation, strict=True)})
