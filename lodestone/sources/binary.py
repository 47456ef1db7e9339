"""Binary readers: fixed records, big-endian provenance, series dumps, bit sets, node-blocked files.

``binaryFile`` gives whole files; files of fixed records are read in slices, so
large ones are split. A task takes many small files or slices and gives their
rows in frames of many files. Files are written by the executors, from bounded
groups of rows. Bytes become columns with numpy structured types.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Record layouts.
XYZ_BIN = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("a", "u1"), ("radius", "<f4"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4")]
DENSE = [("x", ">f4"), ("y", ">f4"), ("z", ">f4"), ("r", ">f4"), ("g", ">f4"), ("b", ">f4"), ("nx", ">f4"), ("ny", ">f4"), ("nz", ">f4")]

_SQL = {"f": "double", "u": "int", "i": "long"}


def _ddl(fields: list) -> str:
    return ", ".join(f"{n} {_SQL[np.dtype(t).kind]}" for n, t in fields)


def _frame(records: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({n: records[n].astype("f8" if records[n].dtype.kind == "f" else "i8") for n in records.dtype.names})


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def file_name(path: str = "path") -> Column:
    """A path after its last slash: an expression that looks for the end of a name in the whole path costs the square of its length, in each row."""
    return F.substring_index(path, "/", -1)


def store(path: str):
    """File system and path within it of a URI or a plain path, for the executors."""
    from pyarrow import fs

    if ":" not in path.split("/", 1)[0]:
        path = "file://" + path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def write_files(named: DataFrame, path: str) -> int:
    """Write each row (name, content) as a file of the folder; gives the number of files.

    The executors write. A file gets its name when it is whole, so a task that
    runs twice leaves one file.
    """

    def run(batches):
        at = None
        for b in batches:
            at = at or _folder(path)
            for name, content in zip(b["name"], b["content"], strict=True):
                _put(*at, name, [content])
            yield pd.DataFrame({"n": [len(b)]})

    return named.select("name", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _folder(path: str):
    """File system and path within it of a folder that is there from now on."""
    files, at = store(path)
    files.create_dir(at, recursive=True)
    return files, at


def _put(files, at: str, name: str, pieces) -> None:
    with files.open_output_stream(part := f"{at}/.{name}-{uuid.uuid4().hex}") as out:
        for piece in pieces:
            out.write(piece)
    files.move(part, f"{at}/{name}")


def in_files(df: DataFrame, by: Column, order: list[str], make) -> DataFrame:
    """name and content of the file of each group: ``make`` gives them for the group's rows, in that order.

    A task takes its groups one after the other from large batches, as a frame of
    Spark's own for each group would cost more than a small group's rows.
    """

    def run(batches):
        held: list = []
        made = lambda group: make(group.reset_index(drop=True))
        for b in batches:
            key, out = b["_file"].to_numpy(), []
            if held and len(key) and held[-1]["_file"].iloc[-1] != key[0]:
                out, held = [made(pd.concat(held))], []
            ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1), len(b)]
            for lo, hi in itertools.pairwise([0, *ends]):
                if hi < len(b):
                    out.append(made(pd.concat([*held, b.iloc[lo:hi]]) if held else b.iloc[lo:hi]))
                    held = []
                elif hi > lo:
                    held.append(b.iloc[lo:hi])
            if out:
                yield pd.DataFrame(out, columns=["name", "content"])
        if held:
            yield pd.DataFrame([made(pd.concat(held))], columns=["name", "content"])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_file", by).repartition(tasks, "_file").sortWithinPartitions("_file", *order)
    return rows.mapInPandas(run, "name string, content binary")


#: Slices that a task reads at most.
SLICES = 1024


def write_records(df: DataFrame, layout: list, path: str, order: str, rows_per_file: int = 1_000_000) -> None:
    """Fixed records in files whose names follow the order, about ``rows_per_file`` each, streamed by the executors."""
    names = [n for n, _ in layout]

    def run(batches):
        from pyspark import TaskContext

        frames = (pack_records(b, layout) for b in batches)
        first = next(frames, None)
        if first is not None:
            _put(*_folder(path), f"part-{TaskContext.get().partitionId():08d}.bin", itertools.chain([first], frames))
        yield pd.DataFrame({"n": [1]})

    n = -(-df.count() // rows_per_file) or 1
    sorted_ = df.repartitionByRange(n, order).sortWithinPartitions(order)
    sorted_.select(*names).mapInPandas(run, "n long").agg(F.sum("n")).first()


def read_records(spark: SparkSession, path: str, layout: list, header: int = 0, column: str = "ordinal", slice_rows: int = 1_000_000) -> DataFrame:
    """Fixed-width records of files after a header, with their file and ordinal. Only names and sizes are listed; slices of files are rows to a task.

    Small slices share a task and a frame, so neither grows in number with the files.
    """
    kind = np.dtype(layout)
    sizes = spark.read.format("binaryFile").load(path).select("path", F.floor((F.col("length") - header) / kind.itemsize).alias("n")).where("n > 0")
    slices = sizes.select("path", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(slice_rows))).alias("lo"))

    def joined(held):
        sizes = [len(r) for *_, r in held]
        rows = _frame(np.concatenate([r for *_, r in held]))
        first = np.repeat([i for _, i, _ in held] - np.cumsum([0, *sizes[:-1]]), sizes)
        rows.insert(0, "path", np.repeat(np.array([at for at, *_ in held], object), sizes))
        rows.insert(1, column, np.arange(len(rows)) + first)
        return rows

    def run(batches):
        held, size = [], 0
        for b in batches:
            for at, n, lo in zip(b["path"], b["n"], b["lo"], strict=True):
                files, name = store(at)
                end = min(n, lo + slice_rows)
                with files.open_input_file(name) as f:
                    for i in range(lo, end, 100_000):
                        m = min(100_000, end - i)
                        held.append((at, i, np.frombuffer(f.read_at(m * kind.itemsize, header + i * kind.itemsize), kind)))
                        size += m
                        if size >= 100_000:
                            yield joined(held)
                            held, size = [], 0
        if held:
            yield joined(held)

    count, rows = slices.agg(F.count("*"), F.sum(F.least(F.lit(slice_rows), F.col("n") - F.col("lo")))).first()
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // slice_rows), -(-count // SLICES))
    return slices.repartition(max(1, min(count, least, 10_000))).mapInPandas(run, f"path string, {column} long, {_ddl(layout)}")


def read_xyz_bin(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, XYZ_BIN)


def pack_records(pdf: pd.DataFrame, layout: list) -> bytes:
    out = np.zeros(len(pdf), np.dtype(layout))
    for name, _ in layout:
        out[name] = pdf[name].to_numpy()
    return out.tobytes()


# Provenance files start with two magic bytes and the length of the rest.
MAGIC = b"\xaf\xfe"


def framed(body: bytes) -> bytes:
    return MAGIC + struct.pack(">Q", len(body)) + body


def unframed(content: bytes) -> bytes:
    if content[:2] != MAGIC:
        raise ValueError("not a provenance file")
    return content[10 : 10 + struct.unpack_from(">Q", content, 2)[0]]


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """Dense provenance points: count and side record width, then nine big-endian floats a point."""
    return read_records(spark, path, DENSE, header=18, column="pid")


def write_dense(points: pd.DataFrame, meta_width: int) -> bytes:
    return framed(struct.pack(">II", len(points), meta_width) + pack_records(points, DENSE))


def write_dense_meta(rows: list[tuple[float, list[int], list[int]]], width: int = 12) -> tuple[bytes, int]:
    """The side file (consistency, counted seen and unseen images, padded to one width of at least ``width``) and that width."""
    out = [struct.pack(">fI", ncc, len(s)) + np.array(s, ">u4").tobytes() + struct.pack(">I", len(u)) + np.array(u, ">u4").tobytes() for ncc, s, u in rows]
    width = max([width, *map(len, out)])
    return framed(b"".join(x.ljust(width, b"\0") for x in out)), width


def gathered(frames, rows: int = 50_000):
    """Frames of small files joined until they have so many rows."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _decoded(spark: SparkSession, path: str, decode, ddl: str, step: int = 50_000) -> DataFrame:
    """Rows of a variable-length decoder, yielded in bounded frames of one or many files."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches):
        held: list = []
        for b in batches:
            for at, content in zip(b["path"], b["content"], strict=True):
                for row in decode(content):
                    held.append((at, *row))
                    if len(held) == step:
                        yield pd.DataFrame(held, columns=["path", *names])
                        held = []
        if held:
            yield pd.DataFrame(held, columns=["path", *names])

    return files(spark, path).mapInPandas(run, f"path string, {ddl}")


def read_dense_meta(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Side records of a dense file; ``width`` is named in the points file."""

    def decode(content: bytes):
        body = unframed(content)
        for pid in range(len(body) // width):
            at = pid * width
            ncc, k = struct.unpack_from(">fI", body, at)
            seen = np.frombuffer(body, ">u4", k, at + 8).tolist()
            m = struct.unpack_from(">I", body, at + 8 + 4 * k)[0]
            yield pid, ncc, seen, np.frombuffer(body, ">u4", m, at + 12 + 4 * k).tolist()

    return _decoded(spark, path, decode, "pid long, ncc float, seen array<int>, not_seen array<int>")


def dense_with_meta(points: DataFrame, meta: DataFrame) -> DataFrame:
    """The positional zip of points and their side files (``a.prov`` and ``a.prov.meta``), as a join on file name and ordinal.

    Spark only sees the size of the files' names, and would send all points to the driver; so the sides merge.
    """
    stem = F.regexp_replace(file_name(), r"\.meta$", "")
    side = meta.select(stem.alias("_stem"), *(c for c in meta.columns if c != "path"))
    return points.withColumn("_stem", stem).join(side.hint("merge"), ["_stem", "pid"]).drop("_stem")


_MEASURE = np.dtype([("camera", ">u2"), ("u", ">f4"), ("v", ">f4")])
_CAMERA = ">H8f"  # index, focal length, quaternion w x y z, centre


def _sparse_parts(content: bytes):
    """Points with their measurements, then cameras, of a sparse file."""
    body = unframed(content)
    (n, _), at = struct.unpack_from(">II", body), 8
    points = []
    for _ in range(n):
        values, at = struct.unpack_from(">I6fH", body, at), at + 30
        m = np.frombuffer(body, _MEASURE, values[7], at)
        at += _MEASURE.itemsize * values[7]
        points.append((*values[:7], [{"camera": c, "u": u, "v": v} for c, u, v in m.tolist()]))
    (k, _, length), at = struct.unpack_from(">HIH", body, at), at + 8
    cameras = []
    for _ in range(k):
        values, at = struct.unpack_from(_CAMERA, body, at), at + struct.calcsize(_CAMERA)
        cameras.append((*values, body[at : at + length].decode().strip()))
        at += length
    return points, cameras


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    ddl = "idx long, x float, y float, z float, r float, g float, b float, measurements array<struct<camera:int,u:float,v:float>>"
    return _decoded(spark, path, lambda c: _sparse_parts(c)[0], ddl)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    ddl = "camera int, focal float, qw float, qx float, qy float, qz float, cx float, cy float, cz float, name string"
    return _decoded(spark, path, lambda c: _sparse_parts(c)[1], ddl)


def write_sparse(points: list[tuple], cameras: list[tuple]) -> bytes:
    """Points (idx, x, y, z, r, g, b, [(camera, u, v)]) and cameras (index, focal, w, x, y, z, cx, cy, cz, name)."""
    out = [struct.pack(">II", len(points), 0)]
    for *values, ms in points:
        out.append(struct.pack(">I6fH", *values, len(ms)) + b"".join(struct.pack(">Hff", *m) for m in ms))
    length = max((len(c[-1].encode()) for c in cameras), default=0)
    out.append(struct.pack(">HIH", len(cameras), 0, length))
    out += [struct.pack(_CAMERA, *c[:-1]) + c[-1].encode().ljust(length) for c in cameras]
    return framed(b"".join(out))


def read_fem_bin(spark: SparkSession, path: str) -> DataFrame:
    """Step files of ten concatenated float columns, a tenth of the file each."""
    from lodestone.model import FEM_ATTRIBUTES

    def frames(batches):
        for b in batches:
            for at, content in zip(b["path"], b["content"], strict=True):
                cols = np.frombuffer(content, "<f4").reshape(len(FEM_ATTRIBUTES), -1)
                yield pd.DataFrame(dict(zip(FEM_ATTRIBUTES, cols.astype("f8"), strict=True))).assign(path=at, vertex=np.arange(cols.shape[1]))[["path", "vertex", *FEM_ATTRIBUTES]]

    return files(spark, path).mapInPandas(lambda batches: gathered(frames(batches)), "path string, vertex long, " + ", ".join(f"{c} double" for c in FEM_ATTRIBUTES))


def write_fem_bin(pdf: pd.DataFrame) -> bytes:
    from lodestone.model import FEM_ATTRIBUTES

    return b"".join(pdf[c].to_numpy("<f4").tobytes() for c in FEM_ATTRIBUTES)


def read_grid_header(spark: SparkSession, path: str) -> dict:
    """Kind, cells per axis, cell size, centre and nodes per model of a regular grid's header; a few numbers."""
    words = " ".join(r["value"] for r in spark.read.text(path).collect()).split()
    models = int(words[6])
    return {"kind": words[0], "side": int(words[1]), "size": float(words[2]), "center": tuple(map(float, words[3:6])), "nodes": [int(w) for w in words[7 : 7 + models]]}


def write_grid_header(head: dict) -> str:
    return "\n".join([head["kind"], str(head["side"]), repr(head["size"]), " ".join(map(repr, head["center"])), str(len(head["nodes"])), *map(str, head["nodes"])]) + "\n"


def read_grid(spark: SparkSession, path: str, nodes: list[int]) -> DataFrame:
    """Visibility bits: for each cell and model its nodes, least bit first, in whole bytes."""
    sizes = [-(-n // 8) for n in nodes]

    def decode(content: bytes):
        for c in range(len(content) // sum(sizes)):
            at = c * sum(sizes)
            for m, (n, size) in enumerate(zip(nodes, sizes, strict=True)):
                bits = np.unpackbits(np.frombuffer(content, np.uint8, size, at), bitorder="little")[:n]
                at += size
                for node in np.flatnonzero(bits).tolist():
                    yield c, m, node

    rows = _decoded(spark, path, decode, "cell_id long, model_id int, node_id long")
    first = F.coalesce(F.regexp_extract("path", r"cells-(\d+)\.[a-z]+$", 1).try_cast("long"), F.lit(0))
    return rows.withColumn("cell_id", F.col("cell_id") + first)


def write_cells(visible: DataFrame, nodes: list[int], path: str, cells_per_file: int = 64) -> None:
    """Visibility bits of (cell_id, model_id, node_id) in files of consecutive cells, named by the first; a cell has at most sum(nodes) rows."""

    def run(pdf):
        first = int(pdf["cell_id"].iloc[0]) // cells_per_file * cells_per_file
        own = pdf.assign(cell_id=pdf["cell_id"] - first)
        return f"cells-{first:08d}.pvs", write_grid(own, int(own["cell_id"].max()) + 1, nodes)

    block = F.floor(F.col("cell_id") / cells_per_file)
    write_files(in_files(visible.select("cell_id", "model_id", "node_id"), block, [], run), path)


def write_grid(visible: pd.DataFrame, cells: int, nodes: list[int]) -> bytes:
    out = []
    for c in range(cells):
        for m, n in enumerate(nodes):
            bits = np.zeros(-(-n // 8) * 8, np.uint8)
            bits[visible.loc[(visible["cell_id"] == c) & (visible["model_id"] == m), "node_id"].to_numpy(int)] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(out)


def read_lod(spark: SparkSession, path: str, surfels_per_node: int, fields: list | None = None) -> DataFrame:
    """Node-blocked files: every node has the same number of records; empty ones (radius 0) are padding."""
    rows = read_records(spark, path, fields or XYZ_BIN)
    first = F.coalesce(F.regexp_extract("path", r"nodes-(\d+)\.[a-z]+$", 1).try_cast("long"), F.lit(0))
    return rows.withColumn("node_id", first + F.floor(F.col("ordinal") / surfels_per_node)).where(F.col("radius") > 0)


def write_nodes(points: DataFrame, surfels_per_node: int, path: str, nodes_per_file: int = 1024) -> None:
    """Node-blocked files of consecutive nodes, named by the first. A node with more points than its size is an error."""

    def run(pdf):
        first = int(pdf["node_id"].iloc[0]) // nodes_per_file * nodes_per_file
        own = pdf.assign(node_id=pdf["node_id"] - first)
        return f"nodes-{first:08d}.lod", write_lod(own, surfels_per_node)

    block = F.floor(F.col("node_id") / nodes_per_file)
    names = [n for n, _ in XYZ_BIN]
    write_files(in_files(points.select("node_id", *names), block, [], run), path)


def write_lod(pdf: pd.DataFrame, surfels_per_node: int) -> bytes:
    """Nodes in order, each padded with empty records."""
    out = []
    groups = dict(list(pdf.groupby("node_id")))
    for node in range(int(pdf["node_id"].max()) + 1 if len(pdf) else 0):
        own = groups.get(node, pdf.iloc[:0])
        if len(own) > surfels_per_node:
            raise ValueError(f"node {node} has {len(own)} points, its size is {surfels_per_node}")
        out.append(pack_records(own, XYZ_BIN) + bytes(np.dtype(XYZ_BIN).itemsize * (surfels_per_node - len(own))))
    return b"".join(out)


def dequantized(quantized: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sizes of an 11-bit code back to radii by the node's mean and deviation, and the node's mean of those."""
    at = quantized.join(nodes.select("node_id", "avg_radius", "max_radius_dev"), "node_id")
    spread = F.col("avg_radius") - F.col("max_radius_dev") + F.col("code") / 2046.0 * 2 * F.col("max_radius_dev")
    radius = F.when(F.col("code") == 2047, 0.0).when(F.col("code") == 1023, F.when(F.col("max_radius_dev") == 0, F.col("avg_radius")).otherwise(spread)).otherwise(spread)
    return at.withColumn("radius", radius)
