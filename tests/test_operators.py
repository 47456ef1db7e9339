"""Known cases and invariants of the point-set operators."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry as geo
from lodestone.functions import tree
from lodestone.operators import attributes, mesh, neighbors, partition, reductions, visibility
from lodestone.sources import binary, structured, text
from lodestone.streaming.cut_scheduler import schedule, update_cut

#: Known cases of overlapping disks, by normal, centre and radius.
OVERLAPS = [
    ((1, 0, 0), (0, 0, 0), 1, (1, 0, 0), (0, 1.999, 0), 1, True),
    ((1, 0, 0), (0, 0, 0), 1, (1, 0, 0), (0, 2.01, 0), 1, False),
    ((1, 0, 0), (0, 0, 0), 1.001, (0, 1, 0), (1, 0, 0), 1.001, True),
    ((1, 0, 0), (0, 0, 0), 1, (0, 1, 0), (2, 0, 0), 1, False),
    ((0.363, 0.765, -0.532), (-1.005, 0.465, -0.017), 0.06668, (0.363, 0.765, -0.532), (-0.998, 0.445, -0.041), 0.06668, True),
]


@pytest.mark.parametrize("n1,p1,r1,n2,p2,r2,want", OVERLAPS)
def test_disk_overlap(spark, n1, p1, r1, n2, p2, r2, want):
    lit = lambda v: tuple(F.lit(float(c)) for c in v)
    got = spark.range(1).select(geo.disks_overlap(lit(p1), lit(n1), F.lit(float(r1)), lit(p2), lit(n2), F.lit(float(r2))).alias("o")).first()["o"]
    assert got is want
    rows = np.array([[*p1, *n1, 0, 0, 0, r1], [*p2, *n2, 0, 0, 0, r2]], float)
    assert bool(reductions.overlap_matrix(rows)[0, 1]) is want


def test_entropy_merges_overlapping_and_keeps_input():
    rows = np.array([[0, 0, 0, 1, 0, 0, 255, 0, 0, 1], [1, 0, 0, 0, 0, 1, 0, 0, 255, 1]], float)
    before = rows.copy()
    out = reductions.STRATEGIES["entropy"](rows, 1, np.random.default_rng(0))
    assert (rows == before).all()
    assert np.allclose(out[0, :3], [0.5, 0, 0]) and np.allclose(out[0, 3:6], [0.7071, 0, 0.7071], atol=1e-3)
    assert np.allclose(out[0, 6:9], [127.5, 0, 127.5]) and np.isclose(out[0, 9], 1.5)


def test_entropy_returns_first_of_two_apart():
    rows = np.array([[0, 0, 0, 1, 0, 0, 255, 0, 0, 1], [3, 0, 0, 0, 0, 1, 0, 0, 255, 1]], float)
    assert np.allclose(reductions.STRATEGIES["entropy"](rows, 1, np.random.default_rng(0)), rows[:1])


@pytest.mark.parametrize("name", sorted(reductions.STRATEGIES))
def test_reductions_keep_invariants(name):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.random((90, 3)) * 10, reductions.unit(rng.normal(size=(90, 3))), rng.integers(0, 256, (90, 3)), rng.random((90, 1)) + 0.3], axis=1)
    before = rows.copy()
    out = reductions.STRATEGIES[name](rows, 16, np.random.default_rng(1))
    assert 0 < len(out) <= 16 and (rows == before).all()
    assert (out[:, :3] >= rows[:, :3].min(0) - 1e-9).all() and (out[:, :3] <= rows[:, :3].max(0) + 1e-9).all()
    assert (out[:, 9] >= 0).all()
    assert np.allclose(out, reductions.STRATEGIES[name](rows, 16, np.random.default_rng(1)))


def test_knn_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.random() * 9, rng.random() ** 3 * 40, float(rng.randint(0, 3))) for i in range(300)] + [(300, 500.0, 500.0, 500.0), (301, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    got = {(r["pid"], r["rank"]): r["neighbor"] for r in neighbors.knn(df, df, 4, same=True).collect()}
    for i, *p in rows[:301]:
        order = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for j, *q in rows[:301] if j != i)
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in order[:4]]


def test_knn_of_far_queries_copies_and_large_groups_in_bounded_blocks(spark):
    from lodestone.operators import nearest

    rng = np.random.default_rng(7)
    xyz = np.round(np.concatenate([rng.random((2500, 3)) * (50, 2, 50), np.full((1500, 3), 7.0)]), 1)  # ties and one place with many
    pdf = pd.DataFrame(xyz, columns=list("xyz")).assign(pid=np.arange(4000), node=np.arange(4000) % 2)
    far = pd.DataFrame(rng.random((300, 3)) * (50, 4000, 50), columns=list("xyz")).assign(pid=np.arange(300))
    points, queries = spark.createDataFrame(pdf), spark.createDataFrame(far)

    def brute(q, p, k, same):
        want = set()
        for i, at in zip(q["pid"], q[list("xyz")].to_numpy(), strict=True):
            rows = p[p["pid"] != i] if same else p
            d = rows[list("xyz")].to_numpy() - at
            d2 = d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2
            want |= {(int(i), int(rows["pid"].iloc[j]), n + 1) for n, j in enumerate(np.lexsort((rows["pid"], d2))[:k])}
        return want

    got = {(r["pid"], r["neighbor"], r["rank"]) for r in neighbors.knn(queries, points, 3).collect()}
    assert got == brute(far, pdf, 3, False)
    rows = neighbors.knn_in_group(points, "node", 4).collect()
    got = {(r["pid"], r["neighbor"], r["rank"]) for r in rows}
    assert got == brute(pdf[pdf["node"] == 0], pdf[pdf["node"] == 0], 4, True) | brute(pdf[pdf["node"] == 1], pdf[pdf["node"] == 1], 4, True)
    assert all(r["node"] == r["pid"] % 2 == r["neighbor"] % 2 for r in rows)
    tree = nearest.Tree(xyz[:2500], 16, 0)
    assert np.unique(tree.place(xyz[:2500]), return_counts=True)[1].max() < 4 * 16


def test_natural_neighbours_come_from_all_points(spark):
    rng = np.random.default_rng(5)
    xyz = rng.random((80, 3)) * (9, 9, 1)
    df = spark.createDataFrame([(i, i % 8, *map(float, p)) for i, p in enumerate(xyz)], "pid long, node long, x double, y double, z double")
    got = {(r["pid"], r["neighbor"]): r["weight"] for r in attributes.tree_natural_neighbours(df).collect()}
    want = {}
    for i, p in enumerate(xyz):
        d = ((xyz - p) ** 2).sum(1)
        near = np.array([j for j in np.argsort(d, kind="stable") if j != i][:24])
        local = xyz[near] - p
        w = attributes._cell_weights(local @ np.linalg.eigh(np.cov(local.T))[1][:, 1:])
        want |= {(i, int(j)): v for j, v in zip(near, w, strict=True) if v > 0}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_weights_of_many_points_equal_those_of_each():
    rng = np.random.default_rng(9)
    local = rng.normal(size=(300, 24, 3)) * (4, 4, 0.5)
    local[:40] = np.round(local[:40])  # ties, and neighbours at the point itself
    local[5:15, 2:] = np.nan  # too few
    local[15:30, 9:] = np.nan
    got = attributes.plane_weights_of_many(local)
    for i, rows in enumerate(local):
        apart = (rows**2).sum(1) > 0
        assert np.allclose(got[i][apart], attributes.plane_weights(rows[apart]), atol=1e-9) and not got[i][~apart].any()


def test_natural_neighbours_query_crosses_nodes(spark):
    from lodestone.plans import registry

    rows = registry.queries()["jn20_21_natural_neighbours"](spark, "/root/testdata/sf0.001").collect()
    assert any(r["pid"] % 8 != r["neighbor"] % 8 for r in rows) and any(r["pid"] % 8 == r["neighbor"] % 8 for r in rows)


def test_split_sizes_and_tree_choice(spark):
    df = spark.range(103).select(F.col("id").alias("pid"), (F.col("id") * 7 % 11).cast("double").alias("v"), F.lit(0).alias("g"))
    sizes = {r["run"]: r["n"] for r in partition.split_runs(df, "g", "v", 4).groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert [sizes[k] for k in range(4)] == [26, 26, 26, 25]
    fan, depth = partition.choose_tree(100_000, 1024, 8)
    assert 2 <= fan <= 8 and abs(1024 - 100_000 / fan**depth) <= 1024


def test_balanced_parts(spark):
    df = spark.range(2000).select(F.col("id").alias("pid"), (F.col("id") % 97 * 1.0).alias("x"), (F.col("id") % 13 * 1.0).alias("y"), F.lit(0.0).alias("z"))
    sizes = [r["count"] for r in partition.balanced_split(df, 8).groupBy("part").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 250
    assert max(r["count"] for r in partition.halved(df, 300).groupBy("part").count().collect()) <= 300


def test_tree_arithmetic(spark):
    for fan in (2, 3, 8):
        rows = spark.range(200).select("id", tree.parent(F.col("id"), fan).alias("p"), tree.depth_of(F.col("id"), fan, 12).alias("d"), tree.ancestors(F.col("id"), fan, 12).alias("a")).collect()
        for r in rows:
            up, n = [], r["id"]
            while n > 0:
                n = (n - 1) // fan
                up.append(n)
            assert r["a"] == up and r["d"] == len(up) and r["p"] == (up[0] if up else None)


def test_irregular_merge_and_polarity(spark):
    rows = [(c, 0, n) for c in (0, 1) for n in range(10)] + [(2, 0, n) for n in range(50, 60)]
    v = spark.createDataFrame(rows, "cell_id long, model_id int, node_id long")
    got = {r["cell_id"]: r["grp"] for r in visibility.merged_cells(v, 0.95, 100).collect()}
    assert got[0] == got[1] and got[2] != got[0]
    assert visibility.unpacked_cells(visibility.packed_cells(v, 2)).count() == len(rows)


def greedy_merge(seen, threshold, total):
    """Merge the first pair by share, then by smaller group numbers, until none reaches the threshold."""
    sets, group = {c: set(v) for c, v in seen.items()}, {c: c for c in seen}
    while True:
        pairs = [((total - len(sets[p]) - len(sets[q]) + 2 * len(sets[p] & sets[q])) / total, -p, -q) for p in sets for q in sets if p < q and sets[p] & sets[q]]
        best = max(pairs, default=(-1.0, 0, 0))
        if best[0] < threshold:
            return group
        p, q = -best[1], -best[2]
        sets[p] &= sets.pop(q)
        group = {c: p if g == q else g for c, g in group.items()}


def test_irregular_merge_runs_to_the_end(spark):
    cells = {c: range(10) for c in range(24)} | {50 + c: range(40, 45 + c) for c in range(4)}
    rows = [(c, 0, n) for c, nodes in cells.items() for n in nodes]
    v = spark.createDataFrame(rows, "cell_id long, model_id int, node_id long")
    for threshold in (0.97, 0.99):
        got = {r["cell_id"]: r["grp"] for r in visibility.merged_cells(v, threshold, 100).collect()}
        assert got == greedy_merge(cells, threshold, 100)
        assert len({got[c] for c in range(24)}) == 1


def test_binary_formats_round_trip(spark, tmp_path):
    points = pd.DataFrame({c: np.arange(5, dtype=np.float32) for c in ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")})
    meta, width = binary.write_dense_meta([(0.5, [1, 2], [3]), (0.25, [], []), (1.0, [9], [8, 7]), (0.0, [], [1]), (0.1, [4], [])])
    (tmp_path / "dense.prov").write_bytes(binary.write_dense(points, width))
    (tmp_path / "dense.prov.meta").write_bytes(meta)
    dense = binary.read_dense(spark, str(tmp_path / "dense.prov"))
    both = binary.dense_with_meta(dense, binary.read_dense_meta(spark, str(tmp_path / "dense.prov.meta"), width))
    rows = {r["pid"]: r for r in both.collect()}
    assert len(rows) == 5 and rows[0]["seen"] == [1, 2] and rows[2]["not_seen"] == [8, 7] and rows[4]["x"] == 4.0

    camera = (0, 0.5, 0.1, 0.1, 0.1, 0.1, 0.8, 0.8, 0.8, "path")
    (tmp_path / "sparse.prov").write_bytes(binary.write_sparse([(0, 0.2, 0.2, 0.2, 1, 1, 1, [(0, 0.3, 0.3)])], [camera]))
    point = binary.read_sparse(spark, str(tmp_path / "sparse.prov")).first()
    assert point["idx"] == 0 and abs(point["measurements"][0]["u"] - 0.3) < 1e-6
    back = binary.read_cameras(spark, str(tmp_path / "sparse.prov")).first()
    assert back["name"] == "path" and abs(back["cz"] - 0.8) < 1e-6

    visible = pd.DataFrame({"cell_id": [0, 1, 1], "model_id": [0, 0, 1], "node_id": [3, 9, 0]})
    head = {"kind": "regular", "side": 1, "size": 2.0, "center": (0.0, 0.0, 0.0), "nodes": [10, 4]}
    (tmp_path / "a.grid").write_text(binary.write_grid_header(head))
    (tmp_path / "a.pvs").write_bytes(binary.write_grid(visible, 2, [10, 4]))
    assert binary.read_grid_header(spark, str(tmp_path / "a.grid")) == head
    got = sorted((r["cell_id"], r["model_id"], r["node_id"]) for r in binary.read_grid(spark, str(tmp_path / "a.pvs"), [10, 4]).collect())
    assert got == [(0, 0, 3), (1, 0, 9), (1, 1, 0)]

    fem = pd.DataFrame({c: np.arange(3, dtype=np.float32) for c in ("u_x", "u_y", "u_z", "mag_u", "sig_xx", "tau_xy", "tau_xz", "tau_abs", "sig_v", "eps_x")})
    (tmp_path / "s0.bin").write_bytes(binary.write_fem_bin(fem))
    assert binary.read_fem_bin(spark, str(tmp_path / "s0.bin")).count() == 3

    rec = pd.DataFrame({c: [1, 2, 3] for c in ("x", "y", "z", "r", "g", "b", "a", "radius", "nx", "ny", "nz")}).assign(node_id=[0, 0, 1])
    (tmp_path / "t.lod").write_bytes(binary.write_lod(rec, 4))
    assert sorted(r["node_id"] for r in binary.read_lod(spark, str(tmp_path / "t.lod"), 4).collect()) == [0, 0, 1]


def test_many_small_files_share_tasks_and_frames(spark, tmp_path):
    points = pd.DataFrame({c: np.arange(3, dtype=np.float32) for c in ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")})
    for i in range(40):
        (tmp_path / f"dense-{i}.prov").write_bytes(binary.write_dense(points[: i % 4] + i, 12))
    dense = binary.read_dense(spark, str(tmp_path))
    assert dense.select(F.spark_partition_id()).distinct().count() <= 4
    got = sorted((r["path"].rsplit("-", 1)[1], r["pid"], r["x"]) for r in dense.collect())
    assert got == sorted((f"{i}.prov", k, float(i + k)) for i in range(40) for k in range(i % 4))
    assert binary.read_dense(spark, str(tmp_path / "dense-0.prov")).count() == 0

    sliced = sorted(r["ordinal"] for r in binary.read_records(spark, str(tmp_path / "dense-3.prov"), binary.DENSE, 18, slice_rows=2).collect())
    assert sliced == [0, 1, 2]
    joined = binary.dense_with_meta(dense, dense.select("path", "pid", F.col("x").alias("ncc")))
    assert joined.count() == len(got) and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_files_of_groups_over_batches(spark):
    sizes = {g: 1 + g * g % 23 for g in range(30)}
    rows = [(g, k) for g, n in sizes.items() for k in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "block long, pid long")
    make = lambda pdf: (f"f-{pdf['block'].iloc[0]}", bytes(pdf["pid"].tolist()))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "7", kept):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted((r["name"], bytes(r["content"])) for r in binary.in_files(df, F.col("block"), ["pid"], make).collect())
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
        assert got == sorted((f"f-{g}", bytes(range(n))) for g, n in sizes.items())


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.nvm").write_text("NVM_V3\n\n2\ncam0 0.5 1 0 0 0 1 2 3 0 0\ncam1 0.5 1 0 0 0 4 5 6 0 0\n\n1\n0.1 0.2 0.3 10 20 30 2 0 7 1.5 2.5 1 8 3.5 4.5\n")
    p = structured.read_nvm_points(spark, str(tmp_path / "a.nvm")).collect()
    assert len(p) == 1 and [(m["camera"], m["u"]) for m in p[0]["measurements"]] == [(0, 1.5), (1, 3.5)]
    assert [r["name"] for r in structured.read_nvm_cameras(spark, str(tmp_path / "a.nvm")).orderBy("camera").collect()] == ["cam0", "cam1"]
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 0\nusemtl m\nf 1/1 2/1 3/1 4/1\n")
    faces = structured.read_obj(spark, str(tmp_path / "a.obj")).collect()
    assert len(faces) == 2 and {f["material"] for f in faces} == {"m"}
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nelement face 0\nproperty list uchar int i\nend_header\n1 2 3\n")
    assert structured.read_ply(spark, str(tmp_path / "a.ply")).first()["z"] == 3.0
    lines = spark.createDataFrame([("# x",), ("atlas 10 10",), ("a.jpg 1 2 3 4",)], "value string").withColumn("line", F.monotonically_increasing_id())
    assert structured.parse_packing(lines).first()["ty"] == 2
    empty = spark.createDataFrame([], "value string")
    assert text.parse_points(empty, "xyz").count() == 0
    short = spark.createDataFrame([("1 2",), ("",), (None,)], "value string")
    assert text.parse_points(short, "xyz").first()["z"] is None


def test_mesh_cleaning(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 1.0, 0.0, 0.0), (5, 9.0, 9.0, 9.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 4, 3, 2), (2, 0, 1, 4), (3, 1, 2, 0)], "tri_id long, a long, b long, c long")
    faces, left = mesh.cleaned(t, v, least_faces=2)
    assert sorted(r["tri_id"] for r in faces.collect()) == [0, 1]
    assert sorted(r["vid"] for r in left.collect()) == [0, 1, 2, 3]


def test_cut_scheduler(spark):
    cut = {0}
    error = {n: 8.0 / (n + 1) for n in range(7)}
    assert update_cut(cut, error, 2, 2.5, 8) == [(0, "split")] and cut == {1, 2}
    update_cut(cut, error, 2, 2.5, 8)
    assert cut == {3, 4, 5, 6}  # errors 4 and 8 / 3 are both above the threshold and its hysteresis
    update_cut(cut, {n: 0.1 for n in range(7)}, 2, 2.5, 8)
    assert 1 in cut
    rows = [(0, f, n, 8.0 / (n + 1)) for f in range(3) for n in range(7)]
    df = spark.createDataFrame(rows, "view_id long, frame long, node_id long, error double")
    assert schedule(df, 2, 2.5, 8).count() >= 2


def test_scheduler_query_reads_all_nodes(spark, monkeypatch):
    from lodestone.plans import registry
    from lodestone.streaming import cut_scheduler

    given = []
    monkeypatch.setattr(cut_scheduler, "schedule", lambda errors, *a: given.append(errors) or schedule(errors, *a))
    assert registry.queries()["cut02_scheduler"](spark, "/root/testdata/sf0.01").count() > 0
    assert given[0].select("node_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.01/part.parquet").count()


@pytest.mark.parametrize("kind", ["far", "equal", "plane"])
def test_neighbours_of_uneven_clouds(spark, kind):
    rng = random.Random(11)
    xyz = [(rng.random(), rng.random(), 0.0 if kind == "plane" else rng.random()) for _ in range(200)]
    xyz = [(0.5, 0.5, 0.5)] * 60 if kind == "equal" else xyz + [(1e6, 0.0, 0.0)] * (kind == "far")
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")
    got = {(r["pid"], r["rank"]): r["neighbor"] for r in neighbors.knn(df, df, 3, same=True).collect()}
    for i, p in enumerate(xyz):
        want = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for j, q in enumerate(xyz) if j != i)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [j for _, j in want]
    size = neighbors.cell_size(df.select("x", "y", "z"), 4.0)
    assert size < 1.0 if kind != "equal" else size == 0.0


@pytest.mark.parametrize("value", ["id * 0.0", "id % 3 * 1.0", "if(id = 7, 1e12, id / 7.0)", "exp(id / 400.0)"])
def test_ranks_of_ties_and_far_values(spark, value):
    df = spark.range(8000).select(F.col("id").alias("pid"), (F.col("id") % 5 == 0).alias("g"), F.expr(f"double({value})").alias("v")).persist()
    buckets = partition.bucketed(df, "g", "v", rows_per_bucket=50).groupBy("g", "_before").count()
    assert buckets.agg(F.max("count")).first()[0] <= 200
    got = partition.ranked(df, "g", "v", rows_per_bucket=50).toPandas()
    want = df.toPandas().sort_values(["g", "v", "pid"])
    want["rank"] = want.groupby("g").cumcount() + 1
    both = got.merge(want, on=["g", "pid"])
    assert len(got) == len(both) == 8000 and (both["rank_x"] == both["rank_y"]).all()
    assert (got["n"] == got.groupby("g")["pid"].transform("size")).all()


def test_records_in_slices_and_padded_nodes(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("pid"), *(F.col("id").cast("double").alias(c) for c in ("x", "y", "z", "r", "g", "b", "a", "radius", "nx", "ny", "nz")))
    df = df.withColumns({c: F.col("pid") % 256 for c in "rgba"} | {"radius": F.col("pid") % 7 + 1.0})
    binary.write_records(df, binary.XYZ_BIN, str(tmp_path / "r"), "pid", rows_per_file=300)
    assert len(list((tmp_path / "r").glob("part-*.bin"))) == 4 and not list((tmp_path / "r").glob(".*"))
    got = binary.read_records(spark, str(tmp_path / "r"), binary.XYZ_BIN, slice_rows=37).toPandas()
    assert sorted(got["x"]) == list(range(1000))
    for _, own in got.groupby("path"):
        assert sorted(own["ordinal"]) == list(range(len(own))) and own.sort_values("ordinal")["x"].diff().dropna().eq(1).all()
    empty = df.limit(0)
    binary.write_records(empty, binary.XYZ_BIN, str(tmp_path / "e"), "pid")
    assert binary.write_files(spark.createDataFrame([], "name string, content binary"), str(tmp_path / "e")) == 0
    nodes = df.withColumn("node_id", F.floor(F.col("pid") / 10) * 2)
    binary.write_nodes(nodes, 16, str(tmp_path / "n"), nodes_per_file=32)
    rows = binary.read_lod(spark, str(tmp_path / "n"), 16).toPandas()
    assert sorted(zip(rows["node_id"], rows["x"])) == sorted((int(i // 10 * 2), float(i)) for i in range(1000))
    with pytest.raises(Exception, match="its size is 4"):
        binary.write_nodes(nodes, 4, str(tmp_path / "m"))


def test_spatial_random_interpolates_by_natural_neighbours():
    """Sibson weights reproduce linear functions inside the hull: colours that are linear in the place stay as they are."""
    x, y = np.meshgrid(np.arange(12.0), np.arange(12.0))
    place = np.stack([x.ravel(), y.ravel()], axis=1) + np.random.default_rng(2).uniform(-0.3, 0.3, (144, 2))
    rows = np.zeros((144, 10))
    rows[:, :2], rows[:, 5], rows[:, 9] = place, 1, 1
    rows[:, 6:9] = 10 * place[:, :1] + 3 * place[:, 1:] + [0, 5, 50]
    # one surfel with another colour: the mean is of its neighbours, not of itself
    rows[78, 6:9] = 0
    inside = [78, *(i for i in range(144) if 1 < x.ravel()[i] < 10 and 1 < y.ravel()[i] < 10 and np.hypot(*(place[i] - place[78])) > 3)]
    out = reductions.STRATEGIES["spatial_random"](rows, 143, np.random.default_rng(0))
    checked = 0
    for i in inside:
        for got in out[np.all(out[:, :2] == place[i], axis=1)]:
            assert np.allclose(got[6:9], 10 * place[i, 0] + 3 * place[i, 1] + np.array([0, 5, 50]), atol=1e-6)
            assert np.allclose(got[3:6], [0, 0, 1])
            checked += 1
    assert checked > 10


def test_spatial_random_without_neighbours():
    rows = np.zeros((40, 10))
    rows[:, 9], rows[:, 6] = 1, np.arange(40)
    out = reductions.STRATEGIES["spatial_random"](rows, 5, np.random.default_rng(0))
    assert len(out) == 5 and set(out[:, 6]) <= set(range(40))


def test_adjacent_pairs_come_once_without_a_distinct(spark):
    rows = [(1, 0, 1, 2), (2, 0, 1, 2), (3, 2, 1, 5), (4, 1, 0, 7), (4, 8, 9, 1), (5, 9, 8, 3)]
    tris = spark.createDataFrame(rows, "tri_id long, a long, b long, c long")
    for by, want in (("edge", {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (4, 5)}), ("vertex", {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (4, 5)})):
        df = mesh.adjacent(tris, by)
        pairs = [tuple(r) for r in df.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")]  # nothing is grouped after the pairs are made


def test_packing_takes_the_first_shelf_with_room(spark):
    import time

    rng = random.Random(4)
    rects = [(i % 2, i, rng.randint(1, 70), rng.randint(1, 9)) for i in range(700)]
    got = {r["rect_id"]: (r["px"], r["py"]) for r in mesh.packed(spark.createDataFrame(rects, "page long, rect_id long, w long, h long"), "page", 64).collect()}
    for page in (0, 1):
        shelves = []
        for _, i, w, h in sorted((r for r in rects if r[0] == page), key=lambda r: (-r[3], -r[2], r[1])):
            s = next((s for s in shelves if s[1] + w <= 64), None)
            if s is None:
                shelves.append(s := [sum(x[2] for x in shelves), 0, h])
            assert got[i] == (s[1], s[0])
            s[1] += w
    many = spark.range(60000).select(F.lit(0).cast("long").alias("page"), F.col("id").alias("rect_id"), F.lit(40).cast("long").alias("w"), F.lit(1).cast("long").alias("h"))
    began = time.time()
    assert mesh.packed(many, "page", 64).count() == 60000
    assert time.time() - began < 30  # a walk over all shelves takes minutes


def test_boxes_of_all_sizes_meet_once_in_bounded_cells(spark):
    rng = np.random.default_rng(6)

    def boxes(n, first):
        low, edge = rng.random((n, 3)) * 100 - 50, 10.0 ** rng.uniform(-3, 3, (n, 1)) * rng.random((n, 3))
        return pd.DataFrame(np.concatenate([low, low + edge], axis=1), columns=neighbors.CORNERS).assign(id=np.arange(first, first + n))

    one, two = boxes(120, 0), boxes(150, 1000)
    a, b = one[neighbors.CORNERS].to_numpy(), two[neighbors.CORNERS].to_numpy()
    want = sorted((int(i), int(j) + 1000) for i, j in zip(*np.nonzero(((a[:, None, :3] <= b[None, :, 3:]) & (a[:, None, 3:] >= b[None, :, :3])).all(2)), strict=True))
    df = neighbors.boxes_joined(spark.createDataFrame(one), spark.createDataFrame(two))
    assert sorted(tuple(r) for r in df.collect()) == want
    at = pd.DataFrame(a[:, :3], columns=list("xyz")).assign(pid=np.arange(120), radius=1.0)
    inside = ((a[:, None, :3] >= b[None, :, :3]) & (a[:, None, :3] <= b[None, :, 3:])).all(2)
    p = spark.createDataFrame(at)
    assert sorted(tuple(r) for r in neighbors.in_boxes(p, spark.createDataFrame(two)).collect()) == sorted((int(i), int(j) + 1000) for i, j in zip(*np.nonzero(inside), strict=True))
    got = {r["pid"]: r["radius"] for r in neighbors.spatial_anti_join(p, spark.createDataFrame(two)).collect()}
    assert got == {i: 0.0 if inside[i].any() else 1.0 for i in range(120)}
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_charts_of_copies_join_as_of_listed_pairs(spark):
    """Many equal triangles meet in no list of pairs; the charts are those of the plain rule."""
    rng = random.Random(8)
    few = [(i, *rng.sample(range(9), 3), rng.choice((0.0, 1.0, 2.0)), *rng.choice(((0.0, 0.0, 1.0), (0.0, 0.6, 0.8), (0.6, 0.0, 0.8)))) for i in range(70)]

    def plain(rows, threshold):
        side = {r[0]: {frozenset(e) for e in (r[1:3], r[2:4], (r[3], r[1]))} for r in rows}
        near = {i: {j for j in side if i != j and side[i] & side[j]} for i in side}
        area, weight = {r[0]: r[4] for r in rows}, {r[0]: np.array(r[5:]) * r[4] for r in rows}
        own, version = {i: [i] for i in side}, dict.fromkeys(side, 0)
        off = set()

        def pairs():
            for i in own:
                for j in near[i]:
                    if i < j and (i, j, version[i], version[j]) not in off and area[i] > 0 and area[j] > 0:
                        yield 1 - np.linalg.norm(weight[i] + weight[j]) / (area[i] + area[j]), i, j

        while (best := min(pairs(), default=(2.0,)))[0] < threshold:
            _, i, j = best
            left = (near[i] | near[j]) - {i, j}
            if 0 < len(left) < 3 and len(near[i]) >= 3 and len(near[j]) >= 3:
                off.add((i, j, version[i], version[j]))
                continue
            own[i] += own.pop(j)
            weight[i], area[i], version[i] = weight[i] + weight[j], area[i] + area[j], version[i] + 1
            for k in near.pop(j):
                near[k].discard(j)
                if k != i:
                    near[k].add(i)
            near[i] = left
        return {t: min(c) for c in own.values() for t in c}

    def charts(rows, threshold):
        df = spark.createDataFrame(pd.DataFrame(rows, columns=["tri_id", "a", "b", "c", "area", "nx", "ny", "nz"])).withColumn("grp", F.lit(0))
        return {r["tri_id"]: r["chart"] for r in mesh.charts(df.select("tri_id", "a", "b", "c", "grp"), df, "grp", threshold).collect()}

    for threshold in (0.02, 0.06, 0.2):
        for rows in (few, few[:40], [(i, *t[1:]) for i, t in enumerate(few[:9] * 7)]):
            assert charts(rows, threshold) == plain(rows, threshold)
    many = charts([(i, 0, 1, 2, 1.0 + i % 5, 0.0, 0.0, 1.0) for i in range(20000)], 0.05)  # 200 million pairs
    assert len(many) == 20000 and len(set(many.values())) == 4


def test_nearest_vector_with_missing_components_and_few_pairs(spark, monkeypatch):
    from lodestone.operators import vectors

    rng = random.Random(12)
    rows = [(i, [rng.choice((None, *range(-9, 9))) if i % 3 else rng.randint(-9, 9) for _ in range(5 - i % 2)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [None, None]), (63, [10**9] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")

    def plain(v, w):
        both = [(p - q) ** 2 for p, q in zip(v or (), w or (), strict=False) if p is not None and q is not None]
        return (0, sum(both)) if both else (1, 0)

    want = {i: min((*plain(v, w), j) for j, w in rows if j != i) for i, v in rows}
    want = {i: (j, None if none else d2) for i, (none, d2, j) in want.items()}
    for tile, block in ((7, 13), (1024, 32768)):
        monkeypatch.setattr(vectors, "TILE", tile)
        monkeypatch.setattr(vectors, "BLOCK", block)
        out = vectors.nearest_vector(df)
        assert {r["vec_id"]: (r["neighbor"], r["d2"]) for r in out.collect()} == want
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # pairs are never rows


def test_scheduler_sees_only_nodes_around_the_cut(spark, monkeypatch):
    from lodestone.streaming import cut_scheduler

    rng = random.Random(3)
    rows = [(v, f, n, rng.random() * 8 / (1 + n.bit_length() ** 0.5)) for v in (None, 4, 7) for f in range(0, 14, 1 + (v or 0) % 2) for n in range(300)]
    df = spark.createDataFrame(rows, "view_id long, frame long, node_id long, error double")
    want = []
    for v in (None, 4, 7):
        cut = {0}
        for f in sorted({r[1] for r in rows if r[0] == v}):
            want += [(v, f, *a) for a in update_cut(cut, {r[2]: r[3] for r in rows if r[:2] == (v, f)}, 2, 1.0, 24)]
    assert len(want) > 60
    assert sorted(map(repr, (tuple(r) for r in schedule(df, 2, 1.0, 24).collect()))) == sorted(map(repr, want))
    assert cut_scheduler.within_reach(df.where("view_id = 4 and frame < 4"), 2).count() == 3 + 7 + 15 + 31 + 4
    empty = [(1, 0, 0, 9.0), (1, 0, 1, 1.0), (1, 0, 2, 1.0), (1, 1, 500, 1.0)]  # the second frame names no node in reach
    got = schedule(spark.createDataFrame(empty, df.schema), 2, 1.0, 24).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, "split"), (1, 1, 0, "collapse")]
    assert len(cut_scheduler.looked_up(set(range(1023, 1087)), 2)) < 64 * 12 * 3


def test_simplified_copies_of_a_face_go_together(spark):
    import time

    v = spark.createDataFrame([(i, i % 6 * 1.0 + i / 50, i // 6 * 1.3, i % 5 * 0.1) for i in range(36)], "vid long, x double, y double, z double")
    quads = [i for i in range(30) if i % 6 < 5]
    faces = [(i, i + 1, i + 6) for i in quads] + [(i + 1, i + 7, i + 6) for i in quads]

    def left(copies):
        n = len(faces)
        t = spark.createDataFrame(pd.DataFrame([(k * n + i, *faces[i], 0) for k in range(copies) for i in range(n)], columns=["tri_id", "a", "b", "c", "grp"]))
        return mesh.simplified(t, v, "grp").toPandas().sort_values("tri_id")

    one = left(1)
    assert 0 < len(one) <= len(faces) // 2
    began = time.time()
    many = left(3000)
    assert time.time() - began < 30  # 150,000 faces; one by one they take longer
    assert len(many) == 3000 * len(one) and many.iloc[: len(one)].to_numpy().tolist() == one.to_numpy().tolist()
    assert many.iloc[-len(one) :, 2:].to_numpy().tolist() == one.iloc[:, 2:].to_numpy().tolist()


def test_few_large_groups_do_not_meet_in_one_task(spark, monkeypatch):
    """No join of the splits shuffles rows by their node."""
    df = spark.range(40000).select(F.col("id").alias("pid"), *((F.col("id") * k % 997 * 1.0).alias(c) for k, c in ((7, "x"), (11, "y"), (13, "z"))))
    plans = []
    written = partition.cut

    def seen(frame, *a):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return written(frame, *a)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        monkeypatch.setattr(partition, "cut", seen)
        small = [partition.downsweep(df, 2).groupBy("node_id").count().collect(), partition.balanced_split(df, 4).groupBy("part").count().collect()]
        assert plans and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
        monkeypatch.setattr(partition, "SMALL", 0)
        large = [partition.downsweep(df, 2).groupBy("node_id").count().collect(), partition.balanced_split(df, 4).groupBy("part").count().collect()]
        assert list(map(sorted, small)) == list(map(sorted, large))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grid_charts_write_cells_and_no_points(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.random() * 8, rng.random() * 8, rng.random() * 4, 1.0 + i % 3, *((0.0, 0.0, 1.0) if rng.random() < 0.9 else (1.0, 0.0, 0.0))) for i in range(300)]
    rows.append((300, None, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0))
    written, wrote = mesh.cut, []
    monkeypatch.setattr(mesh, "cut", lambda df, *a: wrote.append(df.columns) or written(df, *a))
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, area double, nx double, ny double, nz double")
    got = {r["pid"]: r["cell"] for r in mesh.grid_charts(df, 3, 0.05, 3).collect()}
    assert wrote and not any("pid" in names for names in wrote)
    low = [min(r[k] for r in rows[:300] + [(0, 9.0, 0.0, 0.0)]) for k in (1, 2, 3)]
    size = max(max(r[k] for r in rows[:300]) - low[k - 1] for k in (1, 2, 3)) / 3 * 1.01
    depth = dict.fromkeys(range(301), 0)
    name = lambda i: "_".join(map(str, (depth[i], *(int((c - m) // (size / 2 ** depth[i])) for c, m in zip(rows[i][1:4], low, strict=True) if c is not None))))
    for _ in range(3):
        cells = {}
        for i in depth:
            cells.setdefault(name(i), []).append(i)
        for own in cells.values():
            w = sum(np.array(rows[i][5:]) * rows[i][4] for i in own)
            if 1 - np.linalg.norm(w) / sum(rows[i][4] for i in own) > 0.05:
                depth |= {i: depth[i] + 1 for i in own}
    assert got == {i: name(i) for i in depth}


def test_texels_of_few_bytes_are_dealt_to_all_tasks(spark):
    corners = {f"{c}{k}": float(n) for n, (c, k) in enumerate((c, k) for c in "abc" for k in "xyz")}
    t = spark.range(0, 64, 1, 1).select(F.col("id").alias("tri_id"), *(F.lit(v).alias(c) for c, v in (corners | {"as": 0.1, "at": 0.1, "bs": 0.4, "bt": 0.1, "cs": 0.1, "ct": 0.5}).items()))
    out = mesh.sampled(t, 32).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(out) == 4 and sum(r["n"] for r in out) == 64 * 67


def test_patches_are_cut_without_a_window(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "q").mkdir()
    record = "PATCHS{}\n0 0 0 1\n0 0 1 0\n{} 0 0\n2\n{} 3\n1\n5{}\n"
    (tmp_path / "p" / "a.patch").write_text("PATCHES\n2\n" + record.format("", 0.5, 4, "\r") + record.format("  ", 0.25, 6, "") + "PATCHS\n1\n")
    ply = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n7 8 9\n"
    (tmp_path / "q" / "a.ply").write_text(ply)
    out = structured.read_patches(spark, str(tmp_path / "p"), str(tmp_path / "q"))
    got = {r["ordinal"]: (r["x"], r["ncc"], r["seen"], r["not_seen"]) for r in out.collect()}
    assert got == {0: (1.0, 0.5, [4, 3], [5]), 1: (4.0, 0.25, [6, 3], [5]), 2: (7.0, None, None, None)}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_ply_files_are_streamed():
    import io

    class Stream(io.BytesIO):
        def read(self, n=-1):
            assert 0 <= n <= 1 << 20  # never the whole file
            return super().read(n)

    head = "ply\r\nformat {}\r\nelement extra 3\r\nproperty float k\r\nelement vertex 5001\r\nproperty float x\r\nproperty float y\r\nend_header\r\n"
    at = np.arange(10002, dtype=float).reshape(-1, 2)
    text_ = head.format("ascii 1.0") + "9\r\n" * 3 + "".join(f"{x} {y}\r\n" for x, y in at)
    packed = head.format("binary_little_endian 1.0").encode() + bytes(12) + at.astype("<f4").tobytes() + b"faces"
    for content in (text_.encode(), text_.replace("\r\n", "\r").encode(), text_.replace("\r\n", "\n").encode(), packed):
        frames = list(structured.ply_frames(Stream(content), 700))
        assert max(map(len, frames)) == 700
        assert (pd.concat(frames)[["x", "y"]].to_numpy() == at).all()
        assert (structured.ply_vertices(content)["y"] == at[:, 1]).all()
