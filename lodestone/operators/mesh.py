"""Triangle operators: cleaning, adjacency, trees, simplification, charts, sampling, packing.

Triangles are rows with tri_id and vertex ids a, b, c; vertices are rows with
vid, x, y, z. Sequential steps run per connected component or per cell in
pandas groups.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geometry as geo
from lodestone.model import cut


def edges(tris: DataFrame) -> DataFrame:
    """tri_id, u, v (u < v) of the three edges."""
    pairs = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return tris.select("tri_id", F.explode(pairs).alias("e")).select("tri_id", "e.u", "e.v")


def adjacent(tris: DataFrame, by: str = "edge") -> DataFrame:
    """Pairs tri_id < other that share an edge, or at least a vertex.

    A pair is kept only where it meets on the least of what it shares, so it
    comes once without a distinct: only the triangles are shuffled, not the pairs.
    """
    key = F.struct("u", "v") if by == "edge" else F.col("u")
    one = edges(tris) if by == "edge" else tris.select("tri_id", F.explode(F.array("a", "b", "c")).alias("u"))
    own = one.select("tri_id", key.alias("k")).where(F.col("u").isNotNull() & (F.col("v").isNotNull() if by == "edge" else F.lit(True)))
    one = own.groupBy("tri_id").agg(F.collect_set("k").alias("ks")).select("tri_id", "ks", F.explode("ks").alias("k"))
    one = one.select("tri_id", "k", F.filter("ks", lambda x: x < F.col("k")).alias("less"))
    two = one.select(F.col("tri_id").alias("other"), F.col("less").alias("o_less"), "k")
    first = (F.size("less") == 0) | (F.size("o_less") == 0) | ~F.arrays_overlap("less", "o_less")
    return one.join(two.hint("merge"), "k").where((F.col("tri_id") < F.col("other")) & first).select("tri_id", "other")


def connected(pairs: DataFrame, nodes: DataFrame, node: str = "tri_id") -> DataFrame:
    """``component`` (smallest id) of every node, by the least label around and pointer jumping, on tables."""
    at = cut(nodes.select(F.col(node).alias("n"), F.col(node).alias("component")))
    both = cut(pairs.toDF("p", "q").unionByName(pairs.toDF("q", "p")).distinct())
    while True:
        low = both.join(at.select(F.col("n").alias("q"), "component"), "q").groupBy("p").agg(F.min("component").alias("low"))
        new = at.join(low, F.col("n") == F.col("p"), "left").select("n", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = new.select(F.col("n").alias("component"), F.col("component").alias("far"))
        new = cut(new.join(jump, "component", "left").select("n", "old", F.least("component", "far").alias("component")))
        at = new.drop("old")
        if new.where("old <> component").isEmpty():
            return at.withColumnRenamed("n", node)


def cleaned(tris: DataFrame, vertices: DataFrame, least_faces: int = 1, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """Without repeated vertices, degenerate, zero-area or repeated faces, small components and unreferenced vertices."""
    key = F.struct(*(F.round(c, digits) for c in geo.AXES))
    first = vertices.groupBy(key.alias("k")).agg(F.min("vid").alias("to"))
    same = vertices.select("vid", key.alias("k")).join(first, "k").select("vid", "to")
    for c in "abc":
        tris = tris.join(same.select(F.col("vid").alias(c), F.col("to").alias("_to")), c).withColumn(c, F.col("_to")).drop("_to")
    tris = tris.select("tri_id", "a", "b", "c").where("a <> b and b <> c and a <> c")
    for c in "abc":
        tris = tris.join(vertices.select(F.col("vid").alias(c), *(F.col(k).alias(f"{c}{k}") for k in geo.AXES)), c)
    p, q, r = (geo.vec(*(f"{c}{k}" for k in geo.AXES)) for c in "abc")
    area = geo.length(geo.cross(geo.sub(q, p), geo.sub(r, p))) / 2
    tris = tris.where(area > 0).withColumn("_k", F.array_sort(F.array("a", "b", "c")))
    keep = tris.groupBy("_k").agg(F.min("tri_id").alias("tri_id"))
    tris = cut(tris.join(keep.select("tri_id"), "tri_id", "left_semi").select("tri_id", "a", "b", "c"))
    comp = connected(adjacent(tris), tris)
    big = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least_faces)
    tris = tris.join(comp.join(big, "component", "left_semi").select("tri_id"), "tri_id", "left_semi")
    used = tris.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return tris, vertices.join(used, "vid", "left_semi")


def centroids(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """pid (tri_id) and the mean of the corners: the points of triangle trees."""
    corner = tris.select("tri_id", F.explode(F.array("a", "b", "c")).alias("vid")).join(vertices, "vid")
    return corner.groupBy(F.col("tri_id").alias("pid")).agg(*(F.avg(c).alias(c) for c in geo.AXES))


def triangle_tree(tris: DataFrame, vertices: DataFrame, depth: int) -> DataFrame:
    """Binary tree over triangles by centroid medians on the longest axis (bounding-volume and kd trees alike)."""
    from lodestone.operators.partition import downsweep

    return downsweep(centroids(tris, vertices), depth, 2)


def simplified(tris: DataFrame, vertices: DataFrame, group: str, ratio: float = 0.5) -> DataFrame:
    """Per group: shortest edges collapse to their midpoints until at most ``ratio`` of the faces is left. Rows of corner coordinates.

    Faces with the same corners in the same order move and go together, so a step costs the different faces around a vertex, not their copies.
    """
    at = tris.select(group, "tri_id", F.posexplode(F.array("a", "b", "c")).alias("k", "vid")).join(vertices.select("vid", *geo.AXES), "vid")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tri_id", "k"], kind="stable")
        corners, where = np.unique(pdf["vid"].to_numpy(), return_index=True)
        pos = dict(enumerate(pdf[["x", "y", "z"]].to_numpy(float)[where]))
        ids, start, size = np.unique(pdf["tri_id"].to_numpy(), return_index=True, return_counts=True)
        # Corners without a vertex are missing, and faces may then have fewer.
        wide = np.full((len(ids), size.max()), -1)
        row = np.repeat(np.arange(len(ids)), size)
        wide[row, np.arange(len(row)) - start[row]] = np.searchsorted(corners, pdf["vid"].to_numpy())
        kinds, kind, copies = np.unique(wide, axis=0, return_inverse=True, return_counts=True)
        kind = kind.reshape(-1)
        faces = {t: tuple(v for v in f if v >= 0) for t, f in enumerate(kinds.tolist())}
        left, goal = len(ids), int(len(ids) * ratio)
        around: dict[int, set[int]] = {}
        for t, f in faces.items():
            for v in f:
                around.setdefault(v, set()).add(t)
        heap = sorted({(float(((pos[p] - pos[q]) ** 2).sum()), min(p, q), max(p, q)) for p, q in {(p, q) for f in faces.values() for p, q in zip(f, f[1:] + f[:1], strict=True)}})
        heapq.heapify(heap)
        while left > goal and heap:
            cost, p, q = heapq.heappop(heap)
            if p not in around or q not in around or not around[p] & around[q]:
                continue
            if abs(((pos[p] - pos[q]) ** 2).sum() - cost) > 1e-12:
                continue
            for t in around[p] & around[q]:
                left -= int(copies[t])
                for v in faces.pop(t):
                    around[v].discard(t)
            for t in around.pop(q):
                faces[t] = tuple(p if v == q else v for v in faces[t])
                around[p].add(t)
            pos[p] = (pos[p] + pos[q]) / 2
            for v in {v for t in around[p] for v in faces[t]} - {p}:
                heapq.heappush(heap, (float(((pos[p] - pos[v]) ** 2).sum()), min(p, v), max(p, v)))
        stay = np.array([t in faces for t in range(len(kinds))])[kind]
        xyz = np.full((len(kinds), 9), np.nan)
        for t, f in faces.items():
            xyz[t] = np.concatenate([pos[v] for v in f])
        out = pd.DataFrame(xyz[kind[stay]], columns=[f"{c}{k}" for c in "abc" for k in "xyz"])
        out.insert(0, "tri_id", ids[stay])
        out.insert(0, group, pdf[group].iloc[0])
        return out

    return at.groupBy(group).applyInPandas(one, f"{group} long, tri_id long, " + ", ".join(f"{c}{k} double" for c in "abc" for k in "xyz"))


class _Kinds:
    """Charts of one component by kind: those alike in edges, weight and area, which differ in their id only.

    Two kinds join at one cost, so of all their pairs only the one that is
    next waits in the heap, and neither pairs nor neighbours are listed.
    """

    def __init__(self, threshold: float):
        self.threshold, self.index, self.edges, self.weight, self.area = threshold, {}, [], [], []
        self.ids, self.count, self.by_edge, self.kind, self.version = [], [], {}, {}, {}
        self.cost, self.entered, self.off, self.heap = {}, {}, set(), []

    def add(self, edges: frozenset, weight: np.ndarray, area: float, ids: list[int]) -> int:
        """The kind, with the (sorted) ids in it."""
        k = self.index.setdefault((edges, weight.tobytes(), area), len(self.ids))
        if k == len(self.ids):
            self.edges.append(edges)
            self.weight.append(weight)
            self.area.append(area)
            self.ids.append([])
            self.count.append(0)
        if not self.count[k]:
            for e in edges:
                self.by_edge.setdefault(e, set()).add(k)
        if self.ids[k]:
            for i in ids:
                heapq.heappush(self.ids[k], i)
        else:
            self.ids[k] = list(ids)
        self.count[k] += len(ids)
        self.kind.update(dict.fromkeys(ids, k))
        return k

    def remove(self, i: int) -> None:
        k = self.kind.pop(i)
        self.count[k] -= 1
        if not self.count[k]:
            for e in self.edges[k]:
                self.by_edge[e].discard(k)

    def around(self, k: int) -> set[int]:
        """Kinds that share an edge, its own included."""
        return set().union(*(self.by_edge[e] for e in self.edges[k]))

    def next(self, p: int, q: int) -> tuple[int, int] | None:
        """The first pair of ids of two kinds that is not put off."""
        if not self.count[p] or self.count[q] < (2 if p == q else 1):
            return None
        first = []
        for k in (p, q):
            own = self.ids[k]
            while self.kind.get(own[0]) != k:
                heapq.heappop(own)
            first.append(own[0])
            if p == q:
                low = heapq.heappop(own)
                while self.kind.get(own[0]) != k or own[0] == low:
                    heapq.heappop(own)
                first.append(own[0])
                heapq.heappush(own, low)
                break
        pair = min(first), max(first)
        if not self.is_off(*pair):
            return pair
        # A put off chart has three neighbours, which all of its kind have in common, so few are left.
        one, two = ({i for i in self.ids[k] if self.kind.get(i) == k} for k in (p, q))
        return min(((i, j) for a in one for b in two if a != b for i, j in [(min(a, b), max(a, b))] if not self.is_off(i, j)), default=None)

    def is_off(self, i: int, j: int) -> bool:
        return bool(self.off) and (i, j, self.version.get(i, 0), self.version.get(j, 0)) in self.off

    def offer(self, p: int, q: int) -> None:
        """The next pair of two kinds waits, if they join below the threshold."""
        p, q = min(p, q), max(p, q)
        if (p, q) not in self.cost:
            a, b, w = self.area[p], self.area[q], self.weight[p] + self.weight[q]
            self.cost[p, q] = 1 - math.sqrt(w.dot(w)) / (a + b) if a > 0 and b > 0 else math.inf
        if self.cost[p, q] < self.threshold:
            pair = self.next(p, q)
            if pair is not None and self.entered.get((p, q)) != pair:
                self.entered[p, q] = pair
                heapq.heappush(self.heap, (self.cost[p, q], *pair, p, q))

    def merged(self) -> dict[int, list[int]]:
        """Chart -> its members."""
        for k in range(len(self.ids)):
            for o in self.around(k):
                if o >= k:
                    self.offer(k, o)
        own = {i: [i] for i in self.kind}
        while self.heap:
            _, i, j, p, q = heapq.heappop(self.heap)
            if self.entered.get((p, q)) != (i, j):
                continue
            del self.entered[p, q]
            if self.next(p, q) != (i, j):
                self.offer(p, q)
                continue
            one, two = self.around(p), self.around(q)
            of_one, of_two, left = (sum(self.count[k] for k in ks) for ks in (one, two, one | two))
            if 0 < left - 2 < 3 and of_one > 3 and of_two > 3:
                self.off.add((i, j, self.version.get(i, 0), self.version.get(j, 0)))
                self.offer(p, q)
                continue
            own[i] += own.pop(j)
            self.version[i] = self.version.get(i, 0) + 1
            self.remove(i)
            self.remove(j)
            edges = frozenset(e for e in self.edges[p] | self.edges[q] if self.by_edge[e])  # others have no use for the rest
            new = self.add(edges, self.weight[p] + self.weight[q], self.area[p] + self.area[q], [i])
            self.offer(p, q)
            for o in self.around(new):
                self.offer(new, o)
        return own


def charts(tris: DataFrame, normals: DataFrame, group: str, threshold: float) -> DataFrame:
    """tri_id -> chart: adjacent charts with the least joining cost merge first, while it is below the threshold.

    The cost is one minus the length of the area-weighted mean normal of the
    union; a chart without area costs infinity, and a join that would leave
    fewer than three neighbours is put off unless the chart is closed in.
    Triangles of a group are adjacent by the edges that come with them, so no pairs are made.
    """
    sides = edges(tris.select("tri_id", "a", "b", "c")).groupBy("tri_id").agg(F.collect_set(F.when(F.col("u").isNotNull(), F.struct("u", "v"))).alias("e"))
    at = tris.select("tri_id", group).join(normals.select("tri_id", "area", "nx", "ny", "nz"), "tri_id").join(sides, "tri_id")
    at = at.select("tri_id", group, "area", "nx", "ny", "nz", F.col("e.u").alias("us"), F.col("e.v").alias("vs"))

    def one(table):
        import pyarrow as pa

        ids, last = np.unique(table["tri_id"].to_numpy()[::-1], return_index=True)
        table = table.take(table.num_rows - 1 - last).combine_chunks()
        us, vs = (table[c].combine_chunks() for c in ("us", "vs"))
        us, vs = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (us, vs))
        sizes = us.value_lengths().to_numpy()
        _, code = np.unique(np.stack([us.flatten().to_numpy(), vs.flatten().to_numpy()], axis=1), axis=0, return_inverse=True)
        code = code.reshape(-1)
        # Triangles with the same edges have one family; a triangle without edges is its own.
        wide = np.full((len(ids), max(3, sizes.max(initial=0))), -1, np.int64)
        row = np.repeat(np.arange(len(ids)), sizes)
        wide[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = code
        wide.sort(axis=1)
        families, family = np.unique(wide, axis=0, return_inverse=True)
        family = family.reshape(-1)
        sets = [frozenset(r) - {-1} for r in families.tolist()]
        root = list(range(len(sets)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        first: dict[int, int] = {}
        for k, own in enumerate(sets):
            for e in own:
                root[top(k)] = top(first.setdefault(e, k))
        component = np.array([top(k) for k in range(len(sets))], np.int64)
        area = table["area"].to_numpy().astype(float)
        weight = np.stack([table[c].to_numpy().astype(float) for c in ("nx", "ny", "nz")], axis=1) * area[:, None]
        _, at_first, kind = np.unique(np.column_stack([family, weight, area]), axis=0, return_index=True, return_inverse=True)
        kind = kind.reshape(-1)
        order = np.lexsort((ids, kind))
        ends = np.cumsum(np.bincount(kind, minlength=len(at_first)))
        chart = ids.copy()
        place = {}
        of_component = component[family[at_first]]
        held, held_of = None, -1
        todo = np.argsort(of_component, kind="stable").tolist()
        for n, k in enumerate(todo):
            if of_component[k] != held_of:
                held, held_of = _Kinds(threshold), of_component[k]
                place = {}
            r = at_first[k]
            rows = order[(ends[k - 1] if k else 0) : ends[k]]
            mine = ids[rows].tolist()
            place.update(zip(mine, rows.tolist(), strict=True))
            if sets[family[r]]:
                held.add(sets[family[r]], weight[r], float(area[r]), mine)
            if n + 1 == len(todo) or of_component[todo[n + 1]] != held_of:
                for c, members in held.merged().items():
                    chart[[place[t] for t in members]] = c
        return pa.table({"tri_id": ids, "chart": chart})

    return at.groupBy(group).applyInArrow(one, "tri_id long, chart long")


def grid_charts(points: DataFrame, resolution: int, spread: float, deepest: int = 5) -> DataFrame:
    """pid -> cell: cubic cells of the longest side / resolution * 1.01, split in eight while the area-weighted normal spread is above a limit.

    ``points`` are triangle centroids with area and normal.
    """
    box = points.agg(*(F.min(c).alias(f"l{c}") for c in geo.AXES), F.greatest(*((F.max(c) - F.min(c)) for c in geo.AXES)).alias("side"))
    size = F.col("side") / resolution * 1.01
    box = cut(box.withColumn("size", F.when(size > 0, size).otherwise(1.0)), "box")
    at = points.join(F.broadcast(box), F.lit(True))  # one row
    # Halving a size is exact, so the cells of all depths are prefixes of the deepest one, and their sums come from one pass over the points.
    at = at.select("pid", "area", "nx", "ny", "nz", *(F.floor((F.col(c) - F.col(f"l{c}")) / (F.col("size") / 2**deepest)).alias(f"_{c}") for c in geo.AXES))
    keys = [f"_{c}" for c in geo.AXES]
    sums = [F.sum("area").alias("w"), *(F.sum(F.col("area") * F.col(n)).alias(f"s{n}") for n in ("nx", "ny", "nz"))]
    cells = cut(at.groupBy(*keys).agg(*sums).withColumn("depth", F.lit(0)), "cells")
    up = lambda k: F.expr(f"shiftright({k}, {deepest} - depth)")
    for _ in range(deepest):
        own = ["depth", *(up(k).alias(f"u{k}") for k in keys)]
        mean = cells.groupBy(*own).agg(*(F.sum(c).alias(c) for c in ("w", "snx", "sny", "snz")))
        wide = mean.where(1 - F.sqrt(F.col("snx") ** 2 + F.col("sny") ** 2 + F.col("snz") ** 2) / F.when(F.col("w") > 0, F.col("w")) > spread)
        wide = cut(wide.select("depth", *(f"u{k}" for k in keys), F.lit(1).alias("_w")), "wide")
        if wide.isEmpty():
            break
        wide = wide.withColumnRenamed("depth", "_depth")
        here = geo.every(F.col("depth") == F.col("_depth"), *(up(k).eqNullSafe(F.col(f"u{k}")) for k in keys))
        cells = cut(cells.join(wide, here, "left").withColumn("depth", F.col("depth") + F.coalesce("_w", F.lit(0))).select(*cells.columns), "cells")
    name = F.concat_ws("_", "depth", *(up(k).cast("string") for k in keys))
    found = cells.select(*(F.col(k).alias(f"o{k}") for k in keys), name.alias("cell"))
    return at.join(found, geo.every(*(F.col(k).eqNullSafe(F.col(f"o{k}")) for k in keys))).select("pid", "cell")


def sampled(tris: DataFrame, texels: int) -> DataFrame:
    """Surface points of triangles with corner positions (ax..cz) and texture coordinates (as, at, ..): the texel centres inside each.

    Positions are barycentric, the normal is the face's.
    """
    side = F.lit(float(texels))
    u, v = ([F.col(f"{c}{k}") * side for c in "abc"] for k in ("s", "t"))
    run = lambda w: F.sequence(F.floor(F.least(*w)), F.floor(F.greatest(*w)))
    # Few bytes but many texels for each row, so the rows are dealt out whatever their size.
    spread = tris.repartition(int(tris.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tri_id")
    at = spread.withColumn("_i", F.explode(run(u))).withColumn("_j", F.explode(run(v)))
    px, py = F.col("_i") + 0.5, F.col("_j") + 0.5
    det = (u[1] - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (v[1] - v[0])
    wb = ((px - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (py - v[0])) / F.when(det != 0, det)
    wc = ((u[1] - u[0]) * (py - v[0]) - (px - u[0]) * (v[1] - v[0])) / F.when(det != 0, det)
    at = at.withColumn("_wb", wb).withColumn("_wc", wc).where("_wb >= 0 and _wc >= 0 and _wb + _wc <= 1")
    corner = {c: geo.vec(*(f"{c}{k}" for k in geo.AXES)) for c in "abc"}
    n = geo.cross(geo.sub(corner["b"], corner["a"]), geo.sub(corner["c"], corner["a"]))
    size = F.when(geo.length(n) > 0, geo.length(n))
    pos = [(1 - F.col("_wb") - F.col("_wc")) * corner["a"][k] + F.col("_wb") * corner["b"][k] + F.col("_wc") * corner["c"][k] for k in range(3)]
    return at.select("tri_id", F.col("_i").alias("i"), F.col("_j").alias("j"), *(p.alias(c) for p, c in zip(pos, geo.AXES, strict=True)), *((x / size).alias(f"n{c}") for x, c in zip(n, geo.AXES, strict=True)))


def packed(rects: DataFrame, group: str, width: int) -> DataFrame:
    """Places (px, py) of rectangles (rect_id, w, h) in a strip of a given width per group: shelves by falling height."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "w", "rect_id"], ascending=[False, False, True], kind="stable")
        # Heights fall, so a shelf is high enough for all that follow; the first with enough width is found in a tree of the free widths.
        size = 1
        free, tops, bottom = [-1, -1], [], 0
        out = []
        for r, w, h in pdf[["rect_id", "w", "h"]].itertuples(index=False):
            if free[1] >= w:
                at = 1
                while at < size:
                    at *= 2
                    at += free[at] < w
            else:
                if len(tops) == size:  # room for twice the shelves
                    size *= 2
                    free = [-1] * size + free[size // 2 :] + [-1] * (size // 2)
                    for at in range(size - 1, 0, -1):
                        free[at] = max(free[2 * at], free[2 * at + 1])
                at = size + len(tops)
                tops.append(bottom)
                bottom += h
                free[at] = width
            out.append((r, width - free[at], tops[at - size]))
            free[at] -= w
            while at > 1:
                at //= 2
                free[at] = max(free[2 * at], free[2 * at + 1])
        return pd.DataFrame(out, columns=["rect_id", "px", "py"]).assign(**{group: pdf[group].iloc[0]})[[group, "rect_id", "px", "py"]]

    return rects.groupBy(group).applyInPandas(one, f"{group} long, rect_id long, px long, py long")
