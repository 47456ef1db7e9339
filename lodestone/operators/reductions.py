"""Level-of-detail reductions: from the surfels of a parent's children to at most a budget of surfels.

A registry maps names to functions on one group's arrays; ``reduce_level`` runs
one over all groups with ``applyInPandas``. A group has at most fan times the
budget rows, whatever the data size. Every second, and random, need no group
function and stay in column expressions.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.color import RGB_XYZ, WHITE
from lodestone.functions.geometry import TURN
from lodestone.operators.attributes import plane_weights

COLUMNS = ["x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "radius"]
OUT = "node_id long, " + ", ".join(f"{c} double" for c in COLUMNS)
#: Nearest surfels among which natural neighbours are sought.
NEAR = 24
Reduce = Callable[[np.ndarray, int, np.random.Generator], np.ndarray]
STRATEGIES: dict[str, Reduce] = {}


def strategy(name: str) -> Callable[[Reduce], Reduce]:
    def add(f: Reduce) -> Reduce:
        STRATEGIES[name] = f
        return f

    return add


def reduce_level(points: DataFrame, name: str, budget: int, seed: int = 0, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Reduced surfels per ``node_id`` (the parent) by a registered strategy; inputs stay as they are.

    ``attributes`` are averaged over the members of each output surfel where the strategy merges (provenance).
    """
    run = STRATEGIES[name]
    columns, extra = list(COLUMNS), list(attributes)
    schema = OUT + "".join(f", {c} double" for c in extra)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["radius"] > 0].sort_values("pid", kind="stable")
        node = int(pdf["node_id"].iloc[0]) if len(pdf) else 0
        rows = pdf[columns + extra].to_numpy(float)
        out = run(rows, budget, np.random.default_rng([seed, node & 0x7FFFFFFF])) if len(rows) else rows
        return pd.DataFrame(out, columns=columns + extra).assign(node_id=node)[["node_id", *columns, *extra]]

    return points.select("node_id", "pid", *(F.col(c).cast("double") for c in columns + extra)).groupBy("node_id").applyInPandas(group, schema)


# -- shared parts ----------------------------------------------------------


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def representative(rows: np.ndarray) -> np.ndarray:
    """Mean of everything, the normal normalised, and the radius that encloses the members' disks."""
    out = rows.mean(axis=0)
    out[3:6] = unit(out[3:6])
    out[9] = (np.linalg.norm(rows[:, :3] - out[:3], axis=1) + rows[:, 9]).max()
    return out


def overlap_matrix(rows: np.ndarray) -> np.ndarray:
    """Which disks overlap, by the same rule as the column expression; of a pair the earlier row is the first disk."""
    p, r = rows[:, :3], rows[:, 9]
    first, second = (unit(rows[:, 3:6] + np.eye(3)[axis] * TURN) for axis in (0, 2))
    gap = p[None] - p[:, None]
    near = (gap**2).sum(-1) <= (r[:, None] + r[None]) ** 2
    d = np.cross(first[:, None], second[None])
    d2 = (d**2).sum(-1)
    flat = (gap * first[:, None]).sum(-1) == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        q = (gap * second[None]).sum(-1)[..., None] * np.cross(d, first[:, None]) / d2[..., None]
        w = gap - q
        from2 = (w**2).sum(-1) - (w * d).sum(-1) ** 2 / d2
        crossing = ((q**2).sum(-1) <= r[:, None] ** 2) & (from2 <= r[None] ** 2)
    out = np.triu(near & np.where(d2 <= 1e-18, flat, crossing), 1)
    return out | out.T


def grid_of(rows: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each row in the finest of a series of grids with at most ``cells`` occupied cells."""
    low, span = rows[:, :3].min(0), np.ptp(rows[:, :3], axis=0).max() or 1.0
    best = np.zeros(len(rows), np.int64)
    for n in range(1, 4 * cells + 2):
        at = np.minimum((rows[:, :3] - low) / span * n, n - 1).astype(np.int64)
        key = np.unique((at[:, 0] * n + at[:, 1]) * n + at[:, 2], return_inverse=True)[1]
        if key.max() + 1 > cells:
            break
        best = key
    return best


def _deviation(rows: np.ndarray, budget: int, angle_matters: bool) -> np.ndarray:
    """Cells first; then the largest cell's surfels merge if their normals are close enough, with a growing limit."""
    if len(rows) <= budget:
        return rows.copy()
    key = grid_of(rows, budget)
    cells = [rows[key == k].copy() for k in range(key.max() + 1)]
    limit, total = 0.1, len(rows)
    heap = [(-len(c), i) for i, c in enumerate(cells)]
    heapq.heapify(heap)
    stuck: list[tuple[int, int]] = []
    while total > budget:
        if not heap:
            limit += 0.1
            heap, stuck = stuck, []
            heapq.heapify(heap)
        _, i = heapq.heappop(heap)
        c = cells[i]
        if len(c) > 1:
            first = c[0, 3:6]
            cosine = np.clip(c[:, 3:6] @ first, -1, 1)
            c[cosine < 0, 3:6] *= -1  # opposed normals are flipped
            angle = np.arccos(np.abs(cosine)) / (np.pi / 2) if angle_matters else np.zeros(len(c))
            close = angle <= limit
            close[0] = True
            n = min(int(close.sum()), total - budget + 1)
            if n > 1:
                members = np.flatnonzero(close)[np.argsort(angle[close], kind="stable")[:n]]
                rest = np.delete(c, members, axis=0)
                cells[i] = np.vstack([rest, representative(c[members])[None]])
                total -= n - 1
                heapq.heappush(heap, (-len(cells[i]), i))
                continue
        stuck.append((-len(cells[i]), i))
    return np.vstack(cells)


@strategy("normal_deviation")
def normal_deviation(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    return _deviation(rows, budget, True)


@strategy("normal_deviation_provenance")
def normal_deviation_provenance(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """The same merges; columns beyond the surfel are true means of the members."""
    return _deviation(rows, budget, True)


@strategy("constant")
def constant(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    return _deviation(rows, budget, False)


@strategy("random")
def random(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    return rows[np.sort(rng.choice(len(rows), min(budget, len(rows)), replace=False))].copy()


@strategy("spatial_random")
def spatial_random(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """Eight divisions of the shortest axis; boxes give random members in turns.

    Normals and colours are means of the natural neighbours among the 24 nearest apart; a surfel without any keeps its own.
    """
    if len(rows) <= budget:
        return rows.copy()
    span = np.ptp(rows[:, :3], axis=0)
    step = max(span.min() / 8, span.max() / 64) or 1.0
    at = np.floor((rows[:, :3] - rows[:, :3].min(0)) / step).astype(np.int64)
    _, key = np.unique(at, axis=0, return_inverse=True)
    boxes = [rng.permutation(np.flatnonzero(key.ravel() == k)).tolist() for k in rng.permutation(key.max() + 1)]
    chosen: list[int] = []
    while len(chosen) < budget:
        for b in boxes:
            if b and len(chosen) < budget:
                chosen.append(b.pop())
    out = rows[np.sort(chosen)].copy()
    for row in out:
        local = rows[:, :3] - row[:3]
        d = (local**2).sum(1)
        apart = np.flatnonzero(d > 0)
        near = apart[np.argsort(d[apart], kind="stable")[:NEAR]]
        w = plane_weights(local[near])
        if w.any():
            row[6:9] = w @ rows[near, 6:9]
            row[3:6] = unit(w @ rows[near, 3:6])
    return out


@strategy("entropy")
def entropy(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """Repeatedly merge the surfel of least entropy with those that overlap it; entropy is the mean of (1 + level) / (1 + |dot|) over them."""
    rows = rows.copy()
    level, alive = np.zeros(len(rows)), np.ones(len(rows), bool)
    while alive.sum() > budget:
        own = np.flatnonzero(alive)
        touch = overlap_matrix(rows[own])
        n = touch.sum(1)
        if not n.any():
            # Nothing overlaps: the first rows stay, as when a lone surfel is left over.
            out = rows[own]
            return out[:budget]
        dots = np.abs(rows[own, 3:6] @ rows[own, 3:6].T)
        score = np.where(n > 0, (touch * (1 + level[own][:, None]) / (1 + dots)).sum(1) / np.maximum(n, 1), np.inf)
        i = int(score.argmin())
        others = np.flatnonzero(touch[i])[: int(alive.sum() - budget)]
        group = own[np.append(i, others)]
        members = rows[group]
        mass = 4 / 3 * np.pi * members[:, 9] ** 3
        new = (members * mass[:, None]).sum(0) / mass.sum()
        new[3:6] = unit((members[:, 3:6] * mass[:, None]).sum(0))
        new[9] = (np.linalg.norm(members[:, :3] - new[:3], axis=1) + members[:, 9]).max()
        rows[own[i]] = new
        level[own[i]] += 1000 * len(others)
        alive[own[others]] = False
    return rows[alive]


@strategy("particles")
def particles(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """A draw in proportion to 1/R², moved on the disks and repelled along their planes, kept inside the box."""
    if len(rows) <= budget:
        return rows.copy()
    weight = 1 / rows[:, 9] ** 2
    out = rows[np.sort(rng.choice(len(rows), budget, replace=False, p=weight / weight.sum()))].copy()
    low, high = rows[:, :3].min(0), rows[:, :3].max(0)
    right = unit(np.cross(out[:, 3:6], np.where(np.abs(out[:, 3:4]) < 0.9, [[1.0, 0, 0]], [[0, 1.0, 0]])))
    up = np.cross(out[:, 3:6], right)
    rho, phi = out[:, 9] * np.sqrt(rng.random(budget)), 2 * np.pi * rng.random(budget)
    out[:, :3] += right * (rho * np.cos(phi))[:, None] + up * (rho * np.sin(phi))[:, None]
    for _ in range(8):
        gap = out[:, None, :3] - out[None, :, :3]
        d = np.linalg.norm(gap, axis=-1)
        reach = out[:, 9][:, None] + out[:, 9][None]
        push = np.where((d < reach) & (d > 0), 0.001 * (reach - d), 0)[..., None] * np.divide(gap, d[..., None], out=np.zeros_like(gap), where=d[..., None] > 0)
        move = push.sum(1)
        move -= out[:, 3:6] * (move * out[:, 3:6]).sum(1, keepdims=True)
        out[:, :3] += move
    out[:, :3] = np.clip(out[:, :3], low, high)
    return out


def _lab(rgb: np.ndarray) -> np.ndarray:
    v = np.clip(rgb / 255.0, 0, 1)
    v = 100 * np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)
    t = v @ np.array(RGB_XYZ).T / np.array(WHITE)
    f = np.where(t > 216 / 24389, np.cbrt(t), 841 / 108 * t + 4 / 29)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], axis=1)


def _hierarchical(rows: np.ndarray, budget: int, split_on: str) -> np.ndarray:
    """Split the largest, most varied cluster by the plane through its centroid across the principal axis."""

    def measure(c: np.ndarray) -> tuple[float, np.ndarray]:
        if len(c) < 2:
            return 0.0, np.array([1.0, 0, 0])
        values, vectors = np.linalg.eigh(np.cov(c[:, :3].T, bias=True))
        variation = float(values[0] / values.sum()) if values.sum() > 0 else 0.0
        if split_on == "color":
            variation = max(variation, float(_lab(c[:, 6:9]).std(0).max()) / 100)
        if split_on == "normal":
            variation = max(variation, 1 - float(np.linalg.norm(c[:, 3:6].mean(0))))
        return variation, vectors[:, -1]

    def split(c: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = (c[:, :3] - c[:, :3].mean(0)) @ axis > 0
        if side.all() or not side.any():
            side = np.arange(len(c)) < len(c) // 2
        return c[side], c[~side]

    limit, size = 1 / 3, max(1.0, len(rows) / budget)
    heap = [(-len(rows), -measure(rows)[0], 0, rows)]
    done: list[np.ndarray] = []
    n = 1
    while len(heap) + len(done) < budget:
        if not heap:  # stuck: tighter limits
            limit, size = limit * 0.75, size * 0.75
            heap = [(-len(c), -measure(c)[0], i, c) for i, c in enumerate(done) if len(c) > 1]
            done = [c for c in done if len(c) <= 1]
            heapq.heapify(heap)
            if not heap:
                break
        _, variation, _, c = heapq.heappop(heap)
        if len(c) < 2 or (len(c) <= size and -variation <= limit):
            done.append(c)
            continue
        for part in split(c, measure(c)[1]):
            n += 1
            heapq.heappush(heap, (-len(part), -measure(part)[0], n, part))
    return np.stack([representative(c) for c in [*done, *(h[3] for h in heap)]])


for _name, _on in (("hierarchical", "position"), ("hierarchical_extended", "color"), ("hierarchical_normal", "normal")):
    STRATEGIES[_name] = lambda rows, budget, rng, on=_on: rows.copy() if len(rows) <= budget else _hierarchical(rows, budget, on)


@strategy("k_clustering")
def k_clustering(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """Seeds from eight colour groups of the dominant plane; over- and undersampled seeds are settled by overlap; members join the next seed."""
    if len(rows) <= budget:
        return rows.copy()
    main = np.abs(rows[:, 3:6]).mean(0).argmax()
    a, b = [k for k in range(3) if k != main]
    span = np.ptp(rows[:, [a, b]], axis=0)
    span[span == 0] = 1
    cell = np.floor((rows[:, [a, b]] - rows[:, [a, b]].min(0)) / span * 8).astype(np.int64)
    colour = (cell[:, 0] % 4) * 2 + cell[:, 1] % 2
    order = np.lexsort((np.arange(len(rows)), colour))
    touch = overlap_matrix(rows)
    seeds: list[int] = []
    for i in order:  # a seed that no chosen one overlaps
        if len(seeds) < budget and not touch[i, seeds].any():
            seeds.append(int(i))
    if len(seeds) < budget:
        gap = ((rows[:, None, :3] - rows[None, seeds, :3]) ** 2).sum(-1).min(1)
        gap[seeds] = -1
        seeds += np.argsort(-gap, kind="stable")[: budget - len(seeds)].tolist()
    near = ((rows[:, None, :3] - rows[None, seeds, :3]) ** 2).sum(-1).argmin(1)
    near[seeds] = np.arange(len(seeds))
    return np.stack([representative(rows[near == k]) for k in range(len(seeds))])


@strategy("pair_contraction")
def pair_contraction(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """Contract the neighbour pair of least quadric error, eight neighbours each, with lazily refreshed queue entries."""
    rows = rows.copy()
    n = len(rows)
    if n <= budget:
        return rows
    planes = np.concatenate([rows[:, 3:6], -(rows[:, 3:6] * rows[:, :3]).sum(1, keepdims=True)], axis=1)
    quadric = planes[:, :, None] * planes[:, None, :]
    d = ((rows[:, None, :3] - rows[None, :, :3]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near: list[set[int]] = [set(np.argsort(d[i], kind="stable")[:8].tolist()) for i in range(n)]
    for i in range(n):
        for j in near[i]:
            near[j].add(i)
    stamp, alive, count = [0] * n, [True] * n, n
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        i, j = min(i, j), max(i, j)
        mid = np.append((rows[i, :3] + rows[j, :3]) / 2, 1.0)
        cost = float(mid @ (quadric[i] + quadric[j]) @ mid) + 1e-9 * float(((rows[i, :3] - rows[j, :3]) ** 2).sum())
        heapq.heappush(heap, (cost, i, j, stamp[i], stamp[j]))

    for i in range(n):
        for j in near[i]:
            if i < j:
                offer(i, j)
    while count > budget and heap:
        _, i, j, si, sj = heapq.heappop(heap)
        if not (alive[i] and alive[j] and stamp[i] == si and stamp[j] == sj):
            continue
        rows[i] = representative(rows[[i, j]])
        quadric[i] += quadric[j]
        alive[j] = False
        stamp[i] += 1
        count -= 1
        for k in near[j]:
            near[k].discard(j)
            if k != i and alive[k]:
                near[k].add(i)
                near[i].add(k)
        near[i].discard(i)
        near[i].discard(j)
        for k in near[i]:
            if alive[k]:
                offer(i, k)
    return rows[np.array(alive)][:budget]


@strategy("region_growing")
def region_growing(rows: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """Regions of equal size grow from unassigned seeds to their nearest unassigned neighbours."""
    if len(rows) <= budget:
        return rows.copy()
    size = -(-len(rows) // budget)
    free = np.ones(len(rows), bool)
    out = []
    while free.any():
        own = np.flatnonzero(free)
        d = ((rows[own, :3] - rows[own[0], :3]) ** 2).sum(1)
        take = own[np.argsort(d, kind="stable")[:size]]
        free[take] = False
        out.append(representative(rows[take]))
    return np.stack(out)


# -- reductions as column expressions --------------------------------------


def every_second(points: DataFrame, fan: int) -> DataFrame:
    """Child i gives its rows i, i + fan, ...; radii grow by the root of 1.5. ``child`` is the child's number."""
    rn = F.row_number().over(Window.partitionBy("node_id", "child").orderBy("pid")) - 1
    kept = points.withColumn("_rn", rn).where((F.col("_rn") >= F.col("child")) & (F.pmod(F.col("_rn") - F.col("child"), F.lit(fan)) == 0))
    return kept.withColumn("radius", F.col("radius") * (1.5**0.5)).drop("_rn")


def random_sample(points: DataFrame, budget: int, seed: int = 7) -> DataFrame:
    """At most ``budget`` rows with a radius per node, in the order of an arithmetic hash of the pid."""
    key = F.pmod(F.pmod(F.col("pid"), F.lit(4294967296)) * 2654435 + seed, F.lit(4294967291))
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(key, "pid"))
    return points.where(F.col("radius") > 0).withColumn("_rank", rank).where(F.col("_rank") <= budget).drop("_rank")
