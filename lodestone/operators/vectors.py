"""The nearest other vector of each of a table of integer vectors, exact, over all pairs.

Rows are dealt to blocks of bounded size. Every two blocks meet in one task, in
tiles that are matrix products, and a pair of blocks serves the queries of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.model import cut

#: Rows of a block at most, blocks of smaller tables, and rows of a tile.
BLOCK, BLOCKS, TILE = 32768, 8, 1024


def nearest_vector(vectors: DataFrame) -> DataFrame:
    """vec_id, neighbor and d2 of the nearest other row of (vec_id, v array<long>), ties to the smaller id.

    A component that is null or missing on one side adds nothing; without a common one the distance is null, which comes last.
    """
    at = cut(vectors.select("vec_id", "v"), "vectors")
    n = at.count()
    blocks = max(1, -(-n // BLOCK), min(BLOCKS, -(-n // TILE)))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o")
    rows = at.withColumn("_own", own).select("vec_id", "v", "_own", other)
    rows = rows.select("vec_id", "v", "_own", F.least("_own", "_o").alias("_i"), F.greatest("_own", "_o").alias("_j"))
    pair = (F.col("_j") * (F.col("_j") + 1) / 2 + F.col("_i")).cast("int")
    met = rows.withColumn("_pair", pair).repartitionById(blocks * (blocks + 1) // 2, "_pair")  # two blocks a task
    met = met.sortWithinPartitions("_pair", "_own").select("_pair", "_own", "vec_id", "v")
    best = met.mapInArrow(_meet, "vec_id long, neighbor long, d2 long")
    m = F.min(F.struct(F.col("d2").isNull().alias("none"), "d2", "neighbor"))
    return best.groupBy("vec_id").agg(m.alias("m")).select("vec_id", "m.neighbor", "m.d2")


def _dense(np, v):
    """Values (0 where there is none) and flags of a list column, as wide as its longest."""
    sizes = v.value_lengths().fill_null(0).to_numpy()
    flat = v.flatten()
    has = flat.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values, flags = (np.zeros((len(sizes), sizes.max(initial=0)), t) for t in (np.int64, bool))
    values[row, slot] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    flags[row, slot] = has
    return values, flags


def _wide(np, values, flags, width):
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (values, flags))


def _factors(np, a, am, b, bm):
    """Two matrices whose product are the squared distances, and two for the number of common components where some are missing.

    Products of floats are exact while all sums stay below 2^53; larger values take long ones.
    """
    largest = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    kind = np.float64 if 4 * float(largest) ** 2 * max(1, a.shape[1]) < 2.0**53 else np.int64
    x, y = a.astype(kind), b.astype(kind)
    if am.all() and bm.all() and a.shape[1]:
        one = np.ones((len(x), 1), kind), np.ones((len(y), 1), kind)
        return np.hstack([-2 * x, (x * x).sum(1)[:, None], one[0]]), np.hstack([y, one[1], (y * y).sum(1)[:, None]]), None
    f, g = am.astype(kind), bm.astype(kind)
    return np.hstack([x * x, f, -2 * x]), np.hstack([g, y * y, y]), (f, g)


def _meet(batches):
    """Rows sorted by pair of blocks: both sides are held, one pair at a time."""
    import numpy as np
    import pyarrow as pa

    def nearest(one, two, same):
        """The best of ``two`` for each of ``one`` and, unless they are the same, the other way round."""
        width = max(one[1].shape[1], two[1].shape[1])
        (a_id, a, am), (b_id, b, bm) = ((s[0], *_wide(np, *s[1:], width)) for s in (one, two))
        left, right, flags = _factors(np, a, am, b, bm)
        out = []
        for x in range(0, len(a_id), TILE):
            for y in range(0, len(b_id), TILE):
                d2 = left[x : x + TILE] @ right[y : y + TILE].T
                none = None if flags is None else flags[0][x : x + TILE] @ flags[1][y : y + TILE].T == 0
                p, q = a_id[x : x + TILE], b_id[y : y + TILE]
                self_ = p[:, None] == q[None, :] if same else None
                out += held(d2, none, self_, p, q)
                if not same:
                    out += held(d2.T, None if none is None else none.T, None, q, p)
        return out

    def held(d2, none, self_, p, q):
        big = np.inf if d2.dtype.kind == "f" else np.iinfo(np.int64).max
        if none is not None:
            d2 = np.where(none, big, d2)
        if self_ is not None:
            d2 = np.where(self_, big, d2)
        at = d2.argmin(1)
        v = d2[np.arange(len(d2)), at]
        gone = v == big
        if gone.any():  # no distance: the smallest other id stands, if there is one
            at = np.where(gone, (self_.argmin(1) if self_ is not None else 0), at)
        keep = np.ones(len(p), bool) if self_ is None else ~self_[np.arange(len(p)), at]
        v = np.where(gone, 0, v).astype(np.int64)
        return [(p[keep], q[at][keep], v[keep], gone[keep])]

    def done(sides):
        sides = {k: (np.concatenate([i for i, _, _ in s]), [x[1:] for x in s]) for k, s in sides.items()}
        ready = []
        for ids, parts in sides.values():
            width = max(v.shape[1] for v, _ in parts)
            v, f = (np.concatenate(c) for c in zip(*(_wide(np, *x, width) for x in parts), strict=True))
            order = np.argsort(ids, kind="stable")
            ready.append((ids[order], v[order], f[order]))
        return ready

    def results(pair, sides):
        ready = done(sides)
        j = int(((8 * pair + 1) ** 0.5 - 1) // 2)
        alone = pair - j * (j + 1) // 2 == j
        if not alone and len(ready) < 2:
            return
        rows = nearest(ready[0], ready[0], True) if alone else nearest(*ready, False)
        ids, other, d2, gone = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((other, d2, gone, ids))  # one row of each query leaves the task
        first = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(order) else order
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(other[first]), pa.array(d2[first], mask=gone[first])], names=["vec_id", "neighbor", "d2"])

    key, sides = None, {}
    for batch in batches:
        pairs, owns = batch.column("_pair").to_numpy(), batch.column("_own").to_numpy()
        new = np.flatnonzero((pairs[1:] != pairs[:-1]) | (owns[1:] != owns[:-1])) + 1
        for a, b in zip((0, *new), (*new, len(pairs)), strict=True):
            if a == b:
                continue
            if pairs[a] != key:
                if key is not None:
                    yield from results(int(key), sides)
                key, sides = pairs[a], {}
            sides.setdefault(int(owns[a]), []).append((batch.column("vec_id").slice(a, b - a).to_numpy(), *_dense(np, batch.column("v").slice(a, b - a))))
    if key is not None:
        yield from results(int(key), sides)
