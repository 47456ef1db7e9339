"""Exact top-k search by tiled integer matrix products.

Vectors become floor(scale * x) per component. Candidates are dealt over shards
and queries over query tiles, both of bounded size; each (tile, shard) pair is
one cogroup that holds two bounded blocks. A block product is one matrix
product; the k best of each query are picked from it by partial selection, and
the lists are merged in a tree: groups of ``fan_in`` shards per round, until
one list per query is left. Rows are dealt one by one, not by their ids, so equal ids
and equal rows spread over all shards, and no group grows with the data.

Defined results: a vector that is null or holds a null, NaN or infinite
component takes no part, as query or as candidate; neither do rows with a null
id. An empty vector scores 0 with all. Vectors of unequal lengths are compared
over the shorter length. Rows that share an id count as the same vector row of
a query, so none of them is a candidate for it; a repeated query id gives one
list, that of the least of its vectors. Other repeated rows are candidates each. Ties go to the smaller id. Scores are exact: float64 products where every
sum stays below 2^53, integers of any size otherwise, clipped to the range of
long. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS = "query_id long, shard long, vec_id long, score long"
QUERY_TILE, SHARD_ROWS, FAN_IN, STRIP = 4096, 2048, 16, 512


def floored(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * values.astype(np.float64))


def _matrix(col: pa.ChunkedArray, dim: int, scale: float) -> np.ndarray:
    """Rows padded with zeros to a common length, which leaves inner products as they are."""
    lists = col.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = floored(lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()], scale)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best of the rows: index of the query, id and score, in rank order."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    top = [float(np.abs(x).max(initial=0)) for x in (queries, rows)]
    exact = top[0] * top[1] * rows.shape[1] < 2**53
    if not exact:
        queries, rows = (np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object) for x in (queries, rows))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), STRIP):
        score = queries[at : at + STRIP] @ rows.T
        if not exact:
            score = np.clip(score, -(2**63), 2**63 - 1).astype(np.int64)
        # The k-th best score of each query bounds its list; ties at the bound are settled by id, as rows stand in id order.
        own = query_ids[at : at + STRIP, None] == ids[None, :]
        low = -np.inf if exact else np.iinfo(np.int64).min
        picked = np.where(own, low, score)
        n = min(k + 1, picked.shape[1])
        bound = np.partition(picked, picked.shape[1] - n, axis=1)[:, picked.shape[1] - n] if n else np.zeros(len(picked))
        q, c = np.nonzero((picked >= bound[:, None]) & ~own)
        s = score[q, c]
        by = np.lexsort((c, -s if exact else ~s, q))
        q, c, s = q[by], c[by], s[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        found.append((q[keep] + at, ids[c[keep]], s[keep].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def top_k(
    vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    query_tile: int = QUERY_TILE, shard_rows: int = SHARD_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best rows for each query row."""
    x = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.where(F.col(f"`{vec_id}`").isNotNull() & sound).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), is_query.alias("q")
    )
    counted = good.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("d")).first()
    tiles, shards = max(1, math.ceil(counted["q"] / query_tile)), max(1, math.ceil(counted["n"] / shard_rows))
    dim = counted["d"] or 0
    spread = F.xxhash64("id")
    # The number of a row is the same each time that its partition is read.
    rows = good.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("id", "v", F.pmod(F.xxhash64("id", "row"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    asked = good.where("q").groupBy("id").agg(F.min("v").alias("v")).select(
        F.col("id").alias("qid"), F.col("v").alias("qv"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(spread, F.lit(tiles)).cast("int").alias("tile")
    )

    def block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = [x.split()[0] for x in HITS.split(", ")], [pa.int64()] * 4
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids, query_ids = left.column("id").to_numpy(), right.column("qid").to_numpy()
        q, found, score = best_of(_matrix(right.column("qv"), dim, scale), query_ids, _matrix(left.column("v"), dim, scale), ids, k)
        return pa.table([query_ids[q], np.full(len(q), key[1].as_py(), np.int64), found, score], names=names)

    lists = rows.groupBy("tile", "shard").cogroup(asked.groupBy("tile", "shard")).applyInArrow(block, HITS)
    order = [F.col("score").desc(), F.col("vec_id")]
    while True:
        # A group has at most fan_in lists of k rows.
        group = F.expr(f"shard div {fan_in}")
        shards = math.ceil(shards / fan_in)
        lists = lists.withColumn("shard", group)
        rank = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        lists = lists.drop("rank")
