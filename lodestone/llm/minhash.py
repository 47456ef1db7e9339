"""Near-duplicate documents by min-max hashing, with every link confirmed on full shingle sets.

A permutation of 64-bit shingle hashes is evaluated once and gives two
signature values, its minimum and its maximum over the set. Bands of
``rows`` values become bucket keys; two documents are candidates if they share
a key. With the defaults a pair of similarity 0.8 is missed with probability
about 1e-9.

Documents with equal sets form a class, and one member stands for it. Within
buckets, all pairs are never made:

1. each bucket is headed by the member with the most company in all its
   buckets (of a group of copies, one close to the original), and every member
   is compared with one other, the head of most of its buckets;
2. components of the confirmed links are found, and where a bucket still spans
   several components, the members outside its largest one are compared with
   those of other components. Before that, members whose sets cannot reach the
   similarity with any other in the bucket leave it: a shingle that no other
   member of an open bucket has is in no intersection, so what remains of a set,
   and the least set size in the bucket, bound every similarity exactly. That
   closes most buckets, and is done ``prunings`` times, as each time leaves more
   shingles with one holder. Connected members need no test.

Confirmation compares whole sets of shingle hashes in blocks of about ``group``
documents (two such tiles in the second round), so that a large group is as many
tasks as it needs.

Components come from alternating star contraction over tables, so neither
links nor components reach the driver.

Defined results: texts without words (null, empty, white space) have no
shingles and link with nothing. Rows that share an id are one document: any of
its texts may link, and they share a component. A row with a null id is given its set size, takes no part,
and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, mix64, pieces_of, saved, shingle_hashes, word_hashes


@dataclass(frozen=True)
class MinHashConfig:
    words: int = 5
    percent: int = 80
    permutations: int = 80
    rows: int = 4
    group: int = 128
    prunings: int = 2

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.rows


def signatures(shingles: np.ndarray, count: np.ndarray, config: MinHashConfig) -> np.ndarray:
    """Rows of band keys for texts with at least one shingle: minimum and maximum under each permutation, mixed by band."""
    some = count[count > 0]
    first = np.cumsum(some) - some
    seeds = mix64(np.arange(1, 2 * config.permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values = np.empty((len(some), 2 * config.permutations), np.uint64)
    for p in range(config.permutations):
        moved = shingles * (seeds[2 * p] | np.uint64(1)) + seeds[2 * p + 1]
        values[:, 2 * p] = np.minimum.reduceat(moved, first)
        values[:, 2 * p + 1] = np.maximum.reduceat(moved, first)
    keys = np.zeros((len(some), config.bands), np.uint64)
    for r in range(config.rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r :: config.rows][:, : config.bands])
    return mix64(keys + np.arange(config.bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketch(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """doc_id, n_shingles, two set fingerprints, and the band keys (8 bytes each)."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in pieces_of(texts):
                words, per_text, *_ = word_hashes(texts[lo:hi], lower=True)
                shingles, count = shingle_hashes(words, per_text, config.words)
                size, one, two = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                at = np.cumsum(count) - count
                for i in np.flatnonzero(count):
                    own = np.unique(shingles[at[i] : at[i] + count[i]])
                    size[i], one[i], two[i] = len(own), own.sum(dtype=np.uint64), np.bitwise_xor.reduce(own * np.uint64(0xE7037ED1A0B428DB))
                keys: list[bytes | None] = [None] * (hi - lo)
                for i, k in zip(np.flatnonzero(count), signatures(shingles, count, config), strict=True):
                    keys[i] = k.tobytes()
                ids = b.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(keys, pa.binary())],
                    names=["doc_id", "n_shingles", "f1", "f2", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys binary")


def _sets(raw: list[bytes | None], config: MinHashConfig) -> list[np.ndarray]:
    """Sorted shingle hashes of each text."""
    out: list[np.ndarray] = []
    for lo, hi in pieces_of(raw):
        words, per_text, *_ = word_hashes(raw[lo:hi], lower=True)
        shingles, count = shingle_hashes(words, per_text, config.words)
        at = np.cumsum(count) - count
        out += [np.unique(shingles[a : a + c]) for a, c in zip(at, count, strict=True)]
    return out


def _alike(s: np.ndarray, t: np.ndarray, config: MinHashConfig) -> bool:
    if 100 * min(len(s), len(t)) < config.percent * max(len(s), len(t)):
        return False
    common = len(np.intersect1d(s, t, assume_unique=True))
    return common > 0 and 100 * common >= config.percent * (len(s) + len(t) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, config: MinHashConfig) -> DataFrame:
    """Those (x, p) pairs whose whole sets reach the similarity. ``texts`` has id and text.

    The members to compare with a document come to it in groups of about ``group``.
    """
    load = pairs.groupBy("p").agg(F.expr(f"(count(*) - 1) div {config.group} + 1").alias("parts"))
    dealt = pairs.join(load, "p").select("p", "x", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part"))
    heads = load.select("p", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    sides = texts.withColumnRenamed("id", "x").join(dealt, "x").select("p", "part", "x", "text")
    tops = texts.withColumnRenamed("id", "p").join(heads, "p").select("p", "part", F.lit(None).cast("long").alias("x"), "text")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        x = rows.column("x").to_pylist()
        sets = _sets(rows.column("text").cast(pa.binary()).to_pylist(), config)
        tops = [s for i, s in zip(x, sets, strict=True) if i is None]
        # Rows that share an id are one document, so any of its texts may link.
        found = sorted({i for i, s in zip(x, sets, strict=True) if i is not None and any(_alike(s, t, config) for t in tops)})
        return pa.table([pa.array(found, pa.int64()), pa.array([key[0].as_py()] * len(found), pa.int64())], names=["x", "p"])

    return sides.unionByName(tops).groupBy("p", "part").applyInArrow(compare, "x long, p long")


def crossing_links(open_: DataFrame, texts: DataFrame, config: MinHashConfig) -> DataFrame:
    """Links between documents of different components that share an open bucket.

    ``open_`` has key, x, component, main, tile, n and rest (see ``able``). Tiles, not pairs,
    meet on the bucket: one with a member outside the bucket's largest component
    meets every tile of the bucket. A block of two tiles then compares its
    documents of different components, so a text goes to one block per tile of
    its group. One link between two components is enough, and ``rest`` bounds
    what a pair can reach.
    """
    tiles = open_.groupBy("key", "tile").agg(
        F.max(F.col("component") != F.col("main")).alias("minor"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    a, b = tiles.where("minor").alias("a"), tiles.alias("b")
    differ = (F.col("a.low") != F.col("b.low")) | (F.col("a.high") != F.col("b.high")) | (F.col("a.low") != F.col("a.high"))
    blocks = a.join(b, (F.col("a.key") == F.col("b.key")) & differ).select(F.least("a.tile", "b.tile").alias("b1"), F.greatest("a.tile", "b.tile").alias("b2")).distinct()
    blocks = saved(blocks, "blocks")
    needed = blocks.withColumn("tile", F.explode(F.array_distinct(F.array("b1", "b2"))))
    members = saved(open_.select("tile", "x", "component", "n", "rest").distinct(), "tiled")
    rows = members.join(needed, "tile").join(texts.withColumnRenamed("id", "x"), "x").select("b1", "b2", "x", "component", "n", "rest", "text")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        x, comp, n, rest = (rows.column(c).to_numpy() for c in ("x", "component", "n", "rest"))
        sets = _sets(rows.column("text").cast(pa.binary()).to_pylist(), config)
        most = np.minimum(rest[:, None], rest[None])
        could = (comp[:, None] != comp[None]) & (100 * most >= config.percent * (n[:, None] + n[None] - most))
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        found = []
        for i, j in zip(*np.nonzero(np.triu(could)), strict=True):
            p, q = root(int(comp[i])), root(int(comp[j]))
            if p != q and _alike(sets[i], sets[j], config):
                joined[max(p, q)] = min(p, q)
                found.append((int(x[i]), int(x[j])))
        return pa.table([pa.array([v for v, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["x", "p"])

    return rows.groupBy("b1", "b2").applyInArrow(compare, "x long, p long")


def tiled(kin: DataFrame, config: MinHashConfig) -> DataFrame:
    """x and tile: documents with one head (``kin``) in tiles of about a group."""
    load = kin.groupBy("kin").agg(F.expr(f"(count(*) - 1) div {config.group} + 1").alias("parts"))
    return kin.join(load, "kin").select("x", F.xxhash64("kin", F.pmod(F.xxhash64("x"), F.col("parts"))).alias("tile"))


def own_shingles(texts: DataFrame, config: MinHashConfig) -> DataFrame:
    """x and ``own``, the number of its shingles that no other of the texts (id, text) has."""

    def run(batches):
        for b in batches:
            raw = b.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in pieces_of(raw):
                words, per_text, *_ = word_hashes(raw[lo:hi], lower=True)
                shingles, count = shingle_hashes(words, per_text, config.words)
                row = pa.array(np.repeat(np.arange(lo, hi), count))
                yield pa.RecordBatch.from_arrays([b.column("id").take(row), pa.array(shingles.view(np.int64))], names=["x", "shingle"])

    found = texts.select("id", "text").mapInArrow(run, "x long, shingle long")
    held = found.groupBy("shingle").agg(F.min("x").alias("x"), F.max("x").alias("y")).where("x = y")
    # What an id with several texts has alone may be spread over them, so it bounds none of them.
    several = texts.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("x"))
    return held.groupBy("x").agg(F.count("*").alias("own")).join(several, "x", "left_anti")


def open_buckets(members: DataFrame) -> DataFrame:
    """The members (key, x, component and more) of buckets with several components, and ``main``, the bucket's largest one."""
    parts = members.groupBy("key", "component").agg(F.count("*").alias("c"))
    parts = parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return members.join(parts.select("key", "main"), "key")


def able(open_: DataFrame, texts: DataFrame, config: MinHashConfig) -> DataFrame:
    """The members of open buckets whose sets can reach the similarity with any other there, and ``rest``, the most shingles in common."""
    own = saved(own_shingles(texts.join(open_.select(F.col("x").alias("id")).distinct(), "id", "left_semi"), config), "own")
    bounded = open_.select("key", "x", "n", "component").join(own, "x", "left").withColumn("rest", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    least = open_.groupBy("key").agg(F.min("n").alias("least"))
    # common / (n + least - common) at common = rest
    reach = (100 + config.percent) * F.col("rest") >= config.percent * (F.col("n") + F.col("least"))
    return bounded.join(least, "key").where(reach).drop("least")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node with a link (x, p), by alternating star contraction."""
    edges = saved(links.select(F.greatest("x", "p").alias("u"), F.least("x", "p").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours move to the smallest one around.
        large = saved(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # Small star: the smaller neighbours and the node itself move to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now


def same_id(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (x, p) between an id with several rows and the classes of their sets."""
    several = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    held = sketches.join(several, "doc_id", "left_semi").join(classes, ["f1", "f2", "n_shingles"])
    return held.where("doc_id <> class_id").select(F.col("doc_id").alias("x"), F.col("class_id").alias("p")).distinct()


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """doc_id, n_shingles, class_id (of equal sets), component_id and kept for each row of doc_id and text."""
    bounded_batches(docs.sparkSession)
    sketches = saved(sketch(docs, config), "sketch")
    same = ["f1", "f2", "n_shingles"]
    classes = saved(sketches.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("class_id")), "classes")
    stands = classes.select(F.col("class_id").alias("doc_id"), *same)
    # A key is eight bytes of the binary, read as a signed number.
    slots = F.explode(F.expr(f"transform(sequence(0, {config.bands - 1}), i -> cast(conv(hex(substring(keys, i * 8 + 1, 8)), 16, -10) as bigint))"))
    members = sketches.join(stands, ["doc_id", *same], "left_semi").select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), slots.alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = saved(members.join(saved(shared, "shared"), "key"), "members")

    company = members.groupBy("x").agg(F.sum("size").alias("company"))
    heads = members.join(company, "x").groupBy("key").agg(F.max_by(F.struct(F.col("x").alias("head"), "company"), F.struct("company", -F.col("x"))).alias("h"))
    votes = members.join(heads, "key").where("x <> h.head").groupBy("x", "h").agg(F.count("*").alias("votes"))
    first = votes.groupBy("x").agg(F.max_by("h.head", F.struct("votes", "h.company", -F.col("h.head"))).alias("p"))
    first = saved(first, "first")
    involved = members.select(F.col("x").alias("doc_id")).distinct()
    texts = saved(docs.select(F.col("doc_id").cast("long"), "text").join(involved, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")
    links = saved(confirmed(first, texts, config).unionByName(same_id(sketches, classes)), "links1")

    known = components(links)
    at = members.join(known.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    open_ = saved(open_buckets(at.select("key", "x", "n", "component")), "open").withColumn("rest", F.col("n"))
    for _ in range(config.prunings):
        open_ = saved(open_buckets(able(open_, texts, config)), "able")
    kin = open_.select("x").distinct().join(first, "x", "left").select("x", F.coalesce("p", "x").alias("kin"))
    open_ = open_.join(saved(tiled(saved(kin, "kin"), config), "tiles"), "x")
    links = links.unionByName(saved(crossing_links(saved(open_, "bounded"), texts, config), "links2"))
    final = saved(components(links), "components")
    found = sketches.join(classes, same, "left").withColumn("node", F.coalesce("class_id", "doc_id"))
    found = found.join(final, "node", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    out = found.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), whole.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
