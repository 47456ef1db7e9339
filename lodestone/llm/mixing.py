"""Mix sources to target weights with repeatable block draws, in DataFrame code only.

1. Each source's documents stand in a hash order and their words form one
   stream, cut into blocks of ``block_words`` (the last may be shorter).
2. Each slot of each output shard draws a source with probability in
   proportion to the sources' slot quotas, so a shard's counts are multinomial.
   What a source draws beyond its quota is void; what is missing from a quota
   at the end goes to closing shards, so the totals meet the targets.
3. A source's slots are numbered through. Number j stands for a place in pass
   j div n over the source's n blocks, and a keyed permutation of that pass
   (swap-or-not rounds) maps the place to a block index.
4. Slots and blocks meet in an equi-join on (source, block).

Running totals are kept in two levels (totals of buckets, then rows within a
bucket), so a source with a third of all rows is no single task's work.

Defined results: null and empty texts have size 0 and nothing taken; a null
source is a source of its own, ordered last; rows with the same id are separate
documents, told apart by a hash of their texts; only rows alike in id and text
are gathered, to share what they are given. An empty table gives an
empty result. Every draw is a hash of ids, counters and ``seed``, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, saved


#: Slots that one task lists.
SLOTS = 65_536


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (3, 1, 2)
    total: float = 1.5
    most: int = 2
    block_words: int = 128
    shard_slots: int = 1024
    rounds: int = 16
    seed: int = 20_240_229


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """One row per source: sid, source, source_size, docs, target, and its block and slot counts.

    A target is the lesser of ``most`` times the size and a common level times
    the weight; the level is where the targets add up to the total, which is
    what resharing the excess by weight comes to.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    n = len(config.weights)
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    src = src.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in config.weights)), (F.pmod(F.col("sid") - 1, F.lit(n)) + 1).cast("int"))
    )
    src = src.withColumn("cap", F.lit(float(config.most)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    left = F.lit(config.total) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", level).withColumn("open", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    src = src.withColumn("level", F.min(F.struct(F.col("open").isNull().cast("int"), F.col("cap") / F.col("weight"), "sid", "open")).over(every)["open"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    src = src.withColumn("target", target).withColumn("want", F.round("target").cast("long"))
    size, block = F.col("source_size"), F.lit(config.block_words)
    whole = F.when(size > 0, F.expr("want div source_size")).otherwise(0)
    src = src.withColumn("blocks", F.ceil(size / block)).withColumn("whole", whole).withColumn("rest", F.col("want") - F.col("whole") * size)
    src = src.withColumn("rest_slots", F.ceil(F.col("rest") / block)).withColumn("quota", F.col("whole") * F.col("blocks") + F.col("rest_slots"))
    return src.select(
        "sid", "source", "source_size", "docs", "target", "blocks", "quota",
        F.when(F.col("rest") > 0, F.col("rest") - (F.col("rest_slots") - 1) * block).otherwise(block).alias("closing"),
    )


def placed(sizes: DataFrame, sources: DataFrame, config: MixConfig) -> DataFrame:
    """Each document's offset in its source's stream, as running totals in two levels."""
    src = sources.select("sid", F.col("source").alias("_source"), "docs", "source_size", "target")
    buckets = F.greatest(F.lit(1), F.ceil(F.sqrt("docs")))
    docs = sizes.join(src, F.col("source").eqNullSafe(F.col("_source"))).withColumn("key", F.xxhash64("doc_id", "h", F.lit(config.seed)))
    docs = docs.withColumn("bucket", F.pmod("key", buckets).cast("long"))
    within = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.count(F.lit(1)).over(within))
    totals = docs.groupBy("sid", "bucket").agg(F.max("upto").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    return docs.join(totals, ["sid", "bucket"]).select(
        "doc_id", "h", "size", "sid", "source_size", "target", "bucket", "nth", (F.col("base") + F.col("upto") - F.col("size")).alias("off")
    )


def permuted(df: DataFrame, at: str, n: str, key: list[str], config: MixConfig) -> DataFrame:
    """Replace ``at`` (0 to n - 1) by its image under a keyed permutation of 0 to n - 1.

    A swap-or-not round pairs x with k - x modulo n and swaps the two if a bit
    hashed from the larger is set; each round is a permutation of any range.
    """
    for r in range(config.rounds):
        k = F.pmod(F.xxhash64(*key, F.lit(config.seed), F.lit(r), F.lit("k")), F.col(n))
        df = df.withColumn("_p", F.pmod(k - F.col(at), F.col(n)))
        bit = F.xxhash64(F.greatest(at, "_p"), *key, F.lit(config.seed), F.lit(r)).bitwiseAND(F.lit(1))
        df = df.withColumn(at, F.when(bit == 1, F.col("_p")).otherwise(F.col(at)))
    return df.drop("_p")


def drawn_slots(sources: DataFrame, config: MixConfig) -> DataFrame:
    """shard, sid, j: the slots of all shards, with a number for each of a source's slots."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota").alias("n"), F.count("*").alias("k")).first()
    n, cells = int(total["n"] or 0), max(1024, 4 * total["k"])
    by_sid = Window.orderBy("sid")
    bounds = sources.where("quota > 0").withColumn("hi", F.sum("quota").over(by_sid.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = bounds.select("sid", "quota", ((F.col("hi") - F.col("quota")) / max(n, 1)).alias("lo"), (F.col("hi") / max(n, 1)).alias("hi"))
    first, last = F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    by_cell = bounds.select("sid", "lo", "hi", F.explode(F.sequence(first, last)).alias("cell"))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(config.seed), F.lit("slot")), 11) / float(1 << 53)
    slots = spark.range(n).select(F.expr(f"id div {config.shard_slots}").alias("shard"), u.alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells))
    hits = slots.join(by_cell, "cell").where("u >= lo and u < hi")
    counts = saved(hits.groupBy("shard", "sid").agg(F.count("*").alias("c")), "draws")
    # Running totals per source over the shards, in two levels.
    chunk = F.expr(f"shard div {max(1, int((n / config.shard_slots) ** 0.5))}")
    counts = counts.withColumn("chunk", chunk)
    chunks = counts.groupBy("sid", "chunk").agg(F.sum("c").alias("cc"))
    up_to = Window.unboundedPreceding
    base = F.coalesce(F.sum("cc").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(up_to, -1)), F.lit(0))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy("sid", "chunk").orderBy("shard").rowsBetween(up_to, -1)), F.lit(0))
    counts = counts.withColumn("inner", inner).join(chunks.withColumn("base", base).select("sid", "chunk", "base"), ["sid", "chunk"])
    # Few rows that become many: they are dealt out before their slots are listed.
    counts = counts.join(sources.select("sid", "quota"), "sid").withColumn("start", F.col("base") + F.col("inner"))
    kept = counts.withColumn("end", F.least(F.col("start") + F.col("c"), "quota")).where("end > start")
    # What a source has not drawn of its quota fills closing shards.
    got = counts.groupBy("sid").agg(F.sum("c").alias("got"))
    short = sources.select("sid", "quota").join(got, "sid", "left").withColumn("start", F.coalesce("got", F.lit(0))).where("quota > start")
    short = short.withColumn("gap", F.col("quota") - F.col("start"))
    short = short.withColumn("base", F.coalesce(F.sum("gap").over(by_sid.rowsBetween(up_to, -1)), F.lit(0)))
    shards = -(-n // config.shard_slots)
    closing = short.select("sid", F.col("start").alias("first"), "base", F.explode(F.sequence("start", F.col("quota") - 1)).alias("j"))
    closing = closing.select(F.expr(f"{shards} + (base + j - first) div {config.shard_slots}").alias("shard"), "sid", "j")
    kept = kept.select("shard", "sid", "start", "end").repartition(n // SLOTS + 1, "shard", "sid")
    return kept.select("shard", "sid", F.explode(F.sequence("start", F.col("end") - 1)).alias("j")).unionByName(closing)


def mix_pieces(places: DataFrame, sources: DataFrame, config: MixConfig) -> DataFrame:
    """The mix itself: shard, sid, j (slot number of the source), epoch, block, and of which document which words.

    One row per slot and document part: sid, bucket, nth (the document), start, n_words (n_words > 0).
    """
    slots = drawn_slots(sources, config).join(sources.select("sid", "blocks", "quota", "closing"), "sid")
    slots = slots.withColumn("epoch", F.expr("j div blocks")).withColumn("block", F.expr("j % blocks"))
    slots = permuted(slots, "block", "blocks", ["sid", "epoch"], config)
    length = F.when(F.col("j") == F.col("quota") - 1, F.col("closing")).otherwise(F.lit(config.block_words))
    # Written out, as the optimizer would copy the rounds' expressions into each filter that the join implies.
    slots = saved(slots.select("shard", "sid", "j", "epoch", "block", length.alias("length")), "slots")
    size = config.block_words
    parts = places.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(off div {size}, (off + size - 1) div {size})")))
    parts = parts.withColumn("lo", F.greatest(F.col("off"), F.col("block") * size)).withColumn("hi", F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * size))
    parts = parts.select("sid", "block", "bucket", "nth", "lo", "hi", "off")
    got = slots.join(parts, ["sid", "block"])
    end = F.least("hi", F.col("block") * size + F.col("length"))
    return got.select("shard", "sid", "j", "epoch", "block", "bucket", "nth", (F.col("lo") - F.col("off")).alias("start"), (end - F.col("lo")).alias("n_words")).where("n_words > 0")


def mix_plan(docs: DataFrame, config: MixConfig = MixConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, sources, pieces) for documents with doc_id, text and source; texts are read once and not shuffled."""
    sizes = saved(docs.select("doc_id", "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size")), "sizes")
    sources = saved(source_targets(sizes, config), "sources")
    places = saved(placed(sizes, sources, config), "places")
    return places, sources, mix_pieces(places, sources, config)


def mix_counts(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, size, source_size, target and taken for each document."""
    places, _, pieces = mix_plan(docs, config)
    taken = pieces.groupBy("sid", "bucket", "nth").agg(F.sum("n_words").alias("taken"))
    out = places.join(taken, ["sid", "bucket", "nth"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mixed corpus with the columns of documents: each taken document once, its text what the mix takes of it.

    A document taken whole and once keeps its text; otherwise its taken words
    follow one another pass by pass, joined by one space. Untaken documents go.
    Rows with the same id and text share what they were given by turns.
    """
    places, _, pieces = mix_plan(docs, config)
    spans = pieces.groupBy("sid", "bucket", "nth").agg(
        F.sum("n_words").alias("taken"), F.array_sort(F.collect_list(F.struct("epoch", "start", "n_words"))).alias("spans")
    )
    spans = places.join(spans, ["sid", "bucket", "nth"]).select("doc_id", "h", "size", "taken", "spans")
    # Rows of one id and text are told apart by their rank, so that joining never multiplies them.
    key = {"_id": F.coalesce("doc_id", F.lit(-1)), "_none": F.col("doc_id").isNull()}
    on = ["_id", "_none", "h", "size"]
    turns = spans.withColumns(key).groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("taken", "spans"))).alias("turns"))
    sized = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size")).withColumns(key)
    sized = sized.withColumn("_turn", F.row_number().over(Window.partitionBy(*on).orderBy(F.col("source").asc_nulls_last())))
    out = sized.join(turns, on).withColumn("_own", F.get("turns", F.col("_turn") - 1)).where(F.col("_own").isNotNull())
    spans, text = F.col("_own.spans"), F.col("text")
    whole = (F.col("_own.taken") == F.col("size")) & (F.element_at(spans, -1)["epoch"] == F.element_at(spans, 1)["epoch"])
    # The one-element transform binds the words, which would be split again for each span otherwise.
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    one = lambda w: F.transform(spans, lambda x: F.slice(w, (x["start"] + 1).cast("int"), x["n_words"].cast("int")))
    cut = F.array_join(F.flatten(F.element_at(F.transform(words, one), 1)), " ")
    out = out.withColumn("_text", F.when(whole, text).otherwise(cut))
    return out.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.length("_text").cast("long").alias("n_chars"))
