"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (``orders``) of the lower-cased text, hashed
into ``2**bits`` buckets, each scaled by the log ratio of its smoothed document
frequencies in the two classes. Only the ``features`` buckets whose frequencies
differ most clearly are kept; logistic regression with an L2 penalty gives them
weights. Training uses at most ``sample`` labelled rows of each class, those
with the smallest hashes of their ids; everything else covers all rows.

Scoring is one pass over whole texts in Arrow batches with a table of
``2**bits`` floats, whose size is fixed by the configuration. Only the text goes
to Python and only the score comes back. A text of any length is scored whole;
its n-grams take about 60 bytes a character while it is at hand.

Defined results: null and empty texts have no features, so they score what the
model gives without any: its bias, learned with the classes in balance. An id
that is repeated among the documents is learned from once, with its least text.
Rows without a label, or with an id that is missing from the
labels, are scored but not learned from. With no labelled row of one class the
model has no features and scores the smoothed share of label 1 (0 without any
labels). Repeated rows get a row each, an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, saved

_MULT = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class ToxicityConfig:
    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 18
    sample: int = 1200
    features: int = 20_000
    least_docs: int = 4
    alpha: float = 1.0
    l2: float = 2.0
    steps: int = 200
    threshold: float = 0.7


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def gram_buckets(text: str | None, config: ToxicityConfig) -> np.ndarray:
    """Hash buckets of all n-grams, one after another for each order, repeats included."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], codes * _MULT
    for n in range(2, max(config.orders) + 1):
        if len(codes) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MULT + codes[n - 1 :]
        if n in config.orders:
            g = (h ^ np.uint32(n)) * np.uint32(0x85EBCA6B)
            out.append((g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - config.bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def distinct_buckets(text: str | None, config: ToxicityConfig) -> np.ndarray:
    return np.unique(gram_buckets(text, config))


def chosen_features(count: np.ndarray, n: np.ndarray, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Kept buckets and their log-count ratios, from document frequencies by class (2, buckets) and documents by class."""
    p, q = (count[1] + config.alpha) / (n[1] + 2 * config.alpha), (count[0] + config.alpha) / (n[0] + 2 * config.alpha)
    # Clearness: the difference of the shares in units of its standard error.
    pooled = (count[1] + count[0] + 1) / (n[1] + n[0] + 2)
    z = np.abs(p - q) / np.sqrt(pooled * (1 - pooled) * (1 / n[1] + 1 / n[0]))
    z[count[1] + count[0] < config.least_docs] = 0
    kept = np.sort(np.argsort(-z, kind="stable")[: config.features])
    kept = kept[z[kept] > 0]
    return kept, np.log(p / q)[kept]


def constant_model(n: np.ndarray, config: ToxicityConfig) -> Model:
    """Without rows of one class there are no features, and the score is the smoothed share of label 1."""
    share = (n[1] + 1e-3) / (n[1] + n[0] + 2) if n[1] else 0.0
    return Model(np.zeros(1 << config.bits, np.float32), float(np.log(share / (1 - share))) if share else -np.inf)


def trained(columns: list[np.ndarray], y: np.ndarray, kept: np.ndarray, scale: np.ndarray, config: ToxicityConfig) -> Model:
    """Logistic regression on the kept features of each row, scaled by their ratios."""
    at = np.repeat(np.arange(len(columns), dtype=np.int32), [len(c) for c in columns])
    col = np.concatenate(columns)
    w, b = np.zeros(len(kept)), 0.0
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    n1 = y.sum()
    balance = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
    for t in range(1, config.steps + 1):  # Adam on the whole sample
        margin = b + np.bincount(at, (w * scale)[col], minlength=len(y))
        err = balance * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) / len(y)
        g = np.bincount(col, err[at], minlength=len(kept)) * scale + config.l2 * w / len(y)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - 0.05 * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b = b - 0.05 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    weights = np.zeros(1 << config.bits, np.float32)
    weights[kept] = w * scale
    return Model(weights, float(b))


def score_text(text: str | None, model: Model, config: ToxicityConfig) -> float:
    """Probability of label 1."""
    g = gram_buckets(text, config)
    hit = g[model.weights[g] != 0]
    margin = model.bias + float(model.weights[np.unique(hit)].astype(np.float64).sum())
    return float(1 / (1 + np.exp(-margin))) if margin > -700 else 0.0


def fit(docs: DataFrame, labels: DataFrame, learn: Column, config: ToxicityConfig = ToxicityConfig()) -> Model:
    """Train on documents (doc_id, text) joined to labels (doc_id, toxic) where ``learn`` (of doc_id) holds.

    The ids are chosen on the narrow labels table; at most 2 * sample rows of
    kept features reach the driver.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    order = F.xxhash64("doc_id")
    parts = [usable.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(config.sample) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample rows of two numbers
    texts = docs.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")

    def hashed(batches):
        for b in batches:
            rows = [distinct_buckets(t.as_py(), config).astype(np.uint32).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["toxic", "buckets"])

    def counted(batches):
        count, n = np.zeros((2, 1 << config.bits), np.int32), np.zeros(2, np.int64)
        for b in batches:
            for y, g in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                count[y][np.frombuffer(g.as_buffer(), np.uint32)] += 1
                n[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([count.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["count", "n"])

    # The buckets stay on the executors: the driver gets class counts of a few parts, and then the kept features of each row.
    sample = saved(texts.mapInArrow(hashed, "toxic int, buckets binary"), "sample")
    count, n = np.zeros((2, 1 << config.bits), np.int64), np.zeros(2, np.int64)
    for r in sample.coalesce(4).mapInArrow(counted, "count binary, n binary").toLocalIterator():
        count += np.frombuffer(r["count"], np.int32).reshape(count.shape)
        n += np.frombuffer(r["n"], np.int64)
    if not n.all():
        return constant_model(n, config)
    kept, scale = chosen_features(count, n, config)
    place = np.full(1 << config.bits, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(place)  # 2**bits numbers

    def kept_only(batches):
        for b in batches:
            rows = [place_of[place_of >= 0].tobytes() for g in b.column(1) for place_of in [shared.value[np.frombuffer(g.as_buffer(), np.uint32)]]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["toxic", "kept"])

    got = sorted((r["toxic"], bytes(r["kept"])) for r in sample.mapInArrow(kept_only, "toxic int, kept binary").collect())
    return trained([np.frombuffer(c, np.int32) for _, c in got], np.array([y for y, _ in got], np.float64), kept, scale, config)


def score(docs: DataFrame, model: Model, config: ToxicityConfig = ToxicityConfig(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2**bits floats
    bounded_batches(docs.sparkSession)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for texts in batches:
            yield pa.array([score_text(t.as_py(), own, config) for t in texts], pa.float64())

    # Not to be evaluated again by a filter on the score.
    value = F.arrow_udf(scores, "double").asNondeterministic()
    return docs.select(*(F.col(f"`{c}`") for c in keep), value(F.col(f"`{text}`")).alias("score"))
