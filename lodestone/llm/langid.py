"""Language identification by a linear-chain conditional random field over words.

Words are maximal runs of letters of the lower-cased text. A word's features
are hashed character n-grams with word-edge marks (``orders``; those with a
mark are prefixes and suffixes) and the hashed whole word, its lexicon entry.
Each feature has one weight per language; a matrix of learned transition
weights joins the languages of neighbouring words. Forward-backward gives each
word's distribution, so code-switched texts get a mixture; a text's language is
the one with the largest expected number of words.

Training sees only the language of a whole document. It treats the word labels
as hidden: the gradient is the difference of the expected counts with a bonus
for the document's language and without it, both by forward-backward. All words
of a training text count; one longer than a batch of the fit is learned in pieces.

Forward-backward runs over many texts laid end to end. The chain is cut into
rows of fixed length that are processed side by side: each row first gives its
transfer matrix, the rows' matrices are chained one after another, and a second
sweep turns the row's entry vectors into marginals. This is exact, with work in
proportion to the number of words, however long a text is.

Defined results: a null text, or one without letters, is ``und`` with score 0.
Documents without a language are labelled but not learned from. Every language
of the training rows is learned. With no
document to learn from, every text is ``und`` with score 0; with one language,
all texts with letters are of it. Ties go to the first language by code point.
Repeated rows get a row each, an empty table an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import bounded_batches, pieces_of, saved

_MULT = np.uint32(0x9E3779B1)
#: Words in a row of the chain, and steps between rescalings of its sweeps.
ROW, RESCALE = 128, 8
#: A batch of the fit has at most about so many characters for each of its words.
CHARS = 8
#: Characters that are certainly no letters.
_BREAK = re.compile(r"[\W\d_]")


@dataclass(frozen=True)
class LangConfig:
    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 17
    sample: int = 2000
    least_rows: int = 500
    passes: int = 6
    batch_words: int = 40_000
    rate: float = 0.3
    bonus: float = 4.0


@dataclass
class Model:
    languages: list[str]
    emission: np.ndarray
    transition: np.ndarray


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


_LETTERS: list[np.ndarray] = []


def words_of(texts: list[str | None], config: LangConfig) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of texts laid end to end: the text of each word, and for each kind of feature its buckets in word order with their number per word."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[0][codes]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1  # texts are enclosed in line feeds, so edges come in pairs
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [], np.zeros(0, np.int64)
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    text_of = np.searchsorted(np.cumsum(lengths), starts - 1, side="right")
    size = ends - starts
    marked = np.where(letter, codes, np.uint32(0))
    shift = np.uint32(32 - config.bits)
    out = []

    def put(h: np.ndarray, n: int, count: np.ndarray) -> None:
        g = (h ^ np.uint32(n)) * np.uint32(0x85EBCA6B)
        out.append((((g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> shift, count))

    h = marked * _MULT + np.uint32(1)
    for n in range(2, max(config.orders) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MULT + marked[n - 1 :]
        if n in config.orders:
            # A word with its two marks has size + 3 - n grams, from the mark before it on.
            count = np.maximum(size + 3 - n, 0)
            upto = np.cumsum(count)
            at = np.arange(upto[-1]) + np.repeat(starts - 1 - (upto - count), count)
            put(h[at], n, count)
    # The whole word: a sum of mixed (letter, place) pairs.
    at = np.flatnonzero(letter)
    first = np.cumsum(size) - size
    place = (np.arange(len(at)) - np.repeat(first, size)).astype(np.uint32)
    mixed = (codes[at] + place * np.uint32(0x01000193)) * _MULT
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint32(12)), first)
    put(whole.astype(np.uint32), 99, np.ones(len(starts), np.int64))
    return out, text_of


def word_scores(features: list[tuple[np.ndarray, np.ndarray]], emission: np.ndarray) -> np.ndarray:
    """Sum of the feature weights of each word, per language."""
    tables = [np.ascontiguousarray(e) for e in emission.T]
    total = [0.0] * len(tables)
    for buckets, count in features:
        first, some = np.cumsum(count) - count, count > 0
        for c, weights in enumerate(tables):
            sums = np.add.reduceat(np.append(weights[buckets], weights.dtype.type(0)), first)
            total[c] = total[c] + np.where(some, sums, 0)
    return np.stack(total, axis=1).astype(np.float64)


def marginals(scores: np.ndarray, fresh: np.ndarray, transition: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distribution of each word's language, and expected transition counts if wanted, by forward-backward.

    ``fresh`` marks the first word of each text; chains of texts don't touch.
    """
    n, k = scores.shape
    rows = -(-n // ROW)
    e = np.ones((rows * ROW, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    e = e.reshape(rows, ROW, k)
    cut = np.ones(rows * ROW, bool)
    cut[:n] = fresh
    cut = cut.reshape(rows, ROW)
    t = np.exp(transition)
    start = np.ones(k)

    def step(a: np.ndarray, at: int) -> np.ndarray:
        """Forward vectors (rows, ..., k) moved over the word at a place."""
        c = cut[:, at].reshape(-1, *[1] * (a.ndim - 1))
        moved = np.where(c, a.sum(axis=-1, keepdims=True) * start, (a.reshape(-1, k) @ t).reshape(a.shape)) * e[:, at].reshape(rows, *[1] * (a.ndim - 2), k)
        return moved if at % RESCALE else moved / moved.reshape(rows, -1).max(axis=1).reshape(-1, *[1] * (a.ndim - 1))

    transfer = np.broadcast_to(np.eye(k), (rows, k, k))
    for at in range(ROW):
        transfer = step(transfer, at)
    entry = np.empty((rows, k))
    v = np.ones(k)
    for r in range(rows):
        entry[r] = v
        v = v @ transfer[r]
        v = v / v.max()
    leave = np.empty((rows, k))
    v = np.ones(k)
    for r in range(rows - 1, -1, -1):
        leave[r] = v
        v = transfer[r] @ v
        v = v / v.max()
    alpha = np.empty((rows, ROW, k))
    a = entry
    for at in range(ROW):
        alpha[:, at] = a = step(a, at)
    post = np.empty((rows, ROW, k))
    counts = np.zeros((k, k))
    b = leave
    for at in range(ROW - 1, -1, -1):
        p = alpha[:, at] * b
        post[:, at] = p / p.sum(axis=1, keepdims=True)
        be = b * e[:, at]
        if counted:
            joint = (alpha[:, at - 1] if at else entry)[:, :, None] * t * be[:, None, :]
            joint *= (~cut[:, at] / joint.sum(axis=(1, 2)))[:, None, None]
            counts += joint.sum(axis=0)
        b = np.where(cut[:, at][:, None], (be * start).sum(axis=1, keepdims=True), be @ t.T)
        if at % RESCALE == 0:
            b = b / b.max(axis=1, keepdims=True)
    return post.reshape(-1, k)[:n], counts


def text_pieces(text: str, most: int) -> list[str]:
    """A text in pieces of about ``most`` characters that end at a character that is no letter, so every word stays whole."""
    out, at = [], 0
    while len(text) - at > most and (m := _BREAK.search(text, at + most)):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def _batches(rows: Iterable[tuple[str, str]], known: dict[str, int], config: LangConfig) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]]:
    """Features, the text of each word and the texts' languages, of about ``batch_words`` words at a time."""
    texts, labels, held = [], [], 0
    for text, lang in chain(rows, [(None, None)]):
        if text is not None and lang in known:
            texts.append(text)
            labels.append(known[lang])
            held += max(len(text.split()), len(text) // CHARS)
        if texts and (text is None or held >= config.batch_words):
            features, text_of = words_of(texts, config)
            if len(text_of):
                yield features, text_of, np.array(labels)
            texts, labels, held = [], [], 0


def fit_texts(rows: Callable[[], Iterable[tuple[str, str]]], languages: list[str], config: LangConfig) -> Model:
    """Fit on (text, language) rows in the order given. Each pass reads them anew, so the driver holds one batch at a time."""
    languages = sorted(languages)
    known = {lang: i for i, lang in enumerate(languages)}
    k, size = len(languages), 1 << config.bits
    emission, transition = np.zeros((size, k)), np.eye(k) * 1.0
    squares, t_squares = np.full((size, k), 1e-6), np.full((k, k), 1.0)
    if k < 2:
        return Model(languages, emission.astype(np.float32), transition)
    for _ in range(config.passes):
        for features, text_of, label in _batches(rows(), known, config):
            n = len(text_of)
            scores = word_scores(features, emission)
            fresh = np.concatenate([[True], text_of[1:] != text_of[:-1]])
            free, free_counts = marginals(scores, fresh, transition, counted=True)
            scores[np.arange(n), label[text_of]] += config.bonus
            tied, tied_counts = marginals(scores, fresh, transition, counted=True)
            gap = tied - free
            buckets = np.concatenate([x for x, _ in features])
            for c in range(k):  # AdaGrad on the features of the batch
                g = np.bincount(buckets, np.concatenate([np.repeat(gap[:, c], count) for _, count in features]), minlength=size)
                squares[:, c] += g * g
                emission[:, c] += config.rate * g / np.sqrt(squares[:, c])
            g = tied_counts - free_counts
            t_squares += g * g
            transition += config.rate * g / np.sqrt(t_squares)
    return Model(languages, emission.astype(np.float32), transition)


def label_texts(texts: list[str | None], model: Model, config: LangConfig) -> list[tuple[str, float]]:
    """The language of each text and its expected share of the words."""
    out: list[tuple[str, float]] = []
    # The chains' matrices grow with the languages, so many of them get smaller pieces.
    for lo, hi in pieces_of(texts, 16_000_000 // max(16, len(model.languages))):
        part = texts[lo:hi]
        features, text_of = words_of(part, config)
        if not len(text_of) or not model.languages:
            out += [("und", 0.0)] * len(part)
            continue
        fresh = np.concatenate([[True], text_of[1:] != text_of[:-1]])
        post, _ = marginals(word_scores(features, model.emission), fresh, model.transition)
        share = np.stack([np.bincount(text_of, p, minlength=len(part)) for p in post.T], axis=1)
        total = np.bincount(text_of, minlength=len(part))
        best = share.argmax(axis=1)
        for i in range(len(part)):
            out.append((model.languages[best[i]], min(1.0, float(share[i, best[i]] / total[i]))) if total[i] else ("und", 0.0))
    return out


def label_words(text: str, model: Model, config: LangConfig = LangConfig()) -> list[tuple[str, float]]:
    """The likeliest language of each word of a text, with its probability."""
    features, text_of = words_of([text], config)
    if not len(text_of) or not model.languages:
        return []
    fresh = np.arange(len(text_of)) == 0
    post, _ = marginals(word_scores(features, model.emission), fresh, model.transition)
    return [(model.languages[p.argmax()], float(p.max())) for p in post]


def fit(docs: DataFrame, learn: Column, config: LangConfig = LangConfig()) -> Model:
    """Train on the whole texts of documents (doc_id, text, lang) where ``learn`` holds: the ``sample`` with the smallest id
    hashes, and of each language the ``least_rows`` with the smallest, which are all rows of a rare language. The ids are
    chosen on narrow columns. The texts wait in pieces in the shared scratch folder; each pass of the driver reads them one
    partition at a time."""
    bounded_batches(docs.sparkSession)
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    # Ranks in two levels, so that no task meets all rows of a language.
    parts, whole = Window.partitionBy("lang", F.pmod("h", F.lit(64))), Window.partitionBy("lang")
    each = ids
    for w in (parts, whole):
        each = each.withColumn("rank", F.row_number().over(w.orderBy("h", "doc_id"))).where(F.col("rank") <= config.least_rows).drop("rank")
    first = ids.orderBy("h", "doc_id", "lang").limit(config.sample)
    chosen = first.unionByName(each).select("doc_id", "lang").distinct()
    # A repeated id gives one row of each language.
    got = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    order = F.xxhash64("doc_id", F.lit(7)).alias("order")

    def cut_up(batches):
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                row = b.slice(i, 1)
                for no, piece in enumerate(text_pieces(text, CHARS * config.batch_words)):
                    cols = [row.column(0), pa.array([no], pa.int32()), pa.array([piece], pa.string()), row.column(2)]
                    yield pa.RecordBatch.from_arrays(cols, names=["order", "piece", "text", "lang"])

    rows = saved(got.select(order, "text", "lang").mapInArrow(cut_up, "order long, piece int, text string, lang string"), "training")
    languages = [r["lang"] for r in rows.select("lang").distinct().collect()]
    ordered = rows.orderBy("order", "lang", "piece").select("text", "lang")
    return fit_texts(lambda: ((r["text"], r["lang"]) for r in ordered.toLocalIterator()), languages, config)


def predict(docs: DataFrame, model: Model, config: LangConfig = LangConfig(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` for every row."""
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text"))
    schema = given.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    # 2**bits weights for each language
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.emission, model.transition))

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            got = label_texts(b.column("_text").to_pylist(), own, config)
            cols = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, "lang_pred", "score"])

    return given.mapInArrow(run, schema)
