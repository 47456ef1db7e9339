"""Removal of long repeated word runs, by recompression.

A text's words get 64-bit names. A round of recompression replaces maximal runs
of one symbol, and then pairs of a symbol from one half of the alphabet and a
following one from the other half, by new symbols. A symbol's name is a hash of
what it replaces, and halves are drawn by a hash of the name, so every executor
gives equal runs and pairs the same global name. For each symbol the words that
decided it (its context) are known, so equal substrings have equal symbols
wherever the context lies inside.

Each window of ``window`` words is represented by one such interior symbol: of
those of the highest level whose context lies in the window, the one with the
least name hash. That choice depends on the window's words alone, so equal
windows have equal representatives, and neighbouring windows mostly share
theirs: they form segments. The Spark rounds then are:

1. count the representatives by their names (with the context's words). Names
   that occur once settle their windows as unique. If all segments of a name
   have the same words, their windows are repeated as they stand;
2. for the other names, the windows of their segments are named by their words
   and counted one by one, which verifies each repeat;
3. the repeated windows come back to their documents.

The texts are dealt by document once, for rounds 2 and 3. A row is known by its
id and a 64-bit hash of its text, or by two such hashes if the id is null; rows
that agree in that are equal and lose the same words. Rows are counted before they meet, so a passage in a third of all documents is one counted row
per task and name.

Defined results: null and empty texts have no words and lose none; texts
shorter than a window lose none; a text may have any number of words, and takes
about 200 bytes a word while it is at hand. Repeated rows are documents of their own, so
their windows repeat. Rows with a null id are treated like any other. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, mix64, pieces_of, saved, word_hashes

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_C1, _C2, _C3 = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03))
#: Places in a symbol array; the bits above hold the rank of a name, whose ties the place settles as it does in every equal window.
_INDEX = np.uint64((1 << 36) - 1)


@dataclass(frozen=True)
class RepeatConfig:
    window: int = 35
    rounds: int = 3


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Parsed:
    """Words of several texts in one array, with a separator of its own name around each text, and range hashes."""

    def __init__(self, words: np.ndarray, per_text: np.ndarray):
        self.per_text = per_text
        k = len(per_text)
        self.first = np.cumsum(per_text) - per_text + np.arange(1, k + 1)  # place of each text's first word
        names = mix64(np.arange(len(words) + k + 1, dtype=np.uint64) + _C3)  # separators keep these
        names[np.arange(len(words)) + np.repeat(np.arange(1, k + 1), per_text)] = words
        self.names = names
        self.back = _powers(_BACK, len(names) + 1)
        self.sums = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * _powers(_BASE, len(names)), out=self.sums[1:], dtype=np.uint64)

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the words of each range, whatever their place."""
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def levels(names: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, context start, context end) of the symbols of level 0 and after each round."""
    a = np.arange(len(names))
    out = [(names, a, a + 1)]
    sym, a, b = out[0]
    for r in range(1, rounds + 1):
        tag = mix64(np.array([r], np.uint64) * _C1)
        # Runs; that a run ends is decided by the symbols around it.
        first = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
        after = np.append(first[1:], len(sym))
        length = (after - first).astype(np.uint64)
        sym = np.where(length > 1, mix64(sym[first] * _C2 + length + tag), sym[first])
        a, b = a[np.maximum(first - 1, 0)], b[np.minimum(after, len(b) - 1)]
        # Pairs of a left symbol and a right one.
        left = (mix64(sym + tag) & np.uint64(1)) == 1
        pair = np.zeros(len(sym), bool)
        pair[:-1] = left[:-1] & ~left[1:]
        k = np.flatnonzero(~np.concatenate([[False], pair[:-1]]))
        after = np.minimum(k + 1, len(sym) - 1)
        joined = pair[k]
        new = np.where(joined, mix64(sym[k] * _C1 + mix64(sym[after] + tag)), sym[k])
        # A symbol that stays single is decided by the neighbour it could have been paired with.
        stay_left = joined | left[k]
        a, b = np.where(stay_left, a[k], a[np.maximum(k - 1, 0)]), np.where(stay_left, b[after], b[k])
        sym = new
        out.append((sym, a, b))
    return out


def segments(p: Parsed, config: RepeatConfig) -> tuple[np.ndarray, ...]:
    """Segments of windows with one representative: text, first window, last window (places), name, and hash of all their words."""
    size, n = config.window, len(p.names)
    windows = np.maximum(p.per_text - size + 1, 0)
    total = int(windows.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    text = np.repeat(np.arange(len(windows)), windows)
    w = np.arange(total) + np.repeat(p.first - (np.cumsum(windows) - windows), windows)
    name, begin = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    todo = np.arange(total)
    for level, (sym, a, b) in reversed(list(enumerate(levels(p.names, config.rounds)))):
        if not len(todo):
            break
        # Symbols lo to hi - 1 have their context inside the window.
        lo = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n + 1))])[w[todo]]
        hi = np.cumsum(np.bincount(b, minlength=n + 1))[w[todo] + size]
        some = hi > lo
        at, lo, hi = todo[some], lo[some], hi[some]
        todo = todo[~some]
        if not len(at):
            continue
        rank = [(mix64(sym ^ _C2) & ~_INDEX) | np.arange(len(sym), dtype=np.uint64)]
        step = np.frexp((hi - lo).astype(np.float64))[1] - 1  # floor of log2
        for k in range(int(step.max())):
            rank.append(np.minimum(rank[-1][: -(1 << k)], rank[-1][1 << k :]))
        best = np.empty(len(at), np.uint64)
        for k, row in enumerate(rank):
            own = np.flatnonzero(step == k)
            best[own] = np.minimum(row[lo[own]], row[hi[own] - (1 << k)])
        j = (best & _INDEX).astype(np.int64)
        begin[at] = a[j]
        name[at] = mix64(p.ranges(a[j], b[j]) * _C1 + sym[j] + np.uint64(level))
    new = np.ones(total, bool)
    new[1:] = (begin[1:] != begin[:-1]) | (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    w1, w2 = w[first], w[last]
    offset, length = (w1 - begin[first]).astype(np.int64), (w2 - w1).astype(np.int64)
    whole = mix64(p.ranges(w1, w2 + size) * _C3 + mix64((offset * (1 << 20) + length).view(np.uint64)))
    return text[first], w1, w2, name[first], whole


def _parts(b: pa.RecordBatch):
    """(lo, hi, texts as bytes, Parsed) of pieces of a batch with a column ``text``."""
    texts = b.column("text").cast(pa.binary()).to_pylist()
    for lo, hi in pieces_of(texts):
        words, per_text, *_ = word_hashes(texts[lo:hi])
        yield lo, hi, texts[lo:hi], Parsed(words, per_text)


def _ordinal(text: np.ndarray) -> np.ndarray:
    """Number of each segment within its text."""
    return np.arange(len(text)) - np.searchsorted(text, text)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def flag_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text`` and the ``keep`` columns as ``rest``, with the numbers of each row's repeated segments (``whole``)
    and the places of its other repeated windows (``single``)."""
    rest = F.struct(F.lit(0).alias("_none"), *(F.col(f"`{c}`") for c in keep)).alias("rest")
    number = F.col("doc_id").cast("long")
    own = docs.select(
        number.alias("doc_id"), F.col("text"), rest, F.coalesce(number, F.xxhash64("text", F.lit(1))).alias("id"), F.xxhash64("text", number.isNull()).alias("th")
    )
    bounded_batches(docs.sparkSession)

    def name_segments(batches):
        for b in batches:
            for lo, hi, _, p in _parts(b):
                text, _, _, name, whole = segments(p, config)
                row = pa.array(text)
                cols = [_signed(name), _signed(whole), b.column("id").slice(lo, hi - lo).take(row), b.column("th").slice(lo, hi - lo).take(row)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(_ordinal(text).astype(np.int32))], names=["name", "whole", "id", "th", "seg"])

    found = own.select("id", "th", "text").mapInArrow(name_segments, "name long, whole long, id long, th long, seg int")
    names = found.groupBy("name").agg(F.count("*").alias("n"), F.min("whole").alias("w1"), F.max("whole").alias("w2"))
    names = saved(names.where("n > 1").select("name", (F.col("w1") == F.col("w2")).alias("same")), "names")
    hits = found.drop("whole").join(names, "name")
    hits = hits.groupBy("id", "th").agg(
        F.collect_set(F.when(F.col("same"), F.col("seg"))).alias("whole"), F.collect_set(F.when(~F.col("same"), F.col("seg"))).alias("check")
    )
    hits = saved(hits, "hits")
    dealt = own.repartition("id", "th")
    # The hash side holds segment numbers only; the texts stream past it. All columns of the dealt
    # rows are asked for here too, so that both uses share one exchange.
    open_ = dealt.join(hits.where(F.size("check") > 0).select("id", "th", "check").hint("shuffle_hash"), ["id", "th"])

    def name_windows(batches):
        for b in batches:
            checks = b.column("check")
            for lo, hi, _, p in _parts(b):
                text, w1, w2, name, _ = segments(p, config)
                chosen = np.zeros(len(text), bool)
                for i in range(hi - lo):
                    base = np.searchsorted(text, i)
                    chosen[base + np.array(checks[lo + i].as_py(), np.int64)] = True
                text, w1, w2, name = text[chosen], w1[chosen], w2[chosen], name[chosen]
                many = w2 - w1 + 1
                row, key = np.repeat(text, many), np.repeat(name, many)
                w = np.arange(len(row)) + np.repeat(w1 - (np.cumsum(many) - many), many)
                words = mix64(p.ranges(w, w + config.window) * _C2 + key)
                at = pa.array(row)
                cols = [_signed(words), _signed(key), b.column("id").slice(lo, hi - lo).take(at), b.column("th").slice(lo, hi - lo).take(at)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array((w - p.first[row]).astype(np.int32))], names=["words", "name", "id", "th", "w"])

    windows = open_.mapInArrow(name_windows, "words long, name long, id long, th long, w int")
    # Counted under one more key, so that the join deals both sides anew and adaptive execution can split a passage that a
    # third of the documents share.
    counted = windows.groupBy(F.xxhash64("words", "name").alias("k"), "words", "name").agg(F.count("*").alias("n"))
    repeated = counted.where("n > 1").select("words", "name")
    single = windows.join(repeated, ["words", "name"]).groupBy("id", "th").agg(F.collect_set("w").alias("single"))
    out = dealt.join(hits.select("id", "th", "whole").hint("shuffle_hash"), ["id", "th"], "left").join(single.hint("shuffle_hash"), ["id", "th"], "left")
    return out.select("doc_id", "text", "rest", "whole", "single", "id", "th")


def removed_words(p: Parsed, whole: list, single: list, config: RepeatConfig) -> np.ndarray:
    """Which places of the word array are covered by repeated windows."""
    text, w1, w2, _, _ = segments(p, config)
    change = np.zeros(len(p.names) + 1, np.int64)
    for i, (segs, places) in enumerate(zip(whole, single, strict=True)):
        if segs:
            at = np.searchsorted(text, i) + np.array(segs, np.int64)
            np.add.at(change, w1[at], 1)
            np.add.at(change, w2[at] + config.window, -1)
        if places:
            at = p.first[i] + np.array(places, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + config.window, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space).

    With ``texts``, instead: doc_id, ``text`` (as it was if nothing is removed, else the kept words joined by one space) and
    ``rest``, a struct with the ``keep`` columns.
    """
    flagged = flag_repeats(docs, config, keep)
    schema = flagged.select("doc_id", "text", "rest").schema if texts else "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches):
        for b in batches:
            whole, single = b.column("whole").to_pylist(), b.column("single").to_pylist()
            for lo, hi, part, p in _parts(b):
                gone = removed_words(p, whole[lo:hi], single[lo:hi], config) if any(whole[lo:hi]) or any(single[lo:hi]) else None
                removed, out = [], []
                for i, t in enumerate(part):
                    mask = gone[p.first[i] : p.first[i] + p.per_text[i]] if gone is not None else None
                    n = int(mask.sum()) if mask is not None else 0
                    removed.append(n)
                    if texts and not n:
                        out.append(t)
                        continue
                    words = (t or b"").split()
                    kept = b" ".join(compress(words, (~mask).tolist()) if n else words)
                    out.append(kept if texts else hashlib.sha256(kept).hexdigest())
                rows = b.slice(lo, hi - lo)
                ids = rows.column("doc_id")
                if texts:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()).cast(pa.string()), rows.column("rest")], names=["doc_id", "text", "rest"])
                else:
                    cols = [ids, pa.array(p.per_text), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return flagged.mapInArrow(run, schema)
