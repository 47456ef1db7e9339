"""What the text operators share: word pattern, scratch tables, Arrow text access."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.model import cut

#: Words are maximal runs of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it again.

    This cuts the lineage with files that every executor can read, so a lost
    executor costs no recomputation of what came before.
    """
    return cut(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id counts as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche the bits of 64-bit words (a bijection)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Let Spark hand Python batches of about so many bytes, where the session leaves its default of eight times as much."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m").lower() in ("67108864", "67108864b", "64m", "64mb"):
        spark.conf.set(key, most)


def pieces_of(texts: list, most_chars: int = 1_000_000):
    """Slices of a list of texts (or of their lengths) with about most_chars characters each, so that numpy's working memory stays bounded."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += t if isinstance(t, int) else len(t) if t else 0
        if held >= most_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWERED = np.where((_AS_IS >= 65) & (_AS_IS <= 90), _AS_IS + 32, _AS_IS).astype(np.uint8)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """64-bit hashes of the words of UTF-8 texts, in order; words per text; where each word starts and ends in the joined bytes."""
    joined = b"\n".join(t or b"" for t in texts)
    raw = np.frombuffer(joined, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), starts, ends, joined
    at = np.flatnonzero(inside)
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(first, length)
    powers = np.ones(int(length.max()), np.uint64)
    powers[1:] = _STEP
    powers = np.cumprod(powers, dtype=np.uint64)
    values = _BYTE[(_LOWERED if lower else _AS_IS)[raw[at]]] * powers[place]
    h = mix64(np.add.reduceat(values, first) + length.astype(np.uint64))
    per_text = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return h, per_text, starts, ends, joined


_PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, per_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, and how many each has; a shorter text's whole sequence is one, no words are none."""
    n = len(words)
    first = np.cumsum(per_text) - per_text
    count = np.where(per_text >= k, per_text - k + 1, np.minimum(per_text, 1))
    if not n:
        return np.zeros(0, np.uint64), count
    total = words * _PLACE[0]
    for j in range(1, k):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - j] = words[j:]
        total = total + shifted * _PLACE[j]
    upto = np.cumsum(count)
    at = np.arange(upto[-1]) + np.repeat(first - (upto - count), count)
    out = total[at]
    for i in np.flatnonzero((per_text > 0) & (per_text < k)):
        w = words[first[i] : first[i] + per_text[i]]
        out[upto[i] - 1] = (w * _PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix64(out), count
