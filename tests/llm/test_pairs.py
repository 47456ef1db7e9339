"""Near duplicates, repeated substrings and top-k search against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minhash, substring_dedup, topk
from lodestone.llm.common import WORDS

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def copies(seed=3):
    """Texts with exact copies, near copies at all distances, shared passages, repeats, short and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \n ", "one", "one", "One TWO", "one two three", "a " * 90, "a b " * 60, "É x y z É"]
    for k in range(60):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    for k in range(30):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([10, 50, 200]))]
        at = rng.randrange(len(w))
        texts.append(" ".join(w[:at] + (passage if k % 2 else passage[k:]) + w[at:]))
    texts += [" ".join(base), " ".join(base).upper(), " ".join(passage + passage)]
    return [(7 * i % 997, t) for i, t in enumerate(texts)]


def shingles(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def near(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = copies()
    df = spark.createDataFrame(rows, DOCS).withColumn("component", F.lit("clash")).withColumn("key", F.lit("clash"))
    out = minhash.near_duplicates(df, minhash.MinHashConfig(words=k, group=16))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()} == near(rows, k)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "A B C D E F")]
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("3", 1, False), ("None", None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 120), (120, 110), (200, 200)]
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(links, "x long, p long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 110: 100, 120: 100}


def test_minmax_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    config = minhash.MinHashConfig(permutations=512, rows=1)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = pool[:250], pool[50:]
    s = minhash.signatures(np.concatenate([a, b]), np.array([250, 250]), config)
    assert abs((s[0] == s[1]).mean() - 200 / 300) < 0.06


def removed(rows, window):
    words = [WORDS.findall(t or "") for _, t in rows]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    out = []
    for d, (doc_id, _) in enumerate(rows):
        w = words[d]
        gone = {i + j for key in (tuple(w[i : i + window]) for i in range(len(w) - window + 1)) for e, i in seen[key] if e == d and len(seen[key]) > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [35, 8])
def test_repeated_substrings(spark, window):
    rows = copies() + [(None, "q " * 50), (5000, "x y z " * 30), (5000, "x y z " * 30)]
    df = spark.createDataFrame(rows, DOCS).withColumn("name", F.lit("clash")).withColumn("whole", F.lit("clash"))
    out = substring_dedup.remove_repeats(df, substring_dedup.RepeatConfig(window=window)).collect()
    assert sorted((tuple(r) for r in out), key=str) == removed(rows, window)


def test_untouched_texts_stay(spark):
    rows = [(1, "keep \n this  text", "s"), (2, " ".join(map(str, range(60))), "s"), (3, "x " + " ".join(map(str, range(60))) + " y", "t"), (4, None, None)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS + ", source string"), keep=("source",), texts=True)
    assert {r["doc_id"]: (r["text"], r["rest"]["source"]) for r in out.collect()} == {1: ("keep \n this  text", "s"), 2: ("", "s"), 3: ("x y", "t"), 4: (None, None)}
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_symbols_are_consistent_inside():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 50, 400).astype(np.uint64)
    a = substring_dedup.levels(np.concatenate([[9991], words, [9992]]).astype(np.uint64), 3)
    b = substring_dedup.levels(np.concatenate([[7771, 5], words[100:300], [7772]]).astype(np.uint64), 3)
    for (s1, a1, b1), (s2, a2, b2) in zip(a, b, strict=True):
        one = {(x - 1, y - 1, int(s)) for s, x, y in zip(s1, a1, b1, strict=True) if x >= 101 and y <= 301}
        two = {(x - 2 + 100, y - 2 + 100, int(s)) for s, x, y in zip(s2, a2, b2, strict=True) if x >= 2 and y <= 202}
        assert one == two and one


def brute(rows, k):
    good = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for q in good:
        if q % 50 == 0:
            n = lambda c: min(len(good[q]), len(good[c]))
            scores = sorted(((-int(sum(int(a) * int(b) for a, b in zip(good[q][: n(c)], good[c][: n(c)], strict=True))), c) for c in good if c != q))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(40)] + [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [0.1] * 6), (500, []), (501, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_tile=3, shard_rows=16, fan_in=4)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5)


def test_top_k_of_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(7, [rng.uniform(-1, 1) for _ in range(4)]) for _ in range(150)] + [(8, [0.9] * 4)] * 150 + [(50, [1.0] * 4), (50, [-1.0] * 4)] + [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_tile=3, shard_rows=16, fan_in=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    floored = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows]
    assert set(got) == {50, 100, 150}
    for q, found in got.items():
        own = min((v for i, v in floored if i == q), key=tuple)
        want = sorted((-int(own @ v), i) for i, v in floored if i != q)[:5]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_top_k_large_numbers_and_few_rows(spark):
    rows = [(0, [1e6, 2e6]), (1, [3e6, -1e6]), (2, [1e6 + 1, 2e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0, 5).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    # A chain of small changes: neighbours are linked, far ones are not, so one head cannot link them all; ids repeat along it.
    rng = random.Random(8)
    words = [f"v{i}" for i in range(90)]
    rows = []
    for k in range(120):
        words = list(words)
        words[rng.randrange(90)] = f"n{k}"
        rows.append((k % 47 if k % 3 else 1000 + k, " ".join(words)))
    rows += [(7, " ".join(f"p{i}" for i in range(100))), (7, " ".join(f"q{i}" for i in range(100))), (2000, " ".join(f"q{i}" for i in range(2, 100))), (2001, None), (7, "")]
    sets = [shingles(t, 5) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, s), (j, t) in itertools.combinations(list(zip([i for i, _ in rows], sets, strict=True)), 2):
        if s and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    want = sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True))
    for prunings in (0, 2):
        config = minhash.MinHashConfig(group=8, prunings=prunings)
        out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), config)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()) == want
