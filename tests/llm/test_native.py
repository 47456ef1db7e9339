"""URL filter and mixing against plain definitions."""

import random
import re

from pyspark.sql import functions as F

from lodestone.llm import mixing, url_filter
from lodestone.llm.common import WORDS
from lodestone.llm.queries import RULES

PAGES = "page_id long, url string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/es/1?x", "https://a.b.example.org/en/17", "http://example.org", "http://x.com/fr/9#t", "http://x.com/de/",
    "http://notcom/de/1", "ftp://q.net/a/b/c/d/e/f/g/h/i", "http://É.com/de/É", "http://h.com?de/", "a://b://c.org/x", "http://org/", "://com/fr/", "http://u.net/" + "x" * 3000,
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, RULES).select("_row.page_id", "host", "path", "rule", "verdict").collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host, path = split(u)
        best = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.name)
        assert got[i]["verdict"] in ("allow", "block")
        if best:
            assert got[i]["verdict"] == best.verdict


def test_tree_rejects_pure_templates_and_merges(spark):
    rows, k = [], 0
    for kind, label in (("cheap", 1), ("offers", 1), ("news", 0), ("help", 0)):
        for n in range(120):
            rows.append((k, f"http://shop.net/{kind}/{n}", label if n % 2 else None))
            k += 1
    df = spark.createDataFrame(rows, PAGES + ", bad int")
    out = url_filter.filter_urls(df, [], label="bad").select("_row.url", "verdict", "template").collect()
    for r in out:
        assert r["verdict"] == ("block" if re.search("cheap|offers", r["url"]) else "allow")
    assert {r["template"] for r in out} == {"/cheap|offers/{n}", "/help|news/{n}"}


def test_many_values_become_a_wildcard(spark):
    rows = [(i, f"http://s.net/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/about") for i in range(200)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, PAGES), []).select("template").distinct().collect()
    assert [r["template"] for r in out] == ["/*/about"]


def test_templates_learned_elsewhere_judge_unlabelled_hosts(spark):
    deep = "/".join("abcdefghijkl")
    rows = [(i, f"http://h{i % 9}.net/win/{i}", 1) for i in range(180)] + [(1000 + i, f"http://h{i % 9}.net/read/{i}", 0) for i in range(180)]
    rows += [(2000 + i, f"http://h{i % 9}.net/{deep}/bad/{i}", 1) for i in range(180)] + [(3000 + i, f"http://h{i % 9}.net/{deep}/good/{i}", 0) for i in range(180)]
    rows += [(9001, "http://new.org/win/7", None), (9002, "http://new.org/read/7", None), (9003, f"http://new.org/{deep}/bad/7", None), (9004, f"http://new.org/{deep}/good/7", None), (9005, "http://new.org/else", None)]
    # On its own host a template counts more than the same path elsewhere.
    rows += [(5000 + i, f"http://fair.net/win/{i}", 0) for i in range(300)] + [(9006, "http://fair.net/win/9999", None)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, PAGES + ", bad int"), [], label="bad")
    got = {r["page_id"]: r["verdict"] for r in out.select("_row.page_id", "verdict").where("page_id > 9000").collect()}
    assert got == {9001: "allow", 9002: "allow", 9003: "block", 9004: "allow", 9005: "allow", 9006: "allow"}
    fewer = spark.createDataFrame([r for r in rows if not 5000 <= r[0] < 6000], PAGES + ", bad int")
    assert {r["verdict"] for r in url_filter.filter_urls(fewer, [], label="bad").where("_row.page_id = 9001").collect()} == {"block"}


def test_segments_are_no_part_of_node_names(spark):
    rows = [(i, f"http://s.net/{s}/x", bad) for s, bad in (("a", 1), ("b", 1), ("a|b", 0), ("*", 0), ("{n}", 0), ("17", 1)) for i in range(60)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, PAGES + ", bad int"), [], label="bad").select("_row.url", "verdict").distinct().collect()
    assert {r["url"].split("/")[3]: r["verdict"] for r in out} == {"a": "block", "b": "block", "a|b": "allow", "*": "allow", "{n}": "allow", "17": "block"}


def plain_purity(rows, config):
    """Counts and backed-off shares of (host, segments, label) rows whose tree has no merging and no wildcards."""
    labelled = [r for r in rows if r[2] is not None]
    share = lambda some, p: (sum(r[2] for r in some) + config.smoothing * p) / (len(some) + config.smoothing)
    out = {}
    for host, segs, _ in rows:
        n, p = len(labelled), sum(r[2] for r in labelled) / len(labelled)
        for some in [*([r for r in labelled if r[1][:k] == segs[:k]] for k in range(1, len(segs) + 1)), [r for r in labelled if r[:2] == (host, segs)]]:
            if len(some) != n:
                n, p = len(some), share(some, p)
        out[host, segs] = p
    return out


def test_purity_is_that_of_plain_counts(spark):
    rng = random.Random(6)
    rows = [(f"h{rng.randrange(3)}.net", tuple(rng.choice("abc") for _ in range(rng.randint(1, 3))), rng.choice([0, 1, 1, None])) for _ in range(300)]
    config = url_filter.TreeConfig(similar_z=0.0, min_labelled=1000)
    df = spark.createDataFrame([(i, f"http://{h}/{'/'.join(s)}", y) for i, (h, s, y) in enumerate(rows)], PAGES + ", bad int")
    out = url_filter.filter_urls(df, [], config, label="bad").select("host", "path", "purity").collect()
    want = plain_purity(rows, config)
    for r in out:
        assert abs(r["purity"] - want[r["host"], tuple(r["path"][1:].split("/"))]) < 1e-12


def test_empty_pages(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES), RULES).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, goal, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        rest = total - sum(goal[s] for s in names if s not in open_)
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in above:
            goal[s] = 2.0 * sizes[s]
        open_ -= above
        if not above:
            for s in open_:
                goal[s] = level * weight[s]
            break
    return goal


def corpus(n=150, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "d", None])
        text = None if i % 29 == 0 else "" if i % 31 == 0 else " \n".join(f"w{i}x{j}" for j in range(rng.choice([1, 5, 40, 300])))
        rows.append((i if i % 37 else None, text, "en", source, 0))
    return rows + rows[:2]


def test_mix_meets_targets(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash"))
    got = mixing.mix_counts(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    goal = targets(sizes)
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    for s, words in sizes.items():
        taken = by_target[words, round(goal[s], 6)]
        assert abs(sum(taken) - goal[s]) <= mixing.MixConfig().block_words
    again = mixing.mix_counts(df).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mixed_texts_have_the_taken_words(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50 + i)), "en", "ab"[i % 2], 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(df).collect()}
    out = {r["doc_id"]: r["text"] for r in mixing.mix_documents(df).collect()}
    assert set(out) == {i for i, n in taken.items() if n}
    for i, text in out.items():
        words = text.split()
        assert len(words) == taken[i] and set(words) <= set(rows[i][1].split())


def test_multinomial_draws_and_permutation(spark):
    config = mixing.MixConfig(block_words=8, shard_slots=64)
    sizes = spark.createDataFrame([(i, "ab"[i % 2], 100) for i in range(200)], "doc_id long, source string, size long")
    sources = mixing.source_targets(sizes, config)
    slots = mixing.drawn_slots(sources, config)
    assert slots.groupBy("sid", "j").count().where("count > 1").isEmpty()
    quota = {r["sid"]: r["quota"] for r in sources.collect()}
    assert {r["sid"]: r["count"] for r in slots.groupBy("sid").count().collect()} == quota
    n = 97
    perm = mixing.permuted(spark.range(n).withColumns({"at": F.col("id"), "n": F.lit(n).cast("long"), "k": F.lit(3)}), "at", "n", ["k"], config)
    image = [r["at"] for r in perm.orderBy("id").collect()]
    assert sorted(image) == list(range(n)) and image != list(range(n))


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " \n", "en", None, 0)], DOCS)
    assert [(r["size"], r["taken"]) for r in mixing.mix_counts(blank).collect()] == [(0, 0), (0, 0)]
