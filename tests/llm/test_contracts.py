"""Each registered query over its whole table: columns, types and rows, against plain definitions and held-out labels."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, sentencepiece_codec, toxicity
from lodestone.llm.common import WORDS
from test_native import rule, split, targets

SF = "/root/testdata/sf0.01"

COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op3_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op4_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op6_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "round_trip": "boolean"},
    "op7_token_counts": {"doc_id": "bigint", "n_tokens": "bigint", "edited_tokens": "bigint"},
    "op8_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def result(spark, name):
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    return df.collect()


def by_id(rows, docs):
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in docs)
    return {r["doc_id"]: r for r in rows}


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_toxicity(spark, docs):
    got = by_id(result(spark, "op1_toxicity"), docs)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, r in got.items():
        assert r["held_out"] == is_held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    asked = [i for i, y in toxic.items() if i in got and y is not None and is_held_out(i)]
    caught = [got[i]["predicted"] for i in asked if toxic[i]]
    flagged = [got[i]["predicted"] for i in asked if not toxic[i]]
    assert np.mean(caught) >= 0.6 and np.mean(flagged) <= 0.02


def test_toxicity_score_is_the_sum_of_its_grams():
    config = toxicity.ToxicityConfig(orders=(2, 3), bits=12)
    rng = np.random.default_rng(4)
    model = toxicity.Model(np.where(rng.random(1 << 12) < 0.4, rng.normal(size=1 << 12), 0).astype(np.float32), -0.3)
    mask = (1 << 32) - 1

    def bucket(gram):
        h = gram[0] * 0x9E3779B1 & mask
        for c in gram[1:]:
            h = ((h ^ h >> 15) * 0x9E3779B1 + c) & mask
        g = (h ^ len(gram)) * 0x85EBCA6B & mask
        return ((g ^ g >> 13) * 0xC2B2AE35 & mask) >> 20

    for text in [None, "", "a", "Hello hello, WORLD", "é🙂 x\n" * 5]:
        codes = [ord(c) for c in f" {text.lower()} "] if text else []
        grams = {bucket(codes[i : i + n]) for n in (2, 3) for i in range(len(codes) - n + 1)}
        margin = -0.3 + sum(float(model.weights[b]) for b in grams)
        assert abs(toxicity.score_text(text, model, config) - 1 / (1 + np.exp(-margin))) < 1e-9


def test_media(spark, docs):
    got = by_id(result(spark, "op2_media"), docs)
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        # Difference hash: areas of an 8 by 9 grid, by the plain definition.
        if d["doc_id"] % 40 == 0:
            image = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
            weight = lambda n, k: np.clip(np.minimum(np.arange(n) + 1, (np.arange(k)[:, None] + 1) * n / k) - np.maximum(np.arange(n), np.arange(k)[:, None] * n / k), 0, None)
            cells = weight(len(image), 8) @ image @ weight(64, 9).T * (72 / image.size) * 16
            small, clear = np.rint(cells), np.abs(cells - np.floor(cells) - 0.5) > 1e-6  # sums in another order may round a half otherwise
            bits = np.unpackbits(np.frombuffer(bytes.fromhex(r["feature"]), np.uint8)).reshape(8, 8)
            assert ((bits == (small[:, 1:] > small[:, :-1])) | ~clear[:, 1:] | ~clear[:, :-1]).all() and clear.mean() > 0.5


def test_urls(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = result(spark, "op3_url_filter")
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        host, path = split(pages[r["page_id"]])
        best = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.name) and r["verdict"] in ("allow", "block")
        assert best is None or r["verdict"] == best.verdict


def test_pieces(spark, docs):
    import sentencepiece

    got = by_id(result(spark, "op6_sentencepiece"), docs)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    for d, ids in zip(docs, library.encode([d["text"] or "" for d in docs]), strict=True):
        r = got[d["doc_id"]]
        if d["text"] is None:
            assert r["n_tokens"] is None
            continue
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
        assert r["round_trip"] == (sentencepiece_codec.MARK not in d["text"])


def test_counts(spark, docs):
    import tiktoken

    from lodestone.llm import token_counts

    encoding = token_counts.Tokenizer(token_counts.read_ranks(queries.BYTE_RANKS)).encoding
    assert isinstance(encoding, tiktoken.Encoding)
    got = by_id(result(spark, "op7_token_counts"), docs)
    for d in docs:
        assert got[d["doc_id"]]["n_tokens"] == len(encoding.encode_ordinary(d["text"] or ""))


def test_languages(spark, docs):
    got = by_id(result(spark, "op9_langid"), docs)
    known = {d["lang"] for d in docs if d["lang"] is not None and not is_held_out(d["doc_id"])}
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == is_held_out(d["doc_id"]) and 0 <= r["score"] <= 1
        if any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] in known
            if d["lang"] is not None and r["held_out"]:
                right.append(r["lang_pred"] == d["lang"])
        else:
            assert r["lang_pred"] == "und"
    assert np.mean(right) >= 0.97


def test_mix(spark, docs):
    rows = result(spark, "op10_mixing")
    got = by_id(rows, docs)
    sizes, taken = {}, {}
    for d in docs:
        r, n = got[d["doc_id"]], len(WORDS.findall(d["text"] or ""))
        assert r["size"] == n and 0 <= r["taken"] <= 2 * n
        sizes[d["source"]] = sizes.get(d["source"], 0) + n
        taken[d["source"]] = taken.get(d["source"], 0) + r["taken"]
    goal = targets(sizes)
    for d in docs:
        r = got[d["doc_id"]]
        assert r["source_size"] == sizes[d["source"]] and abs(r["target"] - goal[d["source"]]) < 1e-6 * max(1, goal[d["source"]])
    assert all(abs(taken[s] - goal[s]) <= 128 for s in sizes)


def test_all_queries_are_listed():
    assert set(COLUMNS) == set(queries.queries())


def test_pairs_queries(spark, docs):
    for name in ("op5_substring_dedup", "op8_minhash"):
        by_id(result(spark, name), docs)
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where(F.col("vec_id") % 50 == 0).count()
    assert len(result(spark, "op4_topk")) == 5 * asked
