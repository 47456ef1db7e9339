"""Toxicity, language identification, media, token counts and the piece codec on small fixtures."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, media, sentencepiece_codec, token_counts, toxicity
from lodestone.llm.queries import BYTE_RANKS, PIECE_MODEL

ODD = [None, "", " ", "\n\t", "a", "é" * 300, "🙂 x", "word " * 3000]


def labelled(n=300, seed=1):
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "sha", "ver", "ing", "est"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001]
    wrong = [i for i, y in labels if i % 2 and (got[i] >= 0.7) != bool(y)]
    assert len(wrong) <= 3


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()} == {0.0}
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, one, F.lit(True))).first()["score"] < 0.5
    assert toxicity.score(docs.limit(0), toxicity.Model(np.zeros(1 << 18, np.float32), 0.0)).count() == 0


def test_gram_buckets_are_the_grams():
    config = toxicity.ToxicityConfig(orders=(3,))
    text = "Abc abc"
    assert len(toxicity.gram_buckets(text, config)) == len(text)
    assert len(toxicity.distinct_buckets(text, config)) == len({f" {text.lower()} "[i : i + 3] for i in range(len(text))})


WORDS_OF = {"en": ["the", "house", "with", "shadow", "thing"], "de": ["das", "haus", "mit", "schatten", "ding"], "fr": ["la", "maison", "avec", "ombre", "chose"]}


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS_OF[lang]) for _ in range(40)), lang) for i in range(150) for lang in [list(WORDS_OF)[i % 3]]]
    docs = spark.createDataFrame(rows + [(900 + i, t, None) for i, t in enumerate([*ODD, "123 456 !!"])], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs, F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert sum(got[i][0] != lang for i, _, lang in rows) <= 2
    assert got[900] == ("und", 0.0) and got[902] == ("und", 0.0) and got[908] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    mixed = [lang for lang, _ in langid.label_words("the house with shadow thing das haus mit schatten ding", model)]
    assert mixed == ["en"] * 5 + ["de"] * 5


def test_languages_without_training(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert langid.predict(docs, model).first()["lang_pred"] == "und"


def test_languages_learn_whole_texts(spark):
    rng = random.Random(3)
    openings = [" " * 4000, "licence terms apply " * 120]
    rows = []
    for i in range(150):
        lang = list(WORDS_OF)[i % 3]
        rows.append((i, ("" if i % 2 else openings[i // 6 % 2]) + " ".join(rng.choice(WORDS_OF[lang]) for _ in range(40)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert sum(got[i] != lang for i, _, lang in rows if i % 2) <= 2


def test_languages_are_all_learned(spark):
    # 70 languages of one word each, then one that fills the sample and one of 3 rows.
    word = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(3)) * 2
    langs = [f"l{n:02d}" for n in range(70)]
    rows = [(i, " ".join([word(40 * (i % 70) + 7)] * 8), langs[i % 70]) for i in range(280)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == langs
    asked = spark.createDataFrame([(n, " ".join([word(40 * n + 7)] * 8)) for n in range(70)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()} == dict(enumerate(langs))
    rare = [(i, "the house with shadow", "en") for i in range(4000)] + [(5000 + i, "das haus mit schatten", "de") for i in range(3)]
    model = langid.fit(spark.createDataFrame(rare, "doc_id long, text string, lang string"), F.lit(True), langid.LangConfig(sample=20, least_rows=10))
    assert model.languages == ["de", "en"]
    assert [lang for lang, _ in langid.label_words("das haus", model)] == ["de", "de"]


def test_texts_in_pieces():
    for text in [t for t in ODD if t] + ["ab" * 50 + " cd " * 40]:
        pieces = langid.text_pieces(text, 16)
        assert "".join(pieces) == text and " ".join(pieces).split() == text.split()


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    n, k = 300, 3
    scores, t = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    fresh = rng.random(n) < 0.05
    fresh[0] = True
    post, counts = langid.marginals(scores, fresh, t, counted=True)
    starts = [*np.flatnonzero(fresh), n]
    expected, joint = [], np.zeros((k, k))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        e = np.exp(scores[a:b])
        alpha, beta = np.zeros((b - a, k)), np.ones((b - a, k))
        alpha[0] = e[0]
        for i in range(1, b - a):
            alpha[i] = (alpha[i - 1] @ np.exp(t)) * e[i]
        for i in range(b - a - 2, -1, -1):
            beta[i] = np.exp(t) @ (e[i + 1] * beta[i + 1])
        p = alpha * beta
        z = p[0].sum()
        expected.append(p / p.sum(1, keepdims=True))
        for i in range(1, b - a):
            joint += alpha[i - 1][:, None] * np.exp(t) * (e[i] * beta[i])[None] / z
    assert np.allclose(post, np.concatenate(expected)) and np.allclose(counts, joint)


def test_text_media(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, *ODD])]
    out = {r["doc_id"]: r for r in media.text_media(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"), F.col("text")).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        same = out[i % len(ODD)]
        assert (r["feature"], r["media_sha256"]) == (same["feature"], same["media_sha256"])


def test_images():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (13, 29), dtype=np.uint8)
    small = media.area_resize(img, 4, 5)
    for i in range(4):
        for j in range(5):
            wy = np.clip(np.minimum(np.arange(13) + 1, (i + 1) * 13 / 4) - np.maximum(np.arange(13), i * 13 / 4), 0, None)
            wx = np.clip(np.minimum(np.arange(29) + 1, (j + 1) * 29 / 5) - np.maximum(np.arange(29), j * 29 / 5), 0, None)
            assert np.isclose(small[i, j], (wy[:, None] * wx * img).sum() / (wy.sum() * wx.sum()))
    rgb = rng.integers(0, 256, (3, 5, 3), dtype=np.uint8)
    ppm = b"P6 # note\n5 3\n255\n" + rgb.tobytes()
    assert (media.decode(ppm) == rgb).all()
    plain = b"P2\n2 2\n255\n0 1\n2 255\n"
    assert media.decode(plain).tolist() == [[0, 1], [2, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    rows = b"".join(rgb[y, :, ::-1].tobytes() + b"\0" for y in (2, 1, 0))
    bmp = struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, 0, 0, 0, 0, 0) + rows
    assert (media.decode(bmp) == rgb).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")
    assert media.dhash(np.tile(np.arange(90, dtype=np.uint8), (8, 1))) == "ff" * 8


def test_media_column(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5\n1 1\n255\n\x07")), (2, bytearray(b"junk")), (3, None)], "tile long, image binary")
    got = {r["_row"]["tile"]: r for r in media.media_features(df, "image").collect()}
    assert got[1]["height"] == 1 and got[1]["tile"][:6] == b"\x93NUMPY"
    assert got[2]["tile"] is None and got[2]["error"] and got[3]["error"]


def tile_value(data):
    import io

    return np.load(io.BytesIO(media.tile_of(media.decode(data)))).flat[0]


def test_samples_of_other_depths_are_scaled():
    assert tile_value(b"P5\n1 1\n15\n\x0f") == 255 and tile_value(b"P2\n1 1\n15\n3\n") == 51
    assert tile_value(b"P5\n1 1\n65535\n" + (1000).to_bytes(2, "big")) == 4
    assert tile_value(b"P5\n1 1\n65535\n\xff\xff") == 255 and tile_value(b"P2 1 1 1000 1000") == 255


def test_broken_images_give_errors(spark):
    broken = [
        b"P5 0 0\n255\n", b"P5 0 5\n255\n", b"P6 99999999999 99999999999\n255\n" + b"x" * 50, b"P4 4000000000 4000000000\n", b"P5 2 2\n0\nabcd", b"P5 2 2\n70000\nabcd",
        b"P2 1 1 15 16", b"P2 1 1 255 99999999999999999999999", b"P2 1 1 255 x", b"P", b"BM", b"BM" + b"\xff" * 60, b"P" + b"9" * 30, b"P5 " + b"9" * 6000,
        struct.pack("<2sIHHI", b"BM", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 0, 0, 1, 24, 0, 0, 0, 0, 0, 0),
        struct.pack("<2sIHHI", b"BM", 54, 0, 0, 20) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 8, 0, 0, 0, 0, 0, 0) + bytes(64),
    ]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(broken)], "error long, image binary")
    got = media.media_features(df, "image").collect()
    assert len(got) == len(broken) and all(r["error"] and r["tile"] is None and r["dhash"] is None for r in got)
    assert media.media_features(df.limit(0), "image").count() == 0


def random_texts(n, seed):
    rng = random.Random(seed)
    chars = "abcdething  \n.ÀÉß1290éñ▁🙂x'\t"
    return [*(t for t in ODD if t is not None), *("".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(n))]


def test_pieces_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(PIECE_MODEL))
    texts = [*random_texts(600, 3), " " * 40, "a" + " " * 23 + "b", "  the", "def f():\n        return 1"]
    for t, ids in zip(texts, codec.encode_many(texts), strict=True):
        want = library.encode(t)
        assert list(ids) == want, t
        assert codec.decode(ids) == library.decode(want)


def test_unigram_viterbi():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, score, kind in (("<unk>", 0, 2), ("▁", -3, 1), ("▁a", -2, 1), ("ab", -2.5, 1), ("a", -4, 1), ("b", -1, 1), ("▁ab", -9, 1), ("bc", -1.5, 1), ("c", -5, 1)):
        p = proto.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = True, False, True
    codec = sentencepiece_codec.Codec(proto.SerializeToString())
    assert [codec.text[i] for i in codec.encode("abc ab")] == ["▁a", "bc", "▁a", "b"]


def test_encode_documents(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    model = sentencepiece_codec.read_model(PIECE_MODEL)
    ids = sentencepiece_codec.encode_documents(df, model)
    got = {r["doc_id"]: r for r in ids.collect()}
    assert got[0]["ids"] is None and got[0]["n_tokens"] is None and got[1]["ids"] == []
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode_documents(ids, model).collect()}
    assert back == dict(rows)
    assert all(r["round_trip"] for r in sentencepiece_codec.encode_documents(df, model, digest=True).collect() if r["doc_id"])
    assert sentencepiece_codec.encode_documents(df.limit(0), model).count() == 0


def test_round_trip_is_of_whole_texts(spark):
    texts = ["a▁b", "▁▁▂▃ chart", "▁", " ", "a  b", "é 🙂 x", *(t for t in ODD if t is not None)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = sentencepiece_codec.read_model(PIECE_MODEL)
    got = {r["doc_id"]: r["round_trip"] for r in sentencepiece_codec.encode_documents(df, model, digest=True).collect()}
    assert got == {i: "▁" not in t for i, t in enumerate(texts)}
    codec = sentencepiece_codec.Codec(model)
    broken = [codec.bytes[b] for b in (0xF0, 0x9F)]
    assert codec.decode([*broken, *codec.encode("é"), *broken[:1]]) == "\ufffd é\ufffd"
    silent = min(codec.control)
    assert codec.decode([codec.bytes[0xC3], silent, codec.bytes[0xA9]]) == "\ufffd\ufffd"


def test_edits_equal_full_counts():
    tokenizer = token_counts.Tokenizer(token_counts.read_ranks(BYTE_RANKS))
    rng = random.Random(4)
    for text in random_texts(150, 9) + ["x y " * 800]:
        tree = token_counts.Segments(text, tokenizer)
        for _ in range(4):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 1, 5])
            new = rng.choice(["", " ", "'s", "ab", " 12\n", "z" * 200])
            tree.replace(a, b, new)
            a, b = min(a, len(text)), min(b, len(text))
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == len(tokenizer.encoding.encode_ordinary(text))


def test_edit_touches_little(spark):
    tokenizer = token_counts.Tokenizer(token_counts.read_ranks(BYTE_RANKS))
    tree = token_counts.Segments("one two three " * 5000, tokenizer)
    tree.replace(30_000, 30_003, "and")
    assert tree.recut < 12
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    edit = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("stop"), F.lit("new").alias("text")))
    got = {r["doc_id"]: r for r in token_counts.count_documents(df, token_counts.read_ranks(BYTE_RANKS), edit).collect()}
    for i, t in enumerate(ODD):
        assert got[i]["n_tokens"] == len(tokenizer.encoding.encode_ordinary(t or ""))
        assert got[i]["edited_tokens"] == len(tokenizer.encoding.encode_ordinary("new" + (t or "")[2:]))


def made_model(kind, pieces):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, score, of in (("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((p, s, 1) for p, s in pieces)):
        p = proto.pieces.add()
        p.piece, p.score, p.type = piece, score, of
    proto.trainer_spec.model_type, proto.trainer_spec.unk_id, proto.trainer_spec.bos_id, proto.trainer_spec.eos_id = kind, 0, 1, 2
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = True, False, True
    return proto.SerializeToString()


@pytest.mark.parametrize("kind", [1, 2])
def test_made_models_equal_the_library(kind):
    import sentencepiece

    rng = random.Random(kind)
    pieces = {c: -20.0 - i for i, c in enumerate("▁abcdé")} | {"".join(p): -rng.uniform(1, 15) for n in (2, 3, 4) for p in [rng.choices("abcdé", k=n) for _ in range(14)]}
    pieces |= {"▁" + p: -rng.uniform(1, 15) for p in ("a", "ab", "cd", "é")}
    if kind == 2:  # merging reaches a piece through shorter ones only, in the order of scores
        pieces = {p: -float(n) for n, p in enumerate(sorted(pieces, key=len))}
    model = made_model(kind, pieces.items())
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    texts = ["".join(rng.choice("aabbccddé  xy🙂") for _ in range(rng.randint(0, 30))).strip() for _ in range(400)] + ["a" * 3000, "xyz", "x a"]
    texts = [" ".join(t.split()) for t in texts]
    for t, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert ids.tolist() == library.encode(t), t


def test_kept_words_stay_in_bounds(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "WORD_BYTES", 20_000)
    monkeypatch.setattr(sentencepiece_codec, "CACHE", 50)
    codec, whole = (sentencepiece_codec.Codec(sentencepiece_codec.read_model(PIECE_MODEL)) for _ in range(2))
    texts = random_texts(200, 5) + ["y" * 100_000]
    want = [i.tolist() for i in whole.encode_many(texts)]
    for _ in range(2):
        assert [codec.encode(t) for t in texts] == want
    kept = [w for held in (codec.words, codec.aged) for w in held]
    assert len(kept) * sentencepiece_codec.ENTRY <= 21_000 and max(map(len, kept)) <= sentencepiece_codec.LONGEST
