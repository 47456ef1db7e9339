"""Registered queries over the whole tables, each through its operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lodestone.llm import langid, media, minhash, mixing, sentencepiece_codec, substring_dedup, token_counts, topk, toxicity, url_filter
from lodestone.llm.common import held_out, table

#: Where the public vocabulary files are; each is a parameter of its query.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The rules of the url query.
RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    config = toxicity.ToxicityConfig()
    out_of_training = held_out(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out_of_training, config)
    scored = toxicity.score(docs, model, config)
    return scored.select("doc_id", out_of_training.alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.filter_urls(pages, RULES)
    return out.select("_row.page_id", "host", "path", "rule", "verdict")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), r AS (
  SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)
), c AS (
  SELECT DISTINCT doc_id, i + k AS i FROM r, range(0, 35) AS t(k)
), k AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(
    CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.read_model(model_path), digest=True)


def op7_token_counts(spark: SparkSession, sf_dir: str, ranks_path: str = BYTE_RANKS) -> DataFrame:
    """Counts before and after four edits: a cut at a quarter, an insertion at the middle, an overwritten word end, an appended line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length("text")
    edit = lambda start, stop, text: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(text).alias("text"))
    quarter, middle, late = F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4)
    edits = F.array(
        edit(quarter, quarter + 12, ""), edit(middle, middle, " (see note 42)"), edit(late, late + 3, "'s"), edit(n + 100, n + 100, "\n\nAppended line.")
    )
    return token_counts.count_documents(docs, token_counts.read_ranks(ranks_path), edits)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, minhash.MinHashConfig(words=4)).select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r AS (
  SELECT DISTINCT x, x AS y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of_training = held_out(F.col("doc_id"))
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~out_of_training)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", out_of_training.alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_media": op2_media,
        "op3_url_filter": op3_url_filter,
        "op4_topk": op4_topk,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_token_counts": op7_token_counts,
        "op8_minhash": op8_minhash,
        "op9_langid": op9_langid,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk": OP4_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op8_minhash": OP8_SQL,
    }
