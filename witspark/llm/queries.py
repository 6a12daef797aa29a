"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from witspark.llm import (
    bpe, chat, descent, feast, fertility, jaccard, leaks, mergepath, pages, pitman, toxic, wordbpe, zquality,
)
from witspark.llm.common import remainder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


OP8_SQL = """
WITH rows_ AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS follows,
    regexp_replace(regexp_replace(replace(text, '&', '&amp;'), '<(/?s>|s/>)', '&lt;\\1', 'g'),
                   '\\[(/?INST\\])', '&#91;\\1', 'g') AS escaped
  FROM rows_
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + CASE WHEN follows THEN 4 ELSE 10 + length(role) + 9 + 4 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op8_chat_formatting", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation and reads it back; digests of what was read."""

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT -7L AS conv_id, turn, role, text FROM VALUES"
        f" (0L, 'user', '{said}'), (1L, 'assistant', '{said}') AS t(turn, role, text)"
    )
    back = chat.read_back(chat.format_chats(turns.unionByName(extra)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; digests of the ids and of the decoded bytes."""

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path, public_tokenizers.PATTERN).select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("body", 256).alias("decoded_sha256"),
    )


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it exceeds 2048 tokens."""

    path = public_tokenizers.path("word_bpe_49k.json")
    counted = wordbpe.count_tokens(table(spark, sf_dir, "documents"), path)
    return counted.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit")
    )


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learnt from the labels whose crc32 remainder by 3 is not 1."""

    docs = table(spark, sf_dir, "documents")
    model = zquality.fit(docs, table(spark, sf_dir, "labels"), remainder("id", 3) != 1)
    return zquality.score(docs, model).select(
        F.col("id").alias("doc_id"),
        (remainder("id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "difference",
    )


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every text, and the verdict of the fertility bands."""

    path = public_tokenizers.path("piece_bpe_32k.model")
    return fertility.judge(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from the labels whose crc32 remainder by 5 is not 0."""

    docs = table(spark, sf_dir, "documents")
    model = toxic.fit(docs, table(spark, sf_dir, "labels"), remainder("id", 5) != 0)
    return toxic.score(docs, model).select(
        F.col("id").alias("doc_id"),
        (remainder("id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("bigint").alias("n_passages"),
    )


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""

    web = table(spark, sf_dir, "pages")
    return pages.extract(web, pages.fit(web)).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with their edit distance."""

    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", F.col("end").alias("end_at")
    )


@query("op5_ngram_jaccard")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 5-word shingles at Jaccard 0.8: set size and component of every document."""

    return jaccard.link(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text, learnt from ids whose crc32 remainder by 7 is not 2."""

    return pitman.score(table(spark, sf_dir, "documents"), remainder("id", 7) != 2).select(
        F.col("id").alias("doc_id"),
        (remainder("id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN degree ON degree.a = v.vec_id
"""


@query("op11_embedding_near_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of vectors of one label at cosine 0.93: links and component of every vector."""

    return descent.near_duplicates(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept"
    )


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four largest components of the distinct vectors, whitened."""

    vectors = table(spark, sf_dir, "embeddings")
    return feast.whiten(vectors, feast.fit(vectors)).withColumnRenamed("id", "vec_id")


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies aligned by their ends in every text."""

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return mergepath.align(table(spark, sf_dir, "documents"), *paths).withColumnRenamed("id", "doc_id")
