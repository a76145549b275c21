"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, katz_lm, license_scan, mixing, ngram_join, quality_rules, sentencepiece_codec, suffix_dedup, token_store
from .common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(documents(spark, sf_dir))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, manifest = token_store.write_store(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_store(spark, folder, manifest)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.summary(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(documents(spark, sf_dir)))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.render(chat_format.canonical(table.unionByName(more))))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.label(documents(spark, sf_dir), ngram_join.Rule(words=3, percent=90))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(documents(spark, sf_dir))


def op10_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.score(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_token_store, op4_sentencepiece, op5_mixing, op6_license_scan, op7_chat_format, op8_ngram_join, op9_quality_rules, op10_katz_lm)}

SQL = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS k, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, h AS text_sha256 FROM r
""",
    "op7_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 15 AS size FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w
), c AS (
  SELECT doc_id, count(*) AS k FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * i >= 90 * (cx.k + cy.k - i)
), n AS (
  SELECT x, y FROM e UNION SELECT y, x FROM e
), r AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT n.y, r.root FROM r JOIN n ON n.x = r.doc_id
)
SELECT d.doc_id, coalesce(any_value(c.k), 0) AS n_shingles, min(r.root) AS component_id FROM documents d JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY 1
""",
}
