"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.llm import (
    bpe,
    chat,
    codes,
    jaccard,
    merkle,
    mixing,
    neighbours,
    oracles,
    sharding,
    sketches,
    staging,
    token_files,
    topk,
    toxicity,
    urls,
)
from linkscope.llm.words import word_count
from linkscope.session import configure, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches that stay small with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return configure(spark)


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL for the same rows where SQL has one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return bpe.digests(encoded)


CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), loss AS (
    SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM turns WHERE role = 'assistant' GROUP BY conv_id
), whole AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 1
               + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11)::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id
)
SELECT w.conv_id, n_turns, turns_sha256, coalesce(length(l.text), 0)::BIGINT AS loss_chars,
       sha256(coalesce(l.text, '')) AS loss_sha256, formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM whole w LEFT JOIN loss l USING (conv_id)
"""


@query(CHAT_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    segments = chat.format_turns(turns.union(extra), chat.text_part(F.col("text")))
    return chat.summarize(segments)


@query()
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = staging.staged(topk.quantized(table(spark, sf_dir, "embeddings"), 1024), "topk-vectors")
    return topk.top_k(vectors, vectors.where("id % 100 = 0"))


@query()
def op5_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = staging.staged(neighbours.usable_vectors(table(spark, sf_dir, "embeddings")), "lsh-vectors")
    return neighbours.nearest(vectors, vectors.where("id % 100 = 0"))


@query()
def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


URL_SQL = r"""
WITH parts AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
    SELECT page_id, rule_host || rule_path AS rule, verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fitting f ON f.page_id = p.page_id AND f.place = 1
"""


@query(URL_SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow = [("org", "/"), ("com", "/fr/")]
    block = [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")]
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), allow, block)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer("byte_bpe_50k.json"))
    return token_files.read(spark, folder).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query()
def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard(docs, F.octet_length(text) + 8, 24)
    return placed.select(
        "doc_id",
        F.col("shard_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(oracles.codebook_sql())
def op11_equal_average_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query()
def op12_similarity_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query(oracles.manifest_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
