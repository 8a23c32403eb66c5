"""From documents to token digests: toxicity, near duplicates, source mix, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a frame,
which is written as Parquet and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkscope.llm import bpe, jaccard, mixing, toxicity
from linkscope.llm.queries import prepare, table, tokenizer
from linkscope.llm.staging import may_be_in, membership_filter, staged
from linkscope.llm.words import word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; the model is fitted to the labels of these rows."""
    model = toxicity.train(docs, table(prepare(spark), sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxic_score < 0.5").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: the one with the smallest doc_id.

    Rows that repeat a doc_id are told apart by a hash of their text, and one of them stays. A null
    doc_id names nothing, so rows without one all stay.
    """
    prepare(spark)
    found = jaccard.near_duplicates(docs, width=5, percent=80).where("doc_id IS NOT NULL")
    ids = staged(
        found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.expr("doc_id = component_id")).alias("head")),
        "pipeline-ids",
    )
    # All rows but those that may be no head or repeat a doc_id stay without a shuffle of their texts.
    doubtful = membership_filter(ids.where("rows > 1 OR NOT head"), F.xxhash64("doc_id"))
    doubt = F.col("doc_id").isNotNull() & may_be_in(doubtful, F.xxhash64(F.col("doc_id").cast("long")))
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    heads = ids.where("head").select("doc_id")
    kept = docs.where(doubt).join(heads, "doc_id").withColumn("place", F.row_number().over(first)).where("place = 1")
    return kept.select(docs.columns).union(docs.where(~doubt).select(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut stays whole."""
    prepare(spark)
    return mixing.sample(docs, word_count(F.col("text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    prepare(spark)
    return bpe.digests(bpe.encode(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

# Training and tokenization have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to the stored result of the one before."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
