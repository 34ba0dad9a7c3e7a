"""A corpus pipeline of five stages over ``documents``: each reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.llm.minhash import near_duplicates
from lapidary.llm.mixing import mix_sources, shuffled
from lapidary.llm.packing import pack_documents
from lapidary.llm.pseudonyms import pseudonymise, session_key
from lapidary.llm.scratch import Scratch
from lapidary.llm.toxicity import score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance doesn't find toxic."""
    scored = score_documents(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8): that of the smallest id.

    Rows that repeat an id have one group; of those with the same text one is kept. Null ids stay.
    """
    gone = near_duplicates(docs, k=5, threshold=80).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(COLUMNS).hint("merge").join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    if _repeats(docs):
        rows = rows.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(rows.where("doc_id is null"))
    return rows


def _repeats(docs: DataFrame) -> bool:
    """Whether any id has several rows."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values under format-preserving pseudonyms."""
    out = pseudonymise(docs.select(COLUMNS), session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a file a shard, shuffled in each; the one in which a source's last pass ends goes in whole if half of it fits."""
    mixed = mix_sources(docs.select(COLUMNS))
    whole = F.col("passes") + F.when((F.col("last") > 0) & (2 * F.col("last") >= F.col("size")), 1).otherwise(0)
    return shuffled(mixed, whole.cast("int"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: SQL has neither compressor nor tokenizer: tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
