"""From raw documents to packed training sequences, in five stages that each work on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import mixing, packing, secrets, simhash, toxicity
from tidewire.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MAX_REPEATS = 2.0

# The stages fit a model, hash and tokenize: beyond SQL. The tests compare them with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees call toxic go; they learn from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels)).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each class that links of fingerprints of four-word shingles connect, at four bits or fewer."""
    return simhash.keep_one(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked, and the length of the text counted anew; every document stays."""
    masked = secrets.redact(docs, repository=F.concat_ws("/", "source", "lang"))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most twice, until the mix is as even as that allows; every document stays."""
    return mixing.mix_sources(docs, max_repeats=MAX_REPEATS).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy of a document is tokenized and gets its places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", keep_one_of_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
