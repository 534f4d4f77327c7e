"""The corpus pipeline: documents in, packed training sequences out, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents, materialize
from eventloom.llm.decontaminate import drop_contaminated
from eventloom.llm.packing import pack
from eventloom.llm.quality import quality_scores
from eventloom.llm.queries import token_encoder
from eventloom.llm.secrets import secret_scan
from eventloom.llm.simhash import keep_one
from eventloom.session import configure


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    scored = quality_scores(docs, documents(spark, sf_dir, "labels"))
    return scored.where("keep").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of fingerprints that differ in few bits."""
    return keep_one(docs, shingle=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages in one of twenty words or more."""
    return drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced and n_chars to match."""
    found = secret_scan(docs)
    changed = F.col("spans") != ""
    n_chars = F.when(changed, F.length("masked").cast("long")).otherwise(F.col("n_chars"))
    text = F.when(changed, F.col("masked")).otherwise(F.col("text"))
    return found.withColumns({"n_chars": n_chars, "text": text}).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 4096 token ids."""
    return pack(docs, token_encoder())


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Trained models, fingerprints and token ids are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stage's rows written and reread."""
    docs = documents(configure(spark), sf_dir)
    for place, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = materialize(docs, name)
    return docs
