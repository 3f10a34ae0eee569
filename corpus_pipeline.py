"""Corpus pipeline: STAGES are applied to documents one after another, each result written as Parquet and read again.

Low-quality documents go, one of each group of near copies stays, documents that hold benchmark passages go, secrets are
masked, and what remains is encoded and decoded. The first four stages return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, quality, secrets, sentencepiece_codec, simhash
from spanloom.llm.common import materialize, without
from spanloom.llm.queries import model_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; rows without an id stay."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.where("predicted = 0"), "doc_id")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies, and all documents outside of groups."""
    return without(docs, simhash.near_copies(docs).where("doc_id != keep"), "doc_id")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"), "doc_id")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and n_chars counted anew where something was."""
    masked = secrets.mask_secrets(secrets.find_secrets(docs, carry=True))
    changed = F.size("found") > 0
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return masked.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes, spans_sha256 of every document."""
    return sentencepiece_codec.round_trip(docs, model_path())


STAGES = [("quality", quality_stage), ("near copies", near_copy_stage), ("decontamination", decontamination_stage), ("secrets", secret_stage), ("encoding", encoding_stage)]

#: A classifier and a tokenizer have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
