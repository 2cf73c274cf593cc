"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ``shelfwise.llm`` on all that the stage before
kept. Stages 1 to 4 return the columns of ``documents``, whatever other columns
these have. Rows with a null or empty text, or one without a letter, go in the
first stage. Of rows that repeat each other near-dedup leaves one; rows with a
null doc_id come last there, and are judged by their texts elsewhere. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import decontam, langid, packing, repetition, simhash
from shelfwise.llm.common import documents, written
from shelfwise.llm.queries import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a letter and a language with a probability of 0.3 or more."""
    return langid.keep(docs, langid.train(docs, modulus=5), min_score=0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the repetition rules keep."""
    return repetition.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each group of near-duplicates (3-word shingles, 2 bits)."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of 1024 tokens at most."""
    return packing.pack_documents(docs, TOKENIZER, capacity=1024, end_id=2)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", pack)]

# The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
