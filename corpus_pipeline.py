"""The corpus pipeline: toxic documents go, near copies go, benchmark leaks go, personal data are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again for the next. Models and benchmark windows come from the tables in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelgrid.llm import decontam, minhash, packing, pii, toxicity
from labelgrid.llm.shared import saved, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the limit. Learned from the documents table, whatever rows ``docs`` still holds; null and empty texts stay."""
    small_batches(spark)
    network = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean_rows(docs, network)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one of smallest doc_id."""
    small_batches(spark)
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    small_batches(spark)
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked and n_chars in line. Null texts stay null and empty ones empty; repeated rows and rows without doc_id stay."""
    small_batches(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length. A null or empty text is its end id alone; repeated rows and rows without doc_id are packed row by row."""
    small_batches(spark)
    return packing.digest(packing.pack(docs, packing.word_vocabulary()))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("pii", mask_personal_data), ("packing", pack)]

#: A trained network, exact components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
