"""The corpus pipeline: documents without toxicity, copies and near copies, mixed to target weights and encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents. Stored files don't keep the order that mixing gives, so the last stage returns each row's place in it. Rows with a null doc_id go through like others, except that near copies with a null id are known by equal
shingles only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import exact_dedup as exact
from stowage.llm import mixing, ngram_join, piece_sampling, toxicity
from stowage.llm.common import scratch_of, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of rows that aren't held out, scores under the threshold."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that stays; of rows repeated whole, one."""
    return exact.drop_copies(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return ngram_join.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that gives each source its tempered share at every point."""
    return mixing.mixed_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text, as piece ids, with the document's slot and place in the mixing schedule.

    The schedule depends on the set of rows alone, which mixing keeps, so it is the one that mixing_stage orders by.
    """
    placed = mixing.mix(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), keep=("text",))
    return piece_sampling.sample_segmentations(placed, keep=("slot", "place"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]
#: SQL can express neither the learned model nor the sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again before the next; a stage's own tables go once its rows are stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_of(spark, f"pipeline-{name}"):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
