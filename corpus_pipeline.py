"""From documents to packed training sequences: five stages, each over all that the one before kept.

quality (7) -> exact dedup (6) -> n-gram Jaccard join (3) -> mixing to target weights (2) -> packing (1)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm import exact_dedup, mixing, ngram_join, packing, quality
from gaugemill.llm.common import settle_table, table, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below 0.3. Null and empty texts are scored as empty, copies alike; every text is scored
    whole. All columns are kept, whatever their names. Without labelled documents nothing is dropped."""
    model, name = quality.train(docs, table(spark, sf_dir, "labels")), unused(docs, "score")
    return quality.score(docs, model, score_col=name).where(F.col(name) >= 0.3).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, of rows that repeat it one; null and empty texts are equal. All columns are kept."""
    return exact_dedup.exact_dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.75 or more the smallest doc_id stays. Texts without words and null ids stay. All columns are kept."""
    return ngram_join.near_dedup_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents until each source has its share; null is a source, texts without words are left out. All columns are kept."""
    return mixing.mix_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens with their ids; a document that the mix repeats has pieces for each copy. Null and empty texts are
    their end id alone. Of the columns only doc_id and text are read."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A trained classifier and retrieval packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return settle_table(STAGES[-1][1](spark, docs, sf_dir), "stage-packing")
