"""A corpus pipeline: each stage works on all that the one before it kept.

``run`` applies STAGES to ``documents``; every stage is written as Parquet to the folder that the
executors share and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from repalign.llm import contamination, jaccard, pieces, pii, toxicity
from repalign.llm.queries import PIECES, table
from repalign.llm.storage import kept


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, predicts to be toxic go."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))  # whatever the columns are named
    return toxicity.toxicity(rows, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id stays."""
    return jaccard.distinct(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a tenth of it edited, go."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of a sampled segmentation, reproducible by doc_id."""
    rows = pieces.encoded(docs, PIECES)
    return rows.withColumn("n_pieces", F.size("pieces").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard", remove_near_duplicates),
    ("benchmark_decontamination", remove_contaminated),
    ("personal_data", redact_personal_data),
    ("sentence_pieces", encode_pieces),
]

# SQL can't express the learnt, graph and sampling stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
