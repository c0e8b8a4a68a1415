"""Grouped scores of text answers and the drops between conditions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.scalars import fluency


def vqa_accuracy(df: DataFrame, keys: Sequence[str], pred: str, gt: str) -> DataFrame:
    scored = (df.withColumn("__p", T.normalise_answer(pred)).withColumn("__g", T.normalise_answer(gt))
              .withColumn("__s", T.vqa_score("__p", "__g")))
    return scored.groupBy(*keys).agg(
        (F.coalesce(F.sum("__s"), F.lit(0.0)) / F.greatest(F.count("__s"), F.lit(1))).alias("score"))


def binding_accuracy(df: DataFrame, keys: Sequence[str], pred: str, gt: str) -> DataFrame:
    return (T.with_binding_counts(df, pred, gt).groupBy(*keys)
            .agg((F.sum("hits") / F.greatest(F.sum("total"), F.lit(1))).alias("score")))


def composite(length: Column, vocab: Column, repetition: Column, sentences: Column) -> Column:
    """Weighted mix of the group means of the quality parts."""
    w = T.WEIGHTS
    return (F.least(length / T.FULL_LENGTH, F.lit(1.0)) * w["length"] + vocab * w["vocab"]
            + (1 - repetition) * w["repetition"] + F.least(sentences / T.FULL_SENTENCES, F.lit(1.0)) * w["sentences"])


def language_quality(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    g = T.with_quality_parts(df, text).groupBy(*keys).agg(
        F.avg("n_words").alias("length"), F.avg("ttr").alias("vocab_richness"),
        F.avg("repetition").alias("repetition_rate"), F.avg("n_sentences").alias("sentence_count"))
    return g.withColumn("composite", composite(F.col("length"), F.col("vocab_richness"), F.col("repetition_rate"),
                                               F.col("sentence_count")))


def exact_match(df: DataFrame, keys: Sequence[str], pred: str, gt: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(T.substring_hit(pred, gt)).alias("score"))


def option_accuracy(df: DataFrame, keys: Sequence[str], pred: str, options: str, correct: str, gt: str | None = None) -> DataFrame:
    """Share of answers whose first contained option is the right one; rows without options use X26."""
    hit = F.when(T.chosen_option(pred, options) == F.col(correct), 1.0).otherwise(0.0)
    if gt:
        hit = F.when(F.col(options).isNull(), T.substring_hit(pred, gt)).otherwise(hit)
    return df.groupBy(*keys).agg(F.avg(hit).alias("score"))


def caption_fluency(df: DataFrame, keys: Sequence[str], perplexity: str, cap: float = 1000.0) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(fluency(perplexity, cap)).alias("score"))


def quality_score(df: DataFrame, keys: Sequence[str], pred: str, gt: str) -> DataFrame:
    """Composite quality as a task score; the reference text plays no part."""
    return language_quality(df, keys, pred).select(*keys, F.col("composite").alias("score"))


# Task name -> scorer(df, keys, prediction, reference).
SCORERS: dict[str, Callable] = {
    "visual_recognition": vqa_accuracy, "cross_modal_binding": binding_accuracy, "language_generation": quality_score,
}


def performance_drop(answers: DataFrame, keys: Sequence[str], task: str, baseline: str = "baseline",
                     patched: str = "patched", gt: str = "ground_truth",
                     scorers: dict[str, Callable] | None = None) -> DataFrame:
    """(keys, task, baseline_score, patched_score, drop, n) with the scorer of each task.

    An empty reference is filled from the baseline answer.
    """
    keys = list(keys)
    answers = answers.withColumn(gt, F.when(F.coalesce(F.col(gt), F.lit("")) == "", F.col(baseline)).otherwise(F.col(gt)))
    out = None
    for name, scorer in (scorers or SCORERS).items():
        rows = answers.where(F.col(task) == name)
        base = scorer(rows, [*keys, task], baseline, gt).withColumnRenamed("score", "baseline_score")
        after = scorer(rows, [*keys, task], patched, gt).withColumnRenamed("score", "patched_score")
        part = base.join(after, [*keys, task])
        out = part if out is None else out.unionByName(part)
    size = answers.groupBy(*keys, task).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("drop", F.col("baseline_score") - F.col("patched_score")).join(size, [*keys, task])
