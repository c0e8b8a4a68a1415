"""Trials, repetitions and sessions: from presentations to one response per item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import col
from .order import position_by_value

# Fixed value: presentations per session.
TRIALS_PER_SESSION = 750


def session_of(trial: str | Column, first: int = 1, size: int = TRIALS_PER_SESSION) -> Column:
    """Session number of a zero-based trial (P1); ``first`` = 0 gives the zero-based variant."""
    return (F.floor(col(trial) / size) + first).cast("int")


def offset_of(trial: str | Column, size: int = TRIALS_PER_SESSION) -> Column:
    return F.pmod(col(trial), F.lit(size)).cast("int")


def trial_index(df: DataFrame, keys: Sequence[str], by: str, tie: Sequence[str] = (), out: str = "trial_idx") -> DataFrame:
    """Zero-based trial number in time order."""
    return position_by_value(df, keys, by, tie, out, "__n").drop("__n")


def shared_trials(trials: DataFrame, slots: DataFrame, shared: DataFrame) -> DataFrame:
    """Presentations of the shared items (J7): (subject, item_id, trial_idx), null trial if never shown.

    ``trials(subject, trial_idx, slot)``, ``slots(subject, slot, item_id)``, ``shared(item_id)``.
    """
    wanted = slots.join(shared.select("item_id").distinct(), "item_id", "left_semi")
    return wanted.join(trials, ["subject", "slot"], "left").select("subject", "item_id", "slot", "trial_idx")


def repetition_index(df: DataFrame, keys: Sequence[str], trial: str, out: str = "rep") -> DataFrame:
    """How many times the item was shown before."""
    return position_by_value(df, keys, trial, (), out, "__n").drop("__n")


def repetition_average(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean over the repetitions there are (A2)."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_reps"))


def available_sessions(files: DataFrame, hemi: str = "both") -> DataFrame:
    """(subject, session) for which the wanted side or both sides exist."""
    if hemi in ("lh", "rh"):
        return files.where(F.col("hemi") == hemi).select("subject", "session").distinct()
    if hemi != "both":
        raise ValueError(f"unknown hemisphere: {hemi}")
    sides = F.count_distinct("hemi")
    return files.groupBy("subject", "session").agg(sides.alias("s")).where("s = 2").select("subject", "session")


def hemisphere_used(files: DataFrame) -> DataFrame:
    """(subject, hemi_used): both, or the only side with any session if no session has both."""
    per_session = files.groupBy("subject", "session").agg(
        F.max((F.col("hemi") == "lh").cast("int")).alias("l"), F.max((F.col("hemi") == "rh").cast("int")).alias("r"))
    s = per_session.groupBy("subject").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.max(F.col("l") * F.col("r")).alias("b"))
    return s.select("subject", F.when(F.col("b") == 1, "both").when((F.col("l") == 1) & (F.col("r") == 0), "lh")
                    .when((F.col("r") == 1) & (F.col("l") == 0), "rh").alias("hemi_used"))


def session_responses(rows: DataFrame, files: DataFrame, side: str = "both", max_sessions: int | None = None,
                      fallback: bool = True) -> DataFrame:
    """Responses of the usable sessions, with ``hemi_used`` (S5, S7): both sides, or the only one a subject has.

    ``files(subject, session, hemi)`` tells what there is. With both sides wanted a session counts only where it has
    both, unless the subject has sessions of one side alone; without ``fallback`` such a subject is left out.
    """
    used = hemisphere_used(files) if side == "both" else files.select("subject", F.lit(side).alias("hemi_used")).distinct()
    if not fallback:
        used = used.where(F.col("hemi_used") == side)
    fits = (F.col("hemi_used") == "both") | (F.col("hemi_used") == F.col("hemi"))
    usable = (files.join(used, "subject").where(fits).groupBy("subject", "session", "hemi_used").agg(F.count_distinct("hemi").alias("s"))
              .where(F.col("s") == F.when(F.col("hemi_used") == "both", 2).otherwise(1)).drop("s"))
    if max_sessions is not None:
        usable = first_sessions(usable, max_sessions)
    return rows.join(usable, ["subject", "session"]).where(fits)


def joined_sides(rows: DataFrame, left_sizes: DataFrame) -> DataFrame:
    """``target_pos``: left targets first, right ones after them where both sides are used.

    ``left_sizes(subject, n_left)`` gives the number of left targets.
    """
    shift = F.when((F.col("hemi") == "rh") & (F.col("hemi_used") == "both"), F.col("n_left")).otherwise(0)
    return rows.join(left_sizes, "subject", "left").withColumn("target_pos", (F.col("target_id") + shift).cast("int")).drop("n_left")


def first_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The first n sessions of each subject (T3); a subject has a few dozen at most."""
    w = Window.partitionBy("subject").orderBy("session")
    return sessions.withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") <= n).drop("__r")


def last_trial(df: DataFrame, keys: Sequence[str], value: str, trial: str) -> DataFrame:
    """Response of the last presentation only."""
    return df.groupBy(*keys).agg(F.max_by(value, trial).alias(value))


def requested_items(responses: DataFrame, wanted: DataFrame, subject: str, item: str, strict: bool = False) -> DataFrame:
    """Responses to the wanted items; strict keeps a subject only if none is missing."""
    found = responses.join(wanted.select(item).distinct(), item, "left_semi")
    if not strict:
        return found
    need = wanted.select(item).distinct().agg(F.count(F.lit(1)).alias("need"))
    have = found.groupBy(subject).agg(F.count_distinct(item).alias("have"))
    full = have.where(F.col("have") == need.scalar()).select(subject)
    return found.join(full, subject, "left_semi")


def complete_subjects(responses: DataFrame, wanted: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Subjects with every wanted item in every condition (F8)."""
    found = (responses.where(F.col("condition").isin(*conditions)).join(wanted.select("item_id").distinct(), "item_id", "left_semi")
             .groupBy("subject", "condition").agg(F.count_distinct("item_id").alias("have")))
    need = wanted.select("item_id").distinct().agg(F.count(F.lit(1)))
    return (found.where(F.col("have") == need.scalar()).groupBy("subject").agg(F.count(F.lit(1)).alias("c"))
            .where(F.col("c") == len(conditions)).select("subject"))


def alignment_report(left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    """How many ids are common or on one side only."""
    a = left.select(item).distinct().withColumn("__l", F.lit(1))
    b = right.select(item).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, item, "full")
    return both.agg(F.count(F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), 1)).alias("common"),
                    F.count(F.when(F.col("__r").isNull(), 1)).alias("left_only"),
                    F.count(F.when(F.col("__l").isNull(), 1)).alias("right_only"))


def assert_aligned(left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    """``left`` unchanged, or an error when the id sets differ."""
    off = alignment_report(left, right, item).select((F.col("left_only") + F.col("right_only")).alias("off"))
    ok = F.when(off.scalar() == 0, True).otherwise(F.raise_error(F.lit("id sets differ")))
    return left.where(ok)


def truncate_to_common(left: DataFrame, right: DataFrame, by: str, left_cols: Sequence[str], right_cols: Sequence[str]) -> DataFrame:
    """Rows of both sides matched by position, up to the shorter side."""
    a = position_by_value(left.select(by, *left_cols), [], by, (), "pos", "__n").select("pos", *left_cols)
    b = position_by_value(right.select(by, *right_cols), [], by, (), "pos", "__n").select("pos", *right_cols)
    return a.join(b, "pos")
