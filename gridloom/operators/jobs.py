"""The translation queue as a relation: states, transitions, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import strip
from gridloom.functions.times import backoff_seconds, retryable

ACTIVE = ("Pending", "InProgress", "RetryScheduled")
MAX_RETRIES = 3

#: States of a session and where each may go.
EDGES = {
    "Idle": ("Preflight", "Recovering"),
    "Preflight": ("Starting", "Idle", "Stopping", "Faulted"),
    "Starting": ("Running", "Stopping", "Faulted"),
    "Running": ("Stopping", "Faulted"),
    "Stopping": ("Completed", "Faulted"),
    "Completed": ("Idle",),
    "Faulted": ("Idle",),
    "Recovering": ("Idle",),
}


def enqueue_candidates(segments: DataFrame, jobs: DataFrame, source: str, target: str) -> DataFrame:
    """Confirmed, non-blank, untranslated segments of the source language without an active job.

    No candidate where source and target are the same language (case ignored).
    """
    if source.lower() == target.lower():
        return segments.limit(0)
    wanted = segments.where(
        F.col("status").isin("Final", "TranslationFailed") & (F.lower("language") == source.lower()) & (strip(F.col("text")) != "") & (strip(F.coalesce("translation", F.lit(""))) == "")
    )
    return wanted.join(active(jobs).select(F.col("segment").alias("id")), "id", "left_anti")


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("state").isin(*ACTIVE))


def admit(jobs: DataFrame, offered: DataFrame, order: str) -> DataFrame:
    """The offered jobs that keep one active job per segment: none if one is active, else the first offered."""
    fresh = offered.join(active(jobs).select("segment"), "segment", "left_anti")
    place = F.row_number().over(Window.partitionBy("segment").orderBy(order, "job"))
    return fresh.withColumn("place", place).where(F.col("place") == 1).drop("place")


def due(jobs: DataFrame, now: int) -> DataFrame:
    """Jobs to pick up: pending, or scheduled for a time that has come (milliseconds)."""
    waiting = F.col("state").isin("Pending", "RetryScheduled")
    return jobs.where(waiting & (F.coalesce("next_at", F.lit(0)) <= now))


def transitions(jobs: DataFrame, now: int, max_retries: int = MAX_RETRIES) -> DataFrame:
    """jobs after their events, with the effect on the segment.

    event is one of picked, success, failure (with error), cancelled, disabled,
    restart, missing, translated, or null for none. Failures that can pass are
    scheduled again while attempts stay within max_retries; others are final.
    """
    event, state = F.col("event"), F.col("state")
    is_active, working = state.isin(*ACTIVE), state == "InProgress"
    again = retryable(F.col("error")) & (F.col("attempts") + 1 <= max_retries)
    failed = working & (event == "failure")
    new = (
        F.when(~is_active, state).when(event == "missing", "FailedPermanent").when(event == "translated", "Succeeded").when(event == "disabled", "Cancelled")
        .when((event == "picked") & state.isin("Pending", "RetryScheduled"), "InProgress").when(working & (event == "success"), "Succeeded")
        .when(working & event.isin("cancelled", "restart"), "Pending").when(failed & (F.col("error") == "Cancelled"), "Pending")
        .when(failed & again, "RetryScheduled").when(failed, "FailedPermanent").otherwise(state)
    )
    attempts = F.col("attempts") + F.when(failed & (F.col("error") != "Cancelled"), 1).otherwise(0)
    rows = jobs.withColumns({"new_state": F.coalesce(new, state), "new_attempts": attempts})
    wait = (backoff_seconds(F.col("new_attempts")) * 1000).cast("long")
    next_at = F.when(F.col("new_state") == "RetryScheduled", F.when(F.coalesce(failed, F.lit(False)), F.lit(now) + wait).otherwise(F.col("next_at")))
    effect = F.when((F.col("new_state") == "Succeeded") & (event == "success"), "Translated").when((F.col("new_state") == "FailedPermanent") & F.coalesce(failed, F.lit(False)), "TranslationFailed")
    return rows.withColumns({"new_next_at": next_at, "segment_status": effect})


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash, work in progress is pending again."""
    return jobs.withColumn("state", F.when(F.col("state") == "InProgress", "Pending").otherwise(F.col("state")))


def illegal_steps(steps: DataFrame) -> DataFrame:
    """Rows (session, ord, from_state, to_state) that no edge of EDGES allows."""
    edges = steps.sparkSession.createDataFrame([(a, b) for a, to in EDGES.items() for b in to], "from_state string, to_state string")
    return steps.join(F.broadcast(edges), ["from_state", "to_state"], "left_anti")


def jobs_of_sessions(jobs: DataFrame) -> DataFrame:
    """jobs with their place in their session, by when they were made."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("ord")))
