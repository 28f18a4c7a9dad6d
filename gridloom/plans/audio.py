"""Captions over audio that says the conversations' texts; the audio is made by Spark from the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.plans import views
from gridloom.plans.registry import QUERIES, plain
from gridloom.streaming import audio, queues

#: A low rate: one character is a window of 16 samples.
OPTIONS = audio.Options(rate=1_600)
WINDOW = OPTIONS.samples(OPTIONS.window_ms)
PAUSE = " " * 80


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, at, pcm): each turn says its text and a pause of 800 ms."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(PAUSE))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = views.table(spark, sf_dir, "conversations").where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").alias("session"), (F.coalesce(F.sum(F.length(said)).over(before), F.lit(0)) * WINDOW).alias("at"), said.alias("said"))
    return audio.said(rows, "said", WINDOW)


def audio_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions and accounts of all conversations; no SQL: a state machine over samples (tests hold it against a plain one)."""
    return plain(audio.captions_batch(chunks(spark, sf_dir), audio.heard(WINDOW), OPTIONS))


QUERIES["audio_captions"] = audio_captions

#: Few places, so that bursts of the events drop some.
POLICY = queues.Policy(4, ("captions", "recording"), oldest=False)


def frame_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and time: views and clicks offer a frame, purchases take one from captions, signups and errors two from the recording."""
    kind = F.when(F.col("event_type").isin("view", "click"), queues.OFFER).otherwise(queues.TAKE)
    branch = F.when(F.col("event_type") == "purchase", "captions").when(F.col("event_type").isin("signup", "error"), "recording")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = views.table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").cast("long").alias("session"), place.cast("long").alias("ord"), kind.alias("kind"), branch.alias("branch"), F.col("event_id").cast("long").alias("frame"), F.when(branch == "recording", 2).otherwise(1).alias("n"))


def bounded_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each branch of each user took and dropped; no SQL: a queue's state goes through all events in order."""
    return plain(queues.depths(queues.bounded_batch(frame_events(spark, sf_dir), POLICY)))


QUERIES["bounded_queues"] = bounded_queues
