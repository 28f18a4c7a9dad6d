"""Frames, energy and samples of measured series, as batch relations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SILENCE = 0.012


def gap_fill(frames: DataFrame, stream: str = "stream") -> DataFrame:
    """frames (session, stream, frame, sample) with a row for each frame up to a session's last; 0 where none came.

    A session's frames all lie between 0 and its last one, so its spine has no more
    rows than its length.
    """
    last = frames.groupBy("session").agg(F.max("frame").alias("last"))
    spine = last.select("session", F.explode(F.sequence(F.lit(0), "last")).alias("frame"))
    streams = frames.select("session", stream).distinct()
    return spine.join(streams, "session").join(frames, ["session", stream, "frame"], "left").select("session", stream, "frame", F.coalesce("sample", F.lit(0)).alias("sample"), F.col("sample").isNull().alias("filled"))


def saturate(sample: Column) -> Column:
    return F.least(F.greatest(sample, F.lit(-32768)), F.lit(32767))


def mix(left: DataFrame, right: DataFrame) -> DataFrame:
    """(session, frame, sample, clipped): both inputs added on the frame clock; an absent one is silence."""
    a = left.select("session", "frame", F.col("sample").alias("a"))
    b = right.select("session", "frame", F.col("sample").alias("b"))
    total = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    rows = a.join(b, ["session", "frame"], "full_outer").withColumn("total", total)
    return rows.select("session", "frame", saturate(F.col("total")).alias("sample"), (F.col("total") != saturate(F.col("total"))).alias("clipped"))


def drop_oldest(frames: DataFrame, capacity: int) -> DataFrame:
    """(session, kept, dropped): of frames that wait together, the newest stay, up to the capacity."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("frame"), F.desc("sample")))
    rows = frames.withColumn("rank", rank)
    return rows.groupBy("session").agg(F.count_if(F.col("rank") <= capacity).alias("kept"), F.count_if(F.col("rank") > capacity).alias("dropped"))


def utterances(samples: DataFrame, silence_ms: int, threshold: float = SILENCE) -> DataFrame:
    """(session, utterance, start_ms, end_ms, samples): loud samples (session, ms, id, rms) parted by silence."""
    loud = samples.where(F.col("rms") >= threshold)
    order = Window.partitionBy("session").orderBy("ms", "id")
    new = (F.col("ms") - F.lag("ms").over(order) >= silence_ms) | F.lag("ms").over(order).isNull()
    rows = loud.withColumn("new", new.cast("int")).withColumn("utterance", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("session", "utterance").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("*").alias("samples"))


def finalise_reason(has_text: Column, flush: Column, length_s: Column, wait_s: Column, silence_ms: Column, ends: Column, unchanged: Column) -> Column:
    """Why an utterance closes now, or None: the first that holds in this order."""
    return (
        F.when(~has_text, "None").when(flush, "Flush").when(length_s >= 12, "MaxLength").when(wait_s >= 20, "MaxWait")
        .when(silence_ms >= 700, "Silence").when(ends & (unchanged >= 2), "Punctuation").otherwise("None")
    )


def holds_fragment(reason: Column, runes: Column, ends: Column, held_ms: Column, longest: int = 4, hold_ms: int = 500) -> Column:
    """Whether a short fragment waits: not for hard reasons, and only up to hold_ms."""
    short = (runes > 0) & (runes <= longest) & ~ends
    return short & ~reason.isin("Flush", "MaxLength", "MaxWait", "None") & (held_ms < hold_ms)


def smooth(levels: DataFrame, release: float = 0.8) -> DataFrame:
    """(session, ord, level, shown): rises at once, falls by the release share; folded over a session in order."""
    rows = levels.select("session", "ord", F.col("level").cast("double").alias("level"))

    def run(batches):
        session, shown = None, 0.0  # all that is carried from one batch to the next
        for batch in batches:
            out = []
            for own, level in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != session:
                    session, shown = own, 0.0
                last = 0.0 if shown is None else shown
                shown = None if level is None else level if level >= last or level != level else last * release + level * (1 - release)
                out.append(shown)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "shown"])

    return rows.repartition("session").sortWithinPartitions("session", "ord").mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shown", T.DoubleType())]))


def rate(samples: DataFrame) -> DataFrame:
    """(key, id, rate): growth of the value per second since the sample before, not below 0; none for the first."""
    order = Window.partitionBy("key").orderBy("ms", "id")
    gone = (F.col("ms") - F.lag("ms").over(order)) / 1000.0
    grown = F.col("value") - F.lag("value").over(order)
    return samples.select("key", "id", F.when(gone > 0, F.greatest(grown / gone, F.lit(0.0))).alias("rate"))


def health(free_gb: Column, cpu: Column, least_gb: float) -> Column:
    return F.when(free_gb < least_gb, "LowDisk").when(F.coalesce(cpu, F.lit(0.0)) >= 90, "HighCpu").otherwise("Normal")


def rms(pcm: DataFrame) -> DataFrame:
    """(session, ord, rms) of int16 samples (session, ord, sample)."""
    return pcm.groupBy("session", "ord").agg(F.sqrt(F.avg(F.pow(F.col("sample") / 32768.0, 2))).alias("rms"))
