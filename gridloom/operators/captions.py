"""Transcripts: sessions, segments, search, playback, export, and summary chunks.

segments and sessions have the columns of gridloom.schemas. Times are milliseconds.
Every function takes and returns DataFrames; orders are columns, never row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.folds import folded
from gridloom.functions.text import strip, utf16_length
from gridloom.functions.times import clamp, clock, playback_time, srt_time

CONFIRMED = ("Final", "Translated", "TranslationFailed")
FINISHED = ("Completed", "Recovered")
LEAST_BUDGET, MOST_BUDGET = 500, 20_000


def persisted(segments: DataFrame) -> DataFrame:
    """What a transcript shows: no partial and no blank texts."""
    return segments.where((F.col("status") != "Partial") & (strip(F.col("text")) != ""))


def translated(segments: DataFrame) -> DataFrame:
    return persisted(segments).where(strip(F.coalesce("translation", F.lit(""))) != "")


def srt(segments: DataFrame, text: str = "text") -> DataFrame:
    """(session, idx, start, end, body, cue): subtitle cues, numbered per session without gaps.

    A cue never ends before it starts.
    """
    number = F.row_number().over(Window.partitionBy("session").orderBy("seq", "id"))
    start, end = srt_time(F.col("start_ms")), srt_time(F.greatest("end_ms", "start_ms"))
    rows = segments.select("session", number.alias("idx"), start.alias("start"), end.alias("end"), strip(F.col(text)).alias("body"))
    return rows.withColumn("cue", F.concat(F.col("idx").cast("string"), F.lit("\r\n"), "start", F.lit(" --> "), "end", F.lit("\r\n"), "body", F.lit("\r\n\r\n")))


def txt(segments: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("session").orderBy("seq", "id"))
    return segments.select("session", number.alias("idx"), F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("] "), strip(F.col("text")), F.lit("\n")).alias("line"))


def document(lines: DataFrame, line: str) -> DataFrame:
    """(session, content): the lines of a session in one text."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", line)))
    return lines.groupBy("session").agg(F.array_join(F.transform(ordered, lambda x: x[line]), "").alias("content"))


def session_document(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """The facts of session.json, with the defaults for stores that lack translation columns."""
    facts = segments.groupBy("session").agg(F.count("*").alias("segments"), F.bool_or(F.col("translation").isNotNull()).alias("any_translated"))
    rows = sessions.join(facts, "session", "left").withColumn("translation_enabled", F.coalesce("any_translated", F.lit(False)))
    source = F.when(F.col("translation_enabled"), "ja").otherwise(F.col("language"))
    target = F.when(F.col("translation_enabled"), "zh")
    return rows.select("session", "state", "language", F.coalesce("segments", F.lit(0)).alias("segments"), "translation_enabled", source.alias("source"), target.alias("target"))


def history(sessions: DataFrame, segments: DataFrame, limit: int) -> DataFrame:
    """The newest sessions (1 to 100) with their number of segments."""
    newest = sessions.orderBy(F.desc("started_ms"), "session").limit(min(100, max(1, limit)))
    counts = segments.groupBy("session").agg(F.count("*").alias("segments"))
    return newest.join(counts, "session", "left").select("session", "state", "started_ms", F.coalesce("segments", F.lit(0)).alias("segments"))


def incomplete(sessions: DataFrame) -> DataFrame:
    return sessions.where(~F.col("state").isin(*FINISHED))


def next_sequence(segments: DataFrame) -> DataFrame:
    return segments.groupBy("session").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def upsert(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """stored with incoming merged by (session, id).

    The last incoming row of an id wins. A known id keeps its seq; new ids get the
    numbers after the session's last, in the order they first came.
    """
    key = ["session", "id"]
    fields = [c for c in stored.columns if c not in (*key, "seq")]
    last = incoming.groupBy(*key).agg(F.max(F.struct(order, *fields)).alias("row"), F.min(order).alias("first"))
    merged = stored.withColumn("known", F.lit(True)).join(last, key, "full_outer")
    top = stored.groupBy("session").agg(F.max("seq").alias("top"))
    fresh = Window.partitionBy("session", "known").orderBy("first", "id")
    seq = F.coalesce("seq", F.coalesce("top", F.lit(0)) + F.row_number().over(fresh))
    values = [F.when(F.col("row").isNotNull(), F.col(f"row.{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    return merged.join(top, "session", "left").select(*key, seq.alias("seq"), *values)


def insert_absent(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows with a new key are added; of several, one stays."""
    return stored.unionByName(incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti"))


def update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """stored with the non-null values of changes (one row per key) in place."""
    own = changes.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != key])
    changed = {c for c in changes.columns if c != key}
    columns = [F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c) for c in stored.columns]
    return stored.join(own, key, "left").select(*columns)


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the sessions in gone."""
    return {name: df.join(gone.select("session").distinct(), "session", "left_anti") for name, df in tables.items()}


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that break the foreign key."""
    return child.join(parent.select(key), key, "left_anti")


def search(segments: DataFrame, query: str) -> DataFrame:
    """Texts or translations that contain the stripped query, case ignored; all rows for a blank one."""
    needle = query.strip().lower()
    if not needle:
        return segments
    hit = lambda c: F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return segments.where(hit(F.col("text")) | hit(F.col("translation")))


def playback(positions: DataFrame, segments: DataFrame, offset_s: float = 0.0) -> DataFrame:
    """(session, pos_ms, seq, at): for each position the last caption that has started; seq -1 before the first.

    The offset is rounded to a tenth of a second and held within ten seconds. Both
    sides are sorted once per session; no pairs are made. Null sessions and null
    positions have no caption.
    """
    shift = int(round(min(10.0, max(-10.0, round(offset_s, 1))) * 1000))
    caps = segments.where(F.col("session").isNotNull() & F.col("start_ms").isNotNull()).select("session", (F.col("start_ms") + shift).alias("ms"), F.lit(0).alias("kind"), "seq")
    asks = positions.select("session", F.col("pos_ms").alias("ms"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"))
    before = Window.partitionBy("session").orderBy("ms", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = caps.unionByName(asks).withColumn("hit", F.last("seq", ignorenulls=True).over(before))
    return rows.where(F.col("kind") == 1).select("session", F.col("ms").alias("pos_ms"), F.coalesce("hit", F.lit(-1)).alias("seq"), playback_time(F.col("ms")).alias("at"))


def time_range(segments: DataFrame) -> DataFrame:
    """(session, start_ms, end_ms, duration_ms, has_valid) over rows that don't end before they start."""
    valid = segments.where(F.col("end_ms") >= F.col("start_ms"))
    span = valid.groupBy("session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return span.withColumn("duration_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).withColumn("has_valid", F.col("end_ms") > F.col("start_ms"))


def monotone(segments: DataFrame) -> DataFrame:
    """Starts at or after the end before, ends at or after the start; ends must not fall within a session."""
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col("start_ms"), F.coalesce(F.max("end_ms").over(before), F.col("start_ms")))
    rows = segments.withColumn("start_ms", start)
    return rows.withColumn("end_ms", F.greatest("end_ms", "start_ms"))


def summary_chunks(segments: DataFrame, budget: int = 2_500) -> DataFrame:
    """(session, chunk, first_seq, last_seq, segments, chars, oversize, start_ms, end_ms).

    Whole confirmed segments in order; a chunk closes when the next would pass the
    budget (500 to 20000 UTF-16 units). A segment over the budget stands alone and
    is marked. The fold reads a session's lengths in order and keeps one sum.
    """
    limit = min(MOST_BUDGET, max(LEAST_BUDGET, budget))
    rows = segments.where(F.col("status").isin(*CONFIRMED)).select("session", "seq", utf16_length(F.col("text")).cast("long").alias("n"), "start_ms", "end_ms")

    def step(state: tuple, row: dict):
        chunk, held, oversize = state
        alone = row["n"] > limit
        fresh = alone or oversize or chunk == 0 or (held > 0 and held + row["n"] > limit)
        state = (chunk + fresh, row["n"] if fresh else held + row["n"], alone)
        return state, [(state[0], row["seq"], row["n"], alone, row["start_ms"], row["end_ms"])]

    kind = dict(segments.dtypes)["session"]
    placed = folded(rows.fillna(0, ["n"]), "seq", lambda: (0, 0, False), step, f"session {kind}, chunk int, seq long, n long, over boolean, start_ms long, end_ms long")
    return placed.groupBy("session", "chunk").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("segments"), F.sum("n").alias("chars"),
        F.bool_or("over").alias("oversize"), F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"),
    )


def newest_lines(segments: DataFrame, n: int) -> DataFrame:
    """The last n (1 to 5) lines of each session."""
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))
    return segments.withColumn("place", place).where(F.col("place") <= min(5, max(1, n))).drop("place")


def apply_outcomes(segments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """segments with the translations of outcomes (id, translation, ok); unknown ids change nothing, text never does."""
    rows = segments.join(outcomes.select("id", F.col("translation").alias("new"), "ok"), "id", "left")
    status = F.when(F.col("ok"), "Translated").when(~F.col("ok"), "TranslationFailed").otherwise(F.col("status"))
    text = F.when(F.col("ok"), F.col("new")).otherwise(F.col("translation"))
    return rows.withColumns({"status": status, "translation": text}).drop("new", "ok")


def recent_meetings(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """(session, state, duration, detail) for a list of meetings."""
    span = time_range(segments)
    rows = sessions.join(span, "session", "left")
    length = clock(clamp(F.coalesce("duration_ms", F.lit(0)), 0, 2**53))
    return rows.select("session", "state", length.alias("duration"), F.concat_ws(" · ", "state", length).alias("detail"))
