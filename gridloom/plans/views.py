"""Relations derived from the driver's tables, so that every operator runs at any scale.

conversations stand in for transcripts, customers for grids, events for jobs and
samples, line items for frames. VIEWS_SQL says the same in SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOC_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_and_folder(spark: SparkSession, sf_dir: str) -> tuple[SparkSession, str]:
    """What a query needs that puts several views together."""
    return spark, sf_dir


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    length = F.length("text").cast("long")
    start = 50 * F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = 50 * F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0))
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text",
        F.when(role == "assistant", F.concat(F.lit("tr: "), "text")).alias("translation"),
        F.when(role == "system", "Partial").when(role == "user", "Final").otherwise("Translated").alias("status"),
        F.lit("ja").alias("language"), start.alias("start_ms"), end.alias("end_ms"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("session") % 4
    state = F.when(kind == 0, "Running").when(kind == 1, "Completed").when(kind == 2, "Recovered").otherwise("StoppedDiskFull")
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session")).distinct()
    return ids.select("session", state.alias("state"), (1_700_000_000_000 + F.col("session") % 97 * 60_000).alias("started_ms"), F.lit("ja").alias("language"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of up to DOC_ROWS rows: name, nation, balance, a mark on every third, and one beyond a gap."""
    c = table(spark, sf_dir, "customer")
    doc = F.concat(F.lit("doc"), F.floor(F.col("c_custkey") / DOC_ROWS).cast("string"))
    rows = c.withColumn("doc", doc).withColumn("row", F.row_number().over(Window.partitionBy("doc", "c_mktsegment").orderBy("c_custkey")))
    text = lambda column, keep: F.when(keep & (F.col("c_nationkey") % 5 != 0), column).otherwise("")
    every = F.lit(True)
    values = [
        (1, text(F.col("c_name"), every)), (2, text(F.col("c_nationkey").cast("string"), every)), (3, text(F.floor("c_acctbal").cast("string"), every)),
        (4, text(F.concat(F.lit("mark|"), F.col("c_mktsegment")), F.col("c_custkey") % 3 == 0)), (6, text((F.col("c_custkey") % 7).cast("string"), F.col("c_nationkey") % 2 == 0)),
    ]
    struct = F.array(*[F.struct(F.lit(col).alias("col"), v.alias("display")) for col, v in values])
    return rows.select("doc", F.col("c_mktsegment").alias("sheet"), "row", F.explode(struct).alias("x"), (F.col("c_custkey") % 11 == 0).alias("bold")).select("doc", "sheet", "row", "x.col", "x.display", "bold")


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where((F.col("col") == 1) & (F.col("row") % 10 == 1)).select("doc", "sheet", F.col("row").alias("r0"), F.lit(1).alias("c0"), F.col("row").alias("r1"), F.lit(2).alias("c1"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per event: state by event id, segment by user, due times from the event's time."""
    i = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("Pending", "InProgress", "Succeeded", "RetryScheduled", "FailedPermanent", "Cancelled"))), (i % 6 + 1).cast("int"))
    event = F.element_at(F.array(*map(F.lit, ("picked", "success", "failure", "failure", "cancelled", "disabled", "restart"))), (i % 7 + 1).cast("int"))
    error = F.element_at(F.array(*map(F.lit, ("Timeout", "BadRequest", "RateLimited", "Network", "Auth"))), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("job"), i.cast("string")).alias("job"), i.alias("ord"), F.concat_ws("-", F.col("user_id"), i % 3).alias("segment"), state.alias("state"),
        (i % 5).cast("int").alias("attempts"), (i * 1000).alias("next_at"), event.alias("event"), F.when(event == "failure", error).alias("error"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("id"), (F.col("value") / 500).alias("rms"), "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of frames: by parity of the order; a session is a tenth of the orders' numbers apart."""
    rows = table(spark, sf_dir, "lineitem")
    stream = F.when(F.col("l_orderkey") % 2 == 0, "system").otherwise("mic")
    frame = F.col("l_linenumber").cast("int") + F.col("l_partkey").cast("int") % 10
    sample = F.floor(F.col("l_quantity") * 900).cast("int")
    return rows.groupBy(F.floor(F.col("l_orderkey") / 10).alias("session"), stream.alias("stream"), frame.alias("frame")).agg(F.max(sample).alias("sample"))


VIEWS_SQL = f"""
v_segments AS (SELECT conv_id AS session, turn AS seq, conv_id || '-' || turn AS id, text, CASE WHEN role = 'assistant' THEN 'tr: ' || text END AS translation,
  CASE role WHEN 'system' THEN 'Partial' WHEN 'user' THEN 'Final' ELSE 'Translated' END AS status, 'ja' AS language,
  CAST(50 * coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
  CAST(50 * sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_ms FROM conversations),
v_sessions AS (SELECT DISTINCT conv_id AS session, CASE conv_id % 4 WHEN 0 THEN 'Running' WHEN 1 THEN 'Completed' WHEN 2 THEN 'Recovered' ELSE 'StoppedDiskFull' END AS state,
  1700000000000 + conv_id % 97 * 60000 AS started_ms, 'ja' AS language FROM conversations),
v_grid AS (SELECT 'doc' || CAST(c_custkey // {DOC_ROWS} AS VARCHAR) AS doc, c_mktsegment AS sheet, c_custkey, c_name, c_nationkey, c_acctbal,
  row_number() OVER (PARTITION BY c_custkey // {DOC_ROWS}, c_mktsegment ORDER BY c_custkey) AS "row" FROM customer),
v_cells AS (SELECT doc, sheet, "row", 1 AS col, CASE WHEN c_nationkey % 5 <> 0 THEN c_name ELSE '' END AS display, c_custkey % 11 = 0 AS bold FROM v_grid
  UNION ALL SELECT doc, sheet, "row", 2, CASE WHEN c_nationkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END, c_custkey % 11 = 0 FROM v_grid
  UNION ALL SELECT doc, sheet, "row", 3, CASE WHEN c_nationkey % 5 <> 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) ELSE '' END, c_custkey % 11 = 0 FROM v_grid
  UNION ALL SELECT doc, sheet, "row", 4, CASE WHEN c_nationkey % 5 <> 0 AND c_custkey % 3 = 0 THEN 'mark|' || sheet ELSE '' END, c_custkey % 11 = 0 FROM v_grid
  UNION ALL SELECT doc, sheet, "row", 6, CASE WHEN c_nationkey % 5 <> 0 AND c_nationkey % 2 = 0 THEN CAST(c_custkey % 7 AS VARCHAR) ELSE '' END, c_custkey % 11 = 0 FROM v_grid),
v_merges AS (SELECT doc, sheet, "row" AS r0, 1 AS c0, "row" AS r1, 2 AS c1 FROM v_grid WHERE "row" % 10 = 1),
v_jobs AS (SELECT 'job' || event_id AS job, event_id AS ord, user_id || '-' || event_id % 3 AS segment,
  ['Pending', 'InProgress', 'Succeeded', 'RetryScheduled', 'FailedPermanent', 'Cancelled'][CAST(event_id % 6 + 1 AS INTEGER)] AS state, event_id % 5 AS attempts, event_id * 1000 AS next_at,
  ['picked', 'success', 'failure', 'failure', 'cancelled', 'disabled', 'restart'][CAST(event_id % 7 + 1 AS INTEGER)] AS event,
  CASE WHEN event_id % 7 IN (2, 3) THEN ['Timeout', 'BadRequest', 'RateLimited', 'Network', 'Auth'][CAST(event_id % 5 + 1 AS INTEGER)] END AS error FROM events),
v_samples AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS ms, event_id AS id, value / 500 AS rms, value FROM events),
v_frames AS (SELECT l_orderkey // 10 AS session, CASE WHEN l_orderkey % 2 = 0 THEN 'system' ELSE 'mic' END AS stream, l_linenumber + l_partkey % 10 AS frame,
  max(CAST(floor(l_quantity * 900) AS BIGINT)) AS sample FROM lineitem GROUP BY ALL)
"""
