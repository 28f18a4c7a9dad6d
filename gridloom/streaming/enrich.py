"""Calls to an outer service for jobs: capped, paced, told apart by error, and never made twice for a job that is done.

A service is a function of (job, text), so that it can use the job as its key against
repeated requests. Outcomes are kept in a folder by run; a run only calls for jobs
that have no final outcome there and are due, so one that died goes on where it was
written, and a retried task repeats at most its own calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.times import backoff_seconds, retryable

Service = Callable[[str, str], str]
#: An outcome of one call; slow says that it took longer than the interval between two.
OUTCOME = "job string, attempts int, result string, error string, retry_after double, slow boolean, called_at long"
FINAL = ("Succeeded", "FailedPermanent")


class ServiceError(Exception):
    """A service's refusal: a code such as RateLimited or BadRequest, and the seconds it asks to wait."""

    def __init__(self, code: str, retry_after: float | None = None):
        super().__init__(code)
        self.code, self.retry_after = code, retry_after


@dataclass(frozen=True)
class Caps:
    """A task makes at most per_second calls; texts beyond most_chars, and blank ones, are refused without a call; results are cut to most_result."""

    per_second: float = 5.0
    most_chars: int = 8_000
    most_result: int = 16_000
    max_retries: int = 3


def code_of(error: BaseException) -> str:
    """The code of an error: the service's own, Timeout, Network, BadRequest for values it can't take, else Unknown."""
    if isinstance(error, ServiceError):
        return error.code
    if isinstance(error, TimeoutError):
        return "Timeout"
    if isinstance(error, (ConnectionError, OSError)):
        return "Network"
    return "BadRequest" if isinstance(error, (ValueError, UnicodeError)) else "Unknown"


def stub(job: str, text: str) -> str:
    """The service of tests and of machines without a network: it says what it was given."""
    return f"[{job}] {text}"


def call(jobs: DataFrame, service: Service, caps: Caps = Caps(), now: int = 0) -> DataFrame:
    """OUTCOME of one call for each of jobs (job, text, attempts); no call raises."""
    pause = 1.0 / caps.per_second

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_at = 0.0
        for batch in batches:
            out = []
            for job, text, attempts in zip(batch["job"], batch["text"], batch["attempts"]):
                if not (text or "").strip() or len(text) > caps.most_chars:
                    out.append((job, attempts + 1, None, "BadRequest", None, False, now))
                    continue
                time.sleep(max(0.0, free_at - time.monotonic()))
                began = time.monotonic()
                result = error = wait = None
                try:
                    result = str(service(job, text))[: caps.most_result]
                except Exception as e:  # whatever a service raises is an outcome
                    error, wait = code_of(e), getattr(e, "retry_after", None)
                free_at = began + pause
                out.append((job, attempts + 1, result, error, wait, time.monotonic() - began > pause, now))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    rows = jobs.select("job", "text", F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"))
    return rows.mapInPandas(run, OUTCOME)


def states(outcomes: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """(job, state, attempts, result, error, next_at, slow): what the last outcome of each job makes of it.

    An error that can pass schedules a retry, by back-off or what the service asked
    for, until max_retries are used up; other errors are final at once.
    """
    last = outcomes.groupBy("job").agg(F.max_by(F.struct("attempts", "result", "error", "retry_after", "called_at"), F.struct("attempts", "called_at")).alias("x"), F.count_if("slow").alias("slow")).select("job", "x.*", "slow")
    again = retryable(F.col("error")) & (F.col("attempts") <= caps.max_retries)
    state = F.when(F.col("error").isNull(), "Succeeded").when(again, "RetryScheduled").otherwise("FailedPermanent")
    wait = backoff_seconds(F.col("attempts"), retry_after=F.when(~F.isnan("retry_after"), F.col("retry_after")))  # pandas makes nulls NaN
    return last.select("job", state.alias("state"), "attempts", "result", "error", F.when(state == "RetryScheduled", F.col("called_at") + (wait * 1_000).cast("long")).alias("next_at"), "slow")


def known(spark: SparkSession, folder: str) -> DataFrame:
    """All outcomes in a folder; none where it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(OUTCOME).option("recursiveFileLookup", "true").parquet(folder) if there else spark.createDataFrame([], OUTCOME)


def enrich(jobs: DataFrame, service: Service, folder: str, now: int, caps: Caps = Caps(), tasks: int = 8) -> DataFrame:
    """states() after one run over jobs (job, text): due ones are called, in so many tasks, and their outcomes are kept in folder.

    Of repeated jobs one is called; a null job is none.
    """
    spark = jobs.sparkSession
    before = states(known(spark, folder), caps).select("job", "state", "attempts", "next_at")
    wanted = jobs.where(F.col("job").isNotNull()).groupBy("job").agg(F.min("text").alias("text")).join(before, "job", "left")
    due = wanted.where(~F.coalesce(F.col("state").isin(*FINAL), F.lit(False)) & (F.coalesce("next_at", F.lit(now)) <= now))
    call(due.repartition(tasks, "job"), service, caps, now).write.mode("append").parquet(folder)
    return states(known(spark, folder), caps)
