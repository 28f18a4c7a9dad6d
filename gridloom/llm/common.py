"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Odd multipliers of the rolling hashes (arithmetic is modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share; below the warehouse in local mode, where it may be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


#: While this is set, a DataFrame that is made has its shuffle files removed when its action ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ADAPTIVE = "spark.sql.adaptive.enabled"


def checkpointed(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """Cut the lineage with files in shared_folder().

    Spark deletes them when the result is no longer referred to only where
    spark.cleaner.referenceTracking.cleanCheckpoints is set; else they stay.
    free_shuffles: the shuffle files behind it go at once, not when the driver's garbage is collected.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    if free_shuffles:
        before = spark.conf.get(FREE_SHUFFLES)
        spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df = df.select("*")
        finally:
            spark.conf.set(FREE_SHUFFLES, before)
    return df.checkpoint()


def dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """df dealt over n partitions by a column, checkpointed. Joins and groups by the column move the result no more while spark.sql.shuffle.partitions is n."""
    spark = df.sparkSession
    before = spark.conf.get(ADAPTIVE)
    spark.conf.set(ADAPTIVE, "false")  # an adaptive plan doesn't tell how its result is dealt
    try:
        return checkpointed(df.repartition(n, column), free_shuffles=True)
    finally:
        spark.conf.set(ADAPTIVE, before)


def forgotten(df: DataFrame) -> None:
    """Delete the files of a checkpointed df, which is not read again."""
    jvm, found = df.sparkSession.sparkContext._jvm, df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if found.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in shared_folder(), read again; the table stays there, as checkpoints do."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the input doesn't use (case is ignored, as in Spark)."""
    used = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in used:
        name = f"_{name}"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept between calls."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range, by one polynomial prefix sum."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    own = sums[1:]
    own[:] = values
    own += np.uint64(1)
    own *= up[:-1]
    np.cumsum(own, out=own)
    return mix((sums[ends] - sums[starts]) * down[starts])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (see WORD) of one text."""
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = ~((points == 32) | ((points >= 9) & (points <= 13)))
    changes = np.flatnonzero(inside[1:] != inside[:-1])
    return changes[::2], changes[1::2]


def word_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = word_bounds(points)
    return range_hashes(points, starts, ends), starts, ends


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n following words; none if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - n + 1)
    return range_hashes(words, at, at + n)


def held_out(doc_id) -> F.Column:
    """The fold that labels are never learned from: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
