"""JSON-Lines messages, their audio, WAV files, manifests and dictionaries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.schemas import MANIFEST, MESSAGE

VERSION = 1
MOST_AUDIO_BYTES = 320_000
#: Required fields by type of message.
REQUIRED = {"start": ("sessionId",), "audio": ("sessionId", "seq", "pcm", "frames"), "flush": ("sessionId",), "transcript": ("sessionId", "text"), "error": ()}


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with `message` (fields of MESSAGE) and `problem`: null, or json, version, type, or missing:<field>."""
    m = F.from_json(F.col(column), MESSAGE, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("message", m)
    x = F.col("message")
    is_object = F.col(column).rlike(r"^\s*\{") & F.try_parse_json(F.col(column)).isNotNull()
    problem = F.when(~F.coalesce(is_object, F.lit(False)), "json").when(F.coalesce(x["v"], F.lit(0)) != VERSION, "version").when(~F.coalesce(x["type"].isin(*REQUIRED), F.lit(False)), "type")
    for kind, fields in REQUIRED.items():
        for f in fields:
            problem = problem.when((x["type"] == kind) & x[f].isNull(), f"missing:{f}")
    return rows.withColumn("problem", problem)


def audio(pcm: Column, frames: Column) -> tuple[Column, Column]:
    """The bytes of a base64 text, and what is wrong with them: base64, empty, odd, size or frames."""
    data = F.try_to_binary(pcm, F.lit("base64"))
    n = F.octet_length(data)
    problem = F.when(data.isNull(), "base64").when(n == 0, "empty").when(n % 2 == 1, "odd").when(n > MOST_AUDIO_BYTES, "size").when(frames.isNotNull() & (frames * 2 != n), "frames")
    return data, problem


def serialise(*fields: Column) -> Column:
    """One compact line; null fields are left out."""
    return F.to_json(F.struct(*fields))


def _chunks(content: bytes, most: int) -> Iterator[tuple[int, int, bytes]]:
    """(ord, start in samples, data) of 16-bit mono PCM; nothing if the file is another kind."""
    at, kind = 12, None
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and kind and kind[0] == 1 and kind[1] == 1 and kind[5] == 16:
            body = body[: len(body) // 2 * 2]
            for i, lo in enumerate(range(0, len(body), most // 2 * 2)):
                yield i, lo // 2, body[lo : lo + most // 2 * 2]
        at += 8 + size + size % 2


def wav(spark: SparkSession, path: str, most: int = 32_000, rate: int = 16_000) -> DataFrame:
    """(path, ord, start_s, data): even-length chunks of the WAV files below a path."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(p, i, start / rate, data) for i, start, data in _chunks(content, most)], columns=["path", "ord", "start_s", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, ord int, start_s double, data binary")


def wav_bytes(data: bytes, rate: int = 16_000) -> bytes:
    """A mono 16-bit WAV file."""
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(assets, problems) of manifest files: version 1, with unique ids, each with a path and a sheet."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    assets = rows.where(F.col("manifest_version") == "1").select(F.explode("assets").alias("a")).select("a.*")
    bad = assets.where(F.col("asset_id").isNull() | F.col("path").isNull() | F.col("sheet").isNull()).select(F.lit("manifest.field").alias("code"), "asset_id")
    twice = assets.groupBy("asset_id").count().where("count > 1").select(F.lit("manifest.duplicate").alias("code"), "asset_id")
    other = rows.where(~F.coalesce(F.col("manifest_version") == "1", F.lit(False))).select(F.lit("manifest.version").alias("code"), F.lit(None).cast("string").alias("asset_id"))
    return assets, bad.unionByName(twice).unionByName(other)


def dictionary(spark: SparkSession, path: str, seeds: DataFrame) -> DataFrame:
    """Profiles (id, language, hotwords) of a JSON file without broken rows, and the seeds it lacks."""
    rows = spark.read.schema(f"{'id string, language string, hotwords array<string>'}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    good = rows.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull() & F.col("language").isNotNull()).drop("_corrupt_record").dropDuplicates(["id"])
    return good.unionByName(seeds.join(good.select("id"), "id", "left_anti"))
