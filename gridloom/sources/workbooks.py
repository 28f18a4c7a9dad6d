"""A Spark data source for workbooks: files are found and dealt out by size, each is read and parsed once.

A row is of one part (cell, merge, asset, text, diagnostic) and has that part's
struct, the others are null. load() writes the rows by part, so that every relation
is read from Parquet and no file a second time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.schemas import ASSETS, CELLS, DIAGNOSTICS, MERGES, TEXTS
from gridloom.sources import xlsx
from gridloom.sources.files import opened

NAME = "workbooks"
PARTS = {"cell": CELLS, "merge": MERGES, "asset": ASSETS, "text": TEXTS, "diagnostic": DIAGNOSTICS}
SCHEMA = ", ".join(["part string", *(f"`{p}` struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in s.split(', '))}>" for p, s in PARTS.items())])


@dataclass
class Files(InputPartition):
    """The files of one task: (as asked for, path in its file system)."""

    paths: tuple[tuple[str, str], ...]


def discover(paths: list[str], json: bool = False) -> list[tuple[str, int]]:
    """(path, size) of the workbooks at and below the paths, each once, ordered without regard to case.

    Lock files (~$) are left out, and other endings in folders. A path that names a file
    is taken if its ending is one of a workbook; a path that isn't there is an error.
    """
    found: dict[str, int] = {}
    for path in paths:
        system, root = opened(path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        own = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = path[: len(path.rstrip("/")) - len(root)] if path.rstrip("/").endswith(root) else ""
        for f in own:
            wanted = re.search(xlsx.SUFFIXES, f.base_name) or json and f.base_name.lower().endswith(".json")
            if f.type == fs.FileType.File and wanted and not f.base_name.startswith("~$"):
                found[prefix + f.path] = f.size or 0
    return sorted(found.items(), key=lambda x: (x[0].casefold(), x[0]))


def dealt(files: list[tuple[str, int]], most: int) -> list[list[str]]:
    """The files in groups of up to `most` bytes, each file at least in one; a large file is a group of its own."""
    groups: list[list[str]] = []
    held = most + 1
    for path, size in files:
        if held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += size
    return groups


class WorkbookReader(DataSourceReader):
    def __init__(self, paths: list[str], most: int):
        self.paths, self.most = paths, most

    def partitions(self) -> list[Files]:
        return [Files(tuple((p, opened(p)[1]) for p in group)) for group in dealt(discover(self.paths), self.most)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        order = [*PARTS]
        for path, _ in partition.paths:
            system, at = opened(path)
            with system.open_input_stream(at) as stream:
                content = stream.read()
            for part, row in xlsx.rows_of(path, content):
                yield (part, *[row if p == part else None for p in order])


class Workbooks(DataSource):
    """format("workbooks"): option paths (comma-joined) or load(path); option bytes is the most that a task reads, 64 MB at first."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WorkbookReader:
        paths = [p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p]
        if not paths:
            raise ValueError("no path")
        return WorkbookReader(paths, int(self.options.get("bytes", 64 << 20)))


@dataclass(frozen=True)
class Relations:
    cells: DataFrame
    merges: DataFrame
    assets: DataFrame
    texts: DataFrame
    diagnostics: DataFrame


def rows(spark: SparkSession, *paths: str, most: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(Workbooks)
    return spark.read.format(NAME).option("paths", ",".join(paths)).option("bytes", str(most)).load()


def load(spark: SparkSession, folder: str, *paths: str) -> Relations:
    """The relations of all workbooks at and below the paths, from one reading that is kept as Parquet in folder (replaced if there)."""
    rows(spark, *paths).write.mode("overwrite").partitionBy("part").parquet(folder)
    kept = spark.read.schema(SCHEMA).parquet(folder)
    return Relations(*[kept.where(kept["part"] == p).select(f"{p}.*") for p in PARTS])
