"""Rows as files of given names: a Spark data source with a commit protocol.

Rows name their file; following rows of one file are written one after another, so a
task holds one row and one open file. A task writes into a folder of its own attempt;
only when all tasks are done are the files of the attempts that counted renamed into
place, and a job that fails leaves none. A killed or repeated task leaves no half
file. Each file changes as a whole; a driver that dies between two renames leaves
whole files of both jobs, and no _SUCCESS until all are there.

Paths go through Arrow's file systems, so a folder may be a URI (file, hdfs, s3, gs).
"""

from __future__ import annotations

import codecs
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "named_files"
TEMPORARY, DONE = "_temporary", "_SUCCESS"


class OutputError(ValueError):
    """A file that can't be written where or as it was asked for."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*:", path):
        system, at = fs.FileSystem.from_uri(path)
        return system, at.rstrip("/")
    return fs.LocalFileSystem(), posixpath.abspath(path)


def checked_name(name: str | None) -> str:
    """The relative path of a file; OutputError if it is none below its folder or begins with `_`, as the job's own do."""
    parts = [p for p in (name or "").replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or (name or "").startswith(("/", "\\")) or ".." in parts or re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*:", name or "") or parts[0] in (TEMPORARY, DONE):
        raise OutputError(f"not a path below the folder: {name!r}")
    return "/".join(parts)


@dataclass
class Written(WriterCommitMessage):
    """The files of one task's attempt: their place there and their names."""

    files: list[tuple[str, str]] = field(default_factory=list)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, bom: bool):
        self.path, self.overwrite, self.bom, self.job = path, overwrite, bom, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        folder = f"{root}/{TEMPORARY}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        done, names, name, stream = Written(), set(), None, None
        try:
            for batch in iterator:
                for file, content in zip(batch.column(batch.schema.get_field_index("file")).to_pylist(), batch.column(batch.schema.get_field_index("content")).to_pylist()):
                    file = checked_name(file)
                    if file != name:
                        if stream:
                            stream.close()
                        if file in names:
                            raise OutputError(f"rows of {file} do not follow each other")
                        names.add(file)
                        name, place = file, f"{folder}/{len(names)}"
                        done.files.append((place, file))
                        stream = system.open_output_stream(place)
                        if self.bom:
                            stream.write(codecs.BOM_UTF8)
                    stream.write(content.encode("utf-8", "surrogatepass") if isinstance(content, str) else content or b"")
        finally:
            if stream:
                stream.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """All names are checked before the first file is moved."""
        system, root = opened(self.path)
        moves = [x for m in messages if m for x in m.files]
        names = [name for _, name in moves]
        if len(set(names)) < len(names):
            raise OutputError(f"written by two tasks: {sorted({n for n in names if names.count(n) > 1})}")
        if not self.overwrite and (there := [n for n in names if system.get_file_info(f"{root}/{n}").type != fs.FileType.NotFound]):
            raise OutputError(f"there already: {sorted(there)}")
        for place, name in moves:
            system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            system.move(place, f"{root}/{name}")
        self._clean(system, root)
        system.open_output_stream(f"{root}/{DONE}").close()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        """This job's folder goes; that of all jobs only if no other is at work."""
        if system.get_file_info(f"{root}/{TEMPORARY}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{TEMPORARY}/{self.job}")
        if system.get_file_info(f"{root}/{TEMPORARY}").type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(f"{root}/{TEMPORARY}")):
            system.delete_dir(f"{root}/{TEMPORARY}")


class NamedFiles(DataSource):
    """format("named_files"): rows (file string, content string or binary); option path is the folder, bom true begins each file with a byte-order mark."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if [f.name for f in schema.fields] != ["file", "content"] or schema["file"].dataType.typeName() != "string" or schema["content"].dataType.typeName() not in ("string", "binary"):
            raise OutputError("rows are (file string, content string or binary)")
        return FilesWriter(self.options["path"], overwrite, self.options.get("bom", "false").lower() == "true")


def write_files(rows: DataFrame, path: str, order: str | None = None, bom: bool = False, overwrite: bool = True) -> None:
    """The rows (file, content) as files below path; a file of several rows is their contents in the given order.

    Null contents are empty; a name that leaves the folder, or with overwrite off one
    that exists, fails the job before any file changes. A file is one task's work.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    chosen = rows.select("file", "content", *([F.col(order).alias("_order")] if order else []))
    dealt = chosen.repartition("file").sortWithinPartitions("file", *(["_order"] if order else [])).select("file", "content")
    dealt.write.format(NAME).mode("overwrite" if overwrite else "append").option("bom", str(bom).lower()).save(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file that changes as a whole, such as settings; the driver writes it beside and renames it."""
    folder, _, name = path.rpartition("/")
    system, root = opened(folder or ".")
    system.create_dir(root, recursive=True)
    beside = f"{root}/.{checked_name(name)}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as stream:
        stream.write(text.encode())
    system.move(beside, f"{root}/{name}")


def put_json(spark: SparkSession, path: str, value: object) -> None:
    """Settings or dictionaries as JSON with sorted keys; see put_text."""
    import json

    put_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n")
