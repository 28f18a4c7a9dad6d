"""A transcript store on Parquet whose tables change together.

A manifest names the files of every table, by bucket of session; the newest one counts.
A change writes new files of its own rows only and then, as its one visible step,
renames the next manifest into place, which fails if another writer was faster. A crash
before that leaves the state before, in all tables. A row's newest version counts when
a bucket is read. Runs of small files in a bucket are merged like the levels of a log:
a row is rewritten about log2 of the number of batches times, whatever the history.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.captions import insert_absent, update, upsert

#: What a row is known by; other tables go by session.
KEYS = {"segments": ["session", "id"], "sessions": ["session"]}
BUCKETS = 32
ATTEMPTS = 10


class Conflict(RuntimeError):
    """Other writers were faster each time."""


class Store:
    """Tables with a session column. schemas has each table's columns; buckets holds for a new store alone."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.path, self.schemas, self._buckets = spark, path.rstrip("/"), schemas, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests.

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, batches (the last batch of each stream), and tables: by bucket the [folder, version, rows] that are read."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self._buckets, "batches": {}, "tables": {t: {} for t in self.schemas}}
        stream = self._fs.open(self._at(f"manifests/{known[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest is the next version; False if that exists by now."""
        draft = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(draft, self._at(f"manifests/{manifest['version']}.json"), plain)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    # Reading.

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64("session"), F.lit(n)).cast("int")

    def _rows(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count, of all buckets or of some: of equal keys the newest; buckets of one folder need no comparison."""
        schema = f"{self.schemas[table]}, _version long"
        held = {int(b): x for b, x in manifest["tables"].get(table, {}).items() if buckets is None or int(b) in buckets}
        folders = lambda many: [f"{self.path}/{folder}" for x in held.values() if (len(x) > 1) == many for folder, *_ in x]
        read = lambda paths: self.spark.read.schema(schema).parquet(*paths) if paths else None
        plain, layered = read(folders(False)), read(folders(True))
        if layered is not None:
            newest = F.row_number().over(Window.partitionBy(*KEYS.get(table, ["session"])).orderBy(F.desc("_version")))
            layered = layered.withColumn("_place", newest).where("_place = 1").drop("_place")
        both = [x for x in (plain, layered) if x is not None]
        if not both:
            return self.spark.createDataFrame([], self.schemas[table])
        return (both[0] if len(both) == 1 else both[0].unionByName(both[1])).drop("_version")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of the newest version, or of one that is still kept."""
        return self._rows(self.manifest(version), table)

    # Writing.

    def _touched(self, rows: DataFrame, n: int) -> list[int]:
        return [r["b"] for r in rows.select(self._bucket(n).alias("b")).distinct().collect()]

    def _written(self, manifest: dict, table: str, rows: DataFrame, version: int) -> dict[int, list]:
        """By bucket the [folder, version, rows] of new files; a bucket is one folder."""
        name = f"data/{table}/{uuid.uuid4().hex}"
        n = manifest["buckets"]
        rows = rows.withColumn("_version", F.lit(version).cast("long")).withColumn("bucket", self._bucket(n))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        counts = self.spark.read.parquet(f"{self.path}/{name}").groupBy("bucket").count().collect() if self._fs.exists(self._at(name)) and any(s.isDirectory() for s in self._fs.listStatus(self._at(name))) else []
        return {int(r["bucket"]): [f"{name}/bucket={r['bucket']}", version, r["count"]] for r in counts}

    def change(self, work: Callable[[Transaction], None], stream: str | None = None, batch: int | None = None) -> int:
        """Run work on a transaction and make all its changes visible at once; the new version.

        Another writer's version makes it run again on the new state. A batch of a
        stream that was taken before changes nothing.
        """
        for _ in range(ATTEMPTS):
            before = self.manifest()
            if stream is not None and batch is not None and batch <= before["batches"].get(stream, -1):
                return before["version"]
            t = Transaction(self, before)
            work(t)
            if not t.changed and stream is None:
                return before["version"]
            after = {**before, "version": before["version"] + 1, "tables": {**before["tables"], **t.changed}}
            if stream is not None:
                after["batches"] = {**before["batches"], stream: batch}
            if self._publish(after):
                return after["version"]
        raise Conflict(f"{ATTEMPTS} versions by others")

    def upsert_segments(self, incoming: DataFrame, order: str) -> None:
        """Final rows only; partial ones are never stored."""
        self.change(lambda t: t.upsert_segments(incoming, order))

    def create_sessions(self, incoming: DataFrame) -> None:
        self.change(lambda t: t.create_sessions(incoming))

    def update_sessions(self, changes: DataFrame) -> None:
        self.change(lambda t: t.update_sessions(changes))

    def delete(self, gone: DataFrame) -> None:
        """The rows of sessions go from all tables at once."""
        self.change(lambda t: t.delete(gone))

    def sink(self, order: str, stream: str = "segments"):
        """For foreachBatch: a batch that comes again changes nothing."""
        return lambda batch, number: self.change(lambda t: t.upsert_segments(batch, order), stream, number)

    def vacuum(self, keep: int = 2) -> int:
        """Manifests but the last `keep` go, and folders that none of these names; how many folders. Writers must be at rest."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        for v in known[:-keep]:
            self._fs.delete(self._at(f"manifests/{v}.json"), False)
        used = {folder for m in kept for buckets in m["tables"].values() for x in buckets.values() for folder, *_ in x}
        gone = 0
        for table in self.schemas:
            if self._fs.exists(self._at(f"data/{table}")):
                for write in self._fs.listStatus(self._at(f"data/{table}")):
                    own = [f"data/{table}/{write.getPath().getName()}/{b.getPath().getName()}" for b in self._fs.listStatus(write.getPath()) if b.isDirectory()]
                    if not used & set(own):
                        gone += self._fs.delete(write.getPath(), True)
                    else:
                        gone += sum(self._fs.delete(self._at(b), True) for b in own if b not in used)
        return gone


class Transaction:
    """Changes of one version; each reads the buckets it touches, and what was changed before it."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.before, self.changed = store, manifest, {}

    def _now(self) -> dict:
        return {**self.before, "tables": {**self.before["tables"], **self.changed}}

    def _add(self, table: str, rows: DataFrame) -> None:
        """New versions of rows, on top of their buckets; then runs of folders no larger than what lies on them become one."""
        store, version = self.store, self.before["version"] + 1
        buckets = {b: [*x] for b, x in self._now()["tables"].get(table, {}).items()}
        for b, entry in store._written(self.before, table, rows, version).items():
            buckets.setdefault(str(b), []).append(entry)
        self.changed[table] = buckets
        merge: dict[str, int] = {}
        for b, x in buckets.items():
            take, size = 1, x[-1][2] if x else 0
            while take < len(x) and x[-take - 1][2] <= size:
                size += x[-take - 1][2]
                take += 1
            if take > 1:
                merge[b] = take
        if merge:
            part = {**self._now(), "tables": {table: {b: buckets[b][-n:] for b, n in merge.items()}}}
            for b, entry in store._written(self.before, table, store._rows(part, table), version).items():
                buckets[str(b)] = [*buckets[str(b)][: -merge[str(b)]], entry]

    def upsert_segments(self, incoming: DataFrame, order: str) -> None:
        rows = incoming.where("status <> 'Partial'")
        buckets = self.store._touched(rows, self.before["buckets"])
        stored = self.store._rows(self._now(), "segments", buckets).join(rows.select("session").distinct(), "session", "left_semi")
        merged = upsert(stored, rows, order).select(*stored.columns)
        self._add("segments", merged.join(rows.select("session", "id").distinct(), ["session", "id"], "left_semi").select(*stored.columns))

    def create_sessions(self, incoming: DataFrame) -> None:
        stored = self.store._rows(self._now(), "sessions", self.store._touched(incoming, self.before["buckets"]))
        whole = insert_absent(stored, incoming, "session")
        self._add("sessions", whole.join(stored.select("session"), "session", "left_anti").select(*stored.columns))

    def update_sessions(self, changes: DataFrame) -> None:
        stored = self.store._rows(self._now(), "sessions", self.store._touched(changes, self.before["buckets"]))
        self._add("sessions", update(stored.join(changes.select("session"), "session", "left_semi"), changes, "session").select(*stored.columns))

    def delete(self, gone: DataFrame) -> None:
        """Touched buckets are written anew without the sessions."""
        ids = gone.select("session").distinct()
        touched = self.store._touched(ids, self.before["buckets"])
        for table in self.store.schemas:
            now = self._now()["tables"].get(table, {})
            kept = self.store._rows(self._now(), table, touched).join(ids, "session", "left_anti")
            written = self.store._written(self.before, table, kept, self.before["version"] + 1)
            rest = {b: x for b, x in now.items() if int(b) not in touched}
            self.changed[table] = rest | {str(b): [entry] for b, entry in written.items()}
