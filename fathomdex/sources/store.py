"""Tables kept as Parquet segments under one manifest.

A commit writes new segments and lists of deleted keys beside the old ones and then
puts a new manifest in place by renaming, so that readers see all of a commit or
none of it, and a small change doesn't rewrite the tables. A deleted key hides the rows of
earlier segments only. ``merge`` joins segments of like size, so that a row is rewritten
as often as the logarithm of the table; ``compact`` writes what is visible as one segment. Neither
is part of a commit.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments (or lists of deleted keys) of like size that are merged; the factor between sizes that count as alike.
MERGE_AT, ALIKE = 8, 4
#: Files and manifests younger than this many hours are never vacuumed: drafts and running readers hold some.
LEAST_HOURS = 24.0
#: A claim on a version older than this many seconds is of a writer that is gone.
CLAIM_SECONDS = 3600


class Draft:
    """A commit in the making: segments are written where they will stay, and count once it is published."""

    def __init__(self, store: "Store"):
        self.store, self.manifest = store, store.manifest()
        self.version = self.manifest["version"] + 1
        self.new: dict[str, str] = {}
        self.keys: dict[str, list[DataFrame]] = {}

    def put(self, table: str, rows: DataFrame) -> DataFrame:
        """Writes rows that replace those of the same keys, and returns them as written."""
        schema, key = self.store.tables[table]
        path = f"{table}/segment-{self.version}-{uuid.uuid4().hex[:8]}"
        names = self.store.spark.createDataFrame([], schema).columns
        # a lookup by key passes over row groups by their Bloom filters
        writer = rows.select(*names, F.lit(self.version).cast("long").alias("_segment")).write.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{self.store.folder}/{path}")
        written = self.store.spark.read.schema(schema).parquet(f"{self.store.folder}/{path}")
        self.new[table] = path
        self.remove(table, written.select(key))
        return written

    def remove(self, table: str, keys: DataFrame) -> None:
        """Hides the rows of these keys (a table of one column) in earlier segments."""
        self.keys.setdefault(table, []).append(keys.toDF("_key"))

    def publish(self) -> dict:
        for table, keys in self.keys.items():
            state = self.manifest["tables"][table]
            if state["segments"]:
                path = f"{table}/deleted-{self.version}-{uuid.uuid4().hex[:8]}"
                whole = reduce(DataFrame.union, keys).distinct()
                whole.withColumn("_before", F.lit(self.version).cast("long")).write.parquet(f"{self.store.folder}/{path}")
                state["deleted"].append(path)
        for table, path in self.new.items():
            self.manifest["tables"][table]["segments"].append(path)
        self.manifest["version"] = self.version
        self.store._publish(self.manifest)
        return self.manifest


class Store:
    """``tables``: schema and key column by name."""

    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, tuple[str, str]]):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), dict(tables)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda rest: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{rest}")
        self._fs = self._at("x").getFileSystem(conf)
        self._jvm = jvm

    # The manifests are numbered; the highest is the current one.

    def _manifests(self) -> list[int]:
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> dict:
        numbers = self._manifests()
        if not numbers:
            return {"version": 0, "tables": {t: {"segments": [], "deleted": []} for t in self.tables}}
        stream = self._fs.open(self._at(f"manifests/{numbers[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Puts the manifest in place, if this is the only writer of its version: who creates the claim may."""
        version = manifest["version"]
        target, claim, draft = (self._at(f"manifests/{x}") for x in (version, f".claim-{version}", f".draft-{uuid.uuid4().hex}"))
        taken = RuntimeError("another writer has committed meanwhile")
        if self._fs.exists(target):
            raise taken
        try:
            if self._fs.exists(claim) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
                self._fs.delete(claim, False)
            self._fs.create(claim, False).close()
        except Py4JJavaError as e:
            raise taken from e
        try:
            out = self._fs.create(draft)
            out.write(json.dumps(manifest).encode())
            out.close()
            if self._fs.exists(target) or not self._fs.rename(draft, target):
                self._fs.delete(draft, False)
                raise taken
        finally:
            self._fs.delete(claim, False)

    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        schema, key = self.tables[table]
        state = (manifest or self.manifest())["tables"][table]
        if not state["segments"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, _segment long").parquet(*[f"{self.folder}/{s}" for s in state["segments"]])
        if state["deleted"]:
            rows = self._visible(table, rows, state["deleted"])
        return rows.drop("_segment")

    def _key_kind(self, table: str) -> str:
        schema, key = self.tables[table]
        return next(f.dataType.simpleString() for f in self.spark.createDataFrame([], schema).schema if f.name == key)

    def _visible(self, table: str, rows: DataFrame, deleted: list[str]) -> DataFrame:
        """The rows that no later list of deleted keys hides."""
        key = self.tables[table][1]
        gone = self.spark.read.schema(f"_key {self._key_kind(table)}, _before long").parquet(*[f"{self.folder}/{d}" for d in deleted])
        gone = gone.groupBy("_key").agg(F.max("_before").alias("_before"))
        return rows.join(gone, (F.col(key) == F.col("_key")) & (F.col("_segment") < F.col("_before")), "left_anti")

    def draft(self) -> "Draft":
        return Draft(self)

    def commit(self, upserts: Mapping[str, DataFrame] | None = None, deletes: Mapping[str, DataFrame] | None = None) -> dict:
        """Replaces the rows of the keys in ``upserts`` and removes the keys in ``deletes`` (of one column), in all tables at once."""
        draft = self.draft()
        for table, rows in (upserts or {}).items():
            draft.put(table, rows)
        for table, keys in (deletes or {}).items():
            draft.remove(table, keys)
        return draft.publish()

    def _alike(self, paths: list[str]) -> list[str]:
        """The paths of the smallest size class that has enough to merge."""
        by: dict[int, list[str]] = {}
        for p in paths:
            size = self._fs.getContentSummary(self._at(p)).getLength()
            by.setdefault(int(math.log(max(1, size), ALIKE)), []).append(p)
        return next((by[k] for k in sorted(by) if len(by[k]) >= MERGE_AT), [])

    def merge(self) -> dict:
        """Merges segments of like size, and lists of deleted keys, until no size has many.

        Rows keep the number of the commit that wrote them, so the lists hide the same rows as before.
        """
        while True:
            manifest, done = self.manifest(), True
            version = manifest["version"] + 1
            for table, state in manifest["tables"].items():
                schema, key = self.tables[table]
                for kind, columns in (("segments", f"{schema}, _segment long"), ("deleted", f"_key {self._key_kind(table)}, _before long")):
                    if some := self._alike(state[kind]):
                        path = f"{table}/{kind[:7]}-{version}-{uuid.uuid4().hex[:8]}"
                        rows = self.spark.read.schema(columns).parquet(*[f"{self.folder}/{p}" for p in some])
                        if kind == "deleted":
                            rows = rows.groupBy("_key").agg(F.max("_before").alias("_before"))
                        elif state["deleted"]:
                            rows = self._visible(table, rows, state["deleted"])
                        rows.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{self.folder}/{path}")
                        state[kind] = [path if p == some[0] else p for p in state[kind] if p == some[0] or p not in some]
                        done = False
            if done:
                return manifest
            manifest["version"] = version
            self._publish(manifest)

    def compact(self) -> dict:
        manifest = self.manifest()
        version = manifest["version"] + 1
        for table, state in manifest["tables"].items():
            if len(state["segments"]) + len(state["deleted"]) > 1:
                path = f"{table}/segment-{version}-{uuid.uuid4().hex[:8]}"
                self.read(table, manifest).withColumn("_segment", F.lit(version).cast("long")).write.parquet(f"{self.folder}/{path}")
                state["segments"], state["deleted"] = [path], []
        manifest["version"] = version
        self._publish(manifest)
        return manifest

    def vacuum(self, hours: float = LEAST_HOURS) -> None:
        """Deletes files and manifests that the current manifest doesn't name and that are older than so many hours."""
        manifest, before = self.manifest(), (time.time() - hours * 3600) * 1000
        named = {p.rpartition("/")[2] for s in manifest["tables"].values() for p in s["segments"] + s["deleted"]}
        numbers = {str(n) for n in self._manifests()[:-1]}
        for folder, spared in [*((t, named) for t in self.tables), ("manifests", None)]:
            if self._fs.exists(self._at(folder)):
                for s in self._fs.listStatus(self._at(folder)):
                    name = s.getPath().getName()
                    if s.getModificationTime() <= before and (name in numbers if spared is None else name not in spared):
                        self._fs.delete(s.getPath(), True)

    def gone_at_exit(self) -> None:
        """Marks the folder to be deleted when the application ends."""
        self._fs.mkdirs(self._at("."))
        self._fs.deleteOnExit(self._at("."))

    def size_mb(self) -> float:
        if not self._fs.exists(self._at(".")):
            return 0.0
        return round(self._fs.getContentSummary(self._at(".")).getLength() / (1024 * 1024), 2)
