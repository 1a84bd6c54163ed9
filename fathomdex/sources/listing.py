"""Folders as Spark data sources: a listing, and a stream of what changes in it.

A listing skips names that begin with a dot, symbolic links, the data folder and
formats that aren't supported; a folder that can't be read gives no rows. Each
folder below a root is listed by a task of its own.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.paths import FAMILY_OF
from ..schemas import EVENTS, FILES


def walk(folder: str, exclude: str | None, deep: bool = True) -> Iterator[tuple[str, int, int, str]]:
    """(path, size, mtime in ns, extension) of the files in a folder."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if e.name.startswith(".") or (exclude and os.path.abspath(e.path) == exclude):
            continue
        if e.is_dir(follow_symlinks=False):
            if deep:
                yield from walk(e.path, exclude)
        elif e.is_file(follow_symlinks=False):
            ext = os.path.splitext(e.name)[1].lower()
            if ext in FAMILY_OF:
                try:
                    stat = e.stat(follow_symlinks=False)
                except OSError:  # it went meanwhile
                    continue
                yield os.path.abspath(e.path), stat.st_size, stat.st_mtime_ns, ext


def _folders(options: dict) -> tuple[list[str], str | None]:
    exclude = options.get("exclude")
    return [os.path.abspath(f) for f in json.loads(options["folders"])], os.path.abspath(exclude) if exclude else None


class FolderPart(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders, self.exclude = _folders(options)

    def partitions(self) -> list[FolderPart]:
        parts = []
        for folder in self.folders:
            parts.append(FolderPart(folder, False))
            try:
                inner = [e for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]
            except OSError:
                continue
            parts += [FolderPart(e.path, True) for e in sorted(inner, key=lambda e: e.name) if os.path.abspath(e.path) != self.exclude]
        return parts

    def read(self, partition: FolderPart) -> Iterator[tuple]:
        yield from walk(partition.folder, self.exclude, partition.deep)


class FolderSource(DataSource):
    """Options: folders (a JSON array of paths), exclude (a path)."""

    @classmethod
    def name(cls) -> str:
        return "fathomdex_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


class ChangeReader(SimpleDataSourceStreamReader):
    """Compares listings. Each step's changes are logged in ``state``, so that a step can be read again as it was.

    A file that was written less than ``settle`` seconds ago waits for a later step.
    """

    def __init__(self, options: dict):
        self.folders, self.exclude = _folders(options)
        self.state, self.settle = options["state"], float(options.get("settle", "1"))
        os.makedirs(self.state, exist_ok=True)

    def _file(self, kind: str, n: int) -> str:
        return f"{self.state}/{kind}-{n}.json"

    def _put(self, kind: str, n: int, data) -> None:
        with open(self._file(kind, n) + ".tmp", "w") as f:
            json.dump(data, f)
        os.replace(self._file(kind, n) + ".tmp", self._file(kind, n))

    def _get(self, kind: str, n: int):
        with open(self._file(kind, n)) as f:
            return json.load(f)

    def _listing(self) -> dict[str, list[int]]:
        return {path: [size, mtime] for folder in self.folders for path, size, mtime, _ in walk(folder, self.exclude)}

    def initialOffset(self) -> dict:
        if not os.path.exists(self._file("listing", 0)):
            self._put("listing", 0, self._listing())
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = int(start["n"])
        if os.path.exists(self._file("changes", n + 1)):  # made before a restart
            return self.readBetweenOffsets(start, {"n": n + 1}), {"n": n + 1}
        before, now, moment = self._get("listing", n), self._listing(), time.time_ns()
        after, changes = {}, []
        for path, (size, mtime) in sorted(now.items()):
            if path in before and before[path] == [size, mtime]:
                after[path] = before[path]
            elif moment - mtime < self.settle * 1e9:
                if path in before:
                    after[path] = before[path]
            else:
                after[path] = [size, mtime]
                changes.append([path, "index", size, mtime])
        changes += [[path, "remove", None, None] for path in sorted(before.keys() - now.keys())]
        if not changes:
            return iter(()), start
        rows = [[*c, moment // 1000, k] for k, c in enumerate(changes)]
        self._put("listing", n + 1, after)
        self._put("changes", n + 1, rows)
        return self._rows(rows), {"n": n + 1}

    @staticmethod
    def _rows(rows: list[list]) -> Iterator[tuple]:
        """A list's iterator, as Spark copies it."""
        from datetime import datetime, timezone

        return iter([(path, kind, size, mtime, datetime.fromtimestamp(micros / 1e6, timezone.utc), seq) for path, kind, size, mtime, micros, seq in rows])

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([x for n in range(int(start["n"]) + 1, int(end["n"]) + 1) for x in self._rows(self._get("changes", n))])

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state):  # what lies before the last step is no longer needed
            n = name.removesuffix(".json").rpartition("-")[2]
            if n.isdigit() and int(n) < int(end["n"]):
                os.unlink(f"{self.state}/{name}")


class ChangeSource(DataSource):
    """Options: folders, exclude, state (a folder for listings), settle (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "fathomdex_changes"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(ChangeSource)
