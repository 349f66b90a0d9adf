"""A folder as a stream of its added, changed and deleted files.

The source compares listings: an offset is the number of a listing that is kept
in a state folder, so a restart goes on from the listing it had reached. Files
whose size or time differ between two listings are read and hashed by the tasks;
state by file tells which contents really are new, so a touched file gives no row
and every change gives one, over restarts too.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..ship import ship

SEEN = "rel string, gone boolean, size long, mtime_us long, sha256 string"
CHANGE = "rel string, file_id string, change string, size long, mtime_us long, sha256 string, previous string"
#: Files and bytes that one task hashes.
TASK_FILES, TASK_BYTES = 256, 256 << 20


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+://|file:/", path) else (fs.LocalFileSystem(), path)


def listing(root: str, pattern: str | None = None) -> dict[str, list[int]]:
    """{relative path: [size, time in microseconds]} of a folder's files; names that start with a dot are passed over."""
    files, top = _folder(root)
    top, out = top.rstrip("/"), {}
    for x in files.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)):
        rel = x.path[len(top) :].lstrip("/")
        if x.type == fs.FileType.File and not any(part.startswith(".") for part in rel.split("/")) and (pattern is None or re.search(pattern, rel)):
            out[rel] = [x.size, (x.mtime_ns or 0) // 1000]
    return out


class Files(InputPartition):
    def __init__(self, files: list[tuple], gone: list[str]):
        self.files, self.gone = files, gone


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state, self.pattern = options["path"], options["state"].rstrip("/"), options.get("pattern")

    def _kept(self) -> list[int]:
        files, top = _folder(self.state)
        found = files.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return sorted(int(m[1]) for x in found if (m := re.fullmatch(r"listing-(\d+)\.json\.gz", x.base_name)))

    def _load(self, number: int) -> dict:
        if number == 0:
            return {}
        files, top = _folder(self.state)
        with files.open_input_stream(f"{top}/listing-{number}.json.gz", compression=None) as data:
            return json.loads(gzip.decompress(data.read()))

    def _save(self, number: int, found: dict) -> None:
        """Written beside and then renamed, so that a listing is there whole or not at all."""
        files, top = _folder(self.state)
        files.create_dir(top, recursive=True)
        with files.open_output_stream(f"{top}/.making-{number}", compression=None) as out:
            out.write(gzip.compress(json.dumps(found, sort_keys=True).encode(), mtime=0))
        files.move(f"{top}/.making-{number}", f"{top}/listing-{number}.json.gz")

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self._kept(), default=0)
        now = listing(self.root, self.pattern)
        if now != self._load(last):
            last += 1
            self._save(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = self._load(start["listing"]), self._load(end["listing"])
        out, some, size = [], [], 0
        for rel, stamp in sorted(now.items()):
            if before.get(rel) != stamp:
                some.append((rel, *stamp))
                size += stamp[0]
                if len(some) >= TASK_FILES or size >= TASK_BYTES:
                    out.append(Files(some, []))
                    some, size = [], 0
        gone = sorted(before.keys() - now.keys())
        return [*out, Files(some, gone)] if some or gone or not out else out

    def read(self, partition: Files):
        files, top = _folder(self.root)
        for rel, size, mtime in partition.files:
            digest = hashlib.sha256()
            try:
                with files.open_input_stream(f"{top.rstrip('/')}/{rel}", compression=None) as data:
                    while block := data.read(1 << 20):
                        digest.update(block)
            except FileNotFoundError:  # gone since it was listed; the next listing says so too
                yield (rel, True, None, None, None)
                continue
            yield (rel, False, size, mtime, digest.hexdigest())
        for rel in partition.gone:
            yield (rel, True, None, None, None)

    def commit(self, end: dict) -> None:
        files, top = _folder(self.state)
        for number in self._kept():
            if number < end["listing"] - 1:
                files.delete_file(f"{top}/listing-{number}.json.gz")


class FolderSource(DataSource):
    """``spark.readStream.format("folder_watch").option("state", folder).load(path)``: files that may have changed."""

    @classmethod
    def name(cls) -> str:
        return "folder_watch"

    def schema(self) -> str:
        return SEEN

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(dict(self.options))


class Contents(StatefulProcessor):
    """State of a file: the hash of its content as last told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "sha256 string")

    def handleInputRows(self, key, rows, timerValues):
        previous = self.told.get()[0] if self.told.exists() else None
        first, last = previous, None
        for frame in rows:
            for row in frame.itertuples():
                last = row
        if last is None:
            return
        now = None if last.gone else last.sha256
        if now == first:
            return
        if now is None:
            self.told.clear()
        else:
            self.told.update((now,))
        change = "added" if first is None else "deleted" if now is None else "changed"
        file_id = "file_" + hashlib.sha256(key[0].encode()).hexdigest()[:16]
        yield pd.DataFrame({"rel": [key[0]], "file_id": [file_id], "change": [change], "size": pd.array([None if now is None else int(last.size)], "Int64"), "mtime_us": pd.array([None if now is None else int(last.mtime_us)], "Int64"), "sha256": [now], "previous": [first]})

    def close(self) -> None:
        pass


def changes(spark: SparkSession, root: str, state: str, pattern: str | None = None) -> DataFrame:
    """Stream of (rel, file_id, change, size, mtime_us, sha256, previous) of the files under a folder.

    ``state`` is a folder for listings that belongs to one query and is on
    storage that the driver keeps; start the query inside :func:`state.keyed`.
    The listing is made and compared on the driver, contents are read by tasks.
    """
    ship(spark)
    spark.dataSource.register(FolderSource)
    reader = spark.readStream.format("folder_watch").option("state", state)
    seen = (reader if pattern is None else reader.option("pattern", pattern)).load(root)
    return seen.groupBy("rel").transformWithStateInPandas(Contents(), CHANGE, "append", "none")
