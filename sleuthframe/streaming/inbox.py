"""A drop folder as a streaming data source that takes a file only when it has stopped growing.

An entry of the folder is a loose file or a folder of its own, which is a case.  A scan lists
sizes and times; an entry whose listing is the same in two scans, ``settle`` seconds apart, has
settled, and what is new in it is taken.  What has been taken is kept in a log of small files,
one a batch, beside the folder (or at ``log``): the offset of the stream is the number of the
last one.  So a batch that is planned again after a failure reads the same files, a restart
reads nothing twice, and the offset stays one number however many files there are.

A file counts as new again if its size or time of change has altered since it was taken.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import fixed

SCHEMA = "path string, name string, case_name string, modificationTime timestamp, length long, content binary"
#: Bytes of files that one task reads; larger files are given without content, for readers that split them.
TASK_BYTES, MOST_CONTENT = 128 << 20, 1 << 30
LOOSE = "inbox"


@dataclass(frozen=True)
class Dropped:
    """A file of the folder: its path below it, size, and time of change in nanoseconds."""

    path: str
    size: int
    changed: int

    @property
    def case(self) -> str:
        return self.path.split("/", 1)[0] if "/" in self.path else LOOSE

    @property
    def entry(self) -> str:
        return self.path.split("/", 1)[0]


def ignored(path: str) -> bool:
    """Whether a file of the folder is to be left alone, by any part of its path: notes, dotfiles, partial copies."""
    return any(p in fixed.INBOX_IGNORED_NAMES or p.startswith(".") or p.lower().endswith(tuple(fixed.INBOX_IGNORED_SUFFIXES)) for p in path.split("/"))


def settled(before: Sequence[Dropped], now: Sequence[Dropped]) -> list[Dropped]:
    """Files of the entries that are the same in both scans."""
    entries: list[dict[str, set[Dropped]]] = [{}, {}]
    for scan, out in zip((before, now), entries, strict=True):
        for f in scan:
            out.setdefault(f.entry, set()).add(f)
    return [f for f in now if entries[0].get(f.entry) == entries[1][f.entry]]


@dataclass
class _Files(InputPartition):
    files: list[Dropped]


class InboxSource(DataSource):
    """Format ``inbox``; options: path, settle (seconds), log, archive, content (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return InboxReader(dict(self.options))


class InboxReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        from pyarrow.fs import FileSystem

        path = options["path"]
        self.fs, self.root = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.root = self.root.rstrip("/")
        self.settle = float(options.get("settle", 2))
        self.log = self._below(options.get("log")) or f"{self.root}/.taken"
        self.archive = self._below(options.get("archive"))
        self.content = options.get("content", "true").lower() == "true"
        self.before: tuple[float, list[Dropped]] | None = None
        self.taken: set[Dropped] | None = None
        self.last = 0

    @staticmethod
    def _below(path: str | None) -> str | None:
        return path.removeprefix("file:").replace("///", "/").rstrip("/") if path else None

    # --- scans ---

    def scan(self) -> list[Dropped]:
        from pyarrow.fs import FileSelector, FileType

        found = self.fs.get_file_info(FileSelector(self.root, recursive=True, allow_not_found=True))
        files = [Dropped(i.path.removeprefix(self.root).lstrip("/"), i.size, i.mtime_ns or 0) for i in found if i.type == FileType.File]
        return sorted((f for f in files if not ignored(f.path)), key=lambda f: f.path)

    # --- the log ---

    def _entry(self, number: int) -> str:
        return f"{self.log}/{number:012d}.json"

    def _logged(self, number: int) -> list[Dropped]:
        with self.fs.open_input_file(self._entry(number)) as f:
            return [Dropped(*x) for x in json.loads(f.read())]

    def _append(self, files: list[Dropped]) -> None:
        """The next entry of the log; it is there whole or not at all."""
        self.fs.create_dir(self.log, recursive=True)
        draft = f"{self.log}/.draft"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps([[x.path, x.size, x.changed] for x in files]).encode())
        self.fs.move(draft, self._entry(self.last + 1))
        self.last += 1
        self.taken.update(files)

    def _load(self) -> None:
        from pyarrow.fs import FileSelector

        names = sorted(i.base_name for i in self.fs.get_file_info(FileSelector(self.log, allow_not_found=True)) if i.base_name.endswith(".json"))
        self.last = int(names[-1][:-5]) if names else 0
        self.taken = {f for n in names for f in self._logged(int(n[:-5]))}

    # --- the stream ---

    def initialOffset(self) -> dict:
        return {"taken": 0}

    def latestOffset(self) -> dict:
        if self.taken is None:
            self._load()
        if self.before is None:
            self.before = (time.monotonic(), self.scan())
        wait = self.settle - (time.monotonic() - self.before[0])
        if wait > 0:
            time.sleep(wait)
        now = (time.monotonic(), self.scan())
        new = [f for f in settled(self.before[1], now[1]) if f not in self.taken]
        self.before = now
        if new:
            self._append(new)
        return {"taken": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = [f for n in range(start["taken"] + 1, end["taken"] + 1) for f in self._logged(n)]
        out: list[InputPartition] = []
        size = 0
        for f in files:
            if not out or size + f.size > TASK_BYTES:
                out.append(_Files([]))
                size = 0
            out[-1].files.append(f)
            size += f.size
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        for f in partition.files:
            path = f"{self.root}/{f.path}"
            body = None
            if self.content and f.size <= MOST_CONTENT:
                with self.fs.open_input_file(path) as stream:
                    body = stream.read(f.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([f.path.rsplit("/", 1)[-1]]), pa.array([f.case]), pa.array([f.changed // 1000], pa.timestamp("us", "UTC")), pa.array([f.size], pa.int64()), pa.array([body], pa.binary())],
                names=["path", "name", "case_name", "modificationTime", "length", "content"],
            )

    def commit(self, end: dict) -> None:
        """Batches up to ``end`` are done: their files go to the archive, if there is one; how far it has come stands beside the log."""
        if self.archive is None:
            return
        marker = f"{self.log}/.archived"
        done = 0
        if self.fs.get_file_info(marker).is_file:
            with self.fs.open_input_file(marker) as f:
                done = int(f.read())
        for f in [f for n in range(done + 1, end["taken"] + 1) for f in self._logged(n)]:
            source, target = f"{self.root}/{f.path}", f"{self.archive}/{f.path}"
            if self.fs.get_file_info(source).is_file:
                self.fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                self.fs.move(source, target)
        with self.fs.open_output_stream(marker) as out:
            out.write(str(max(done, end["taken"])).encode())
