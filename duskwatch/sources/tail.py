"""A stream source that follows growing text files by position.

Spark's file stream reads each file once, so lines that are added later never arrive. Here the offset of a batch says, for each file, up to which
byte its whole lines have been handed on. A file is known by its first line, so one that was renamed (rotated) is followed under its new
name, and a new one under an old name is read from its beginning. Half a line waits until its end is written. Reading goes by ranges of
bytes, cut so that a long backlog is spread over tasks, and needs no state besides the offset in the checkpoint.
"""

from __future__ import annotations

import hashlib
import posixpath
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, position bigint, line string"
CHUNK = 1 << 16  # bytes read at once when looking for line ends
SPLIT_BYTES = 32 << 20  # of a file's new lines that one task reads
BATCH_LINES = 5_000

# Workers of a stream source unpickle the reader by itself; it takes its module with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def first_line(store: pafs.FileSystem, path: str, size: int) -> str | None:
    """Digest of a file's first line (of its first bytes if that line is very long); None until there is one."""
    with store.open_input_file(path) as file:
        head = file.read(min(size, CHUNK))
    line, end, _ = head.partition(b"\n")
    if not end and len(head) < CHUNK:
        return None
    return hashlib.sha256(line).hexdigest()


def lines_end(store: pafs.FileSystem, path: str, size: int) -> int:
    """Where the last whole line ends."""
    with store.open_input_file(path) as file:
        while size > 0:
            start = max(0, size - CHUNK)
            file.seek(start)
            at = file.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
    return 0


def files_of(store: pafs.FileSystem, path: str, prefix: str) -> list[tuple[str, int]]:
    """Files (path, size) of a folder whose name begins with ``prefix``, or the file itself and what it was renamed to."""
    info = store.get_file_info(path)
    folder, name = (path, prefix) if info.type == pafs.FileType.Directory else (posixpath.dirname(path), posixpath.basename(path))
    found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.startswith(name))


@dataclass
class LineRange(InputPartition):
    """Lines whose first byte lies in [start, end) of the file with that first line."""

    path: str
    identity: str
    start: int
    end: int
    floor: int  # a line begins here; before the others a line may be cut


def ranges(before: dict, after: dict, split: int) -> list[LineRange]:
    """What to read between two offsets."""
    known: dict[str, list[str]] = {}
    for path, seen in before.items():
        known.setdefault(seen["first"], []).append(path)
    out = []
    for path, now in sorted(after.items()):
        same = known.get(now["first"], [])
        was = path if path in same else next((p for p in same if p not in after or after[p]["first"] != now["first"]), None)
        begin = before[was]["end"] if was is not None else 0
        if begin > now["end"]:
            begin = 0  # cut off and written anew
        out += [LineRange(path, now["first"], a, min(a + split, now["end"]), begin) for a in range(begin, now["end"], split)]
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.prefix = options["path"], options.get("prefix", "")
        self.from_start = options.get("from", "end") == "start"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def _now(self) -> dict:
        store, path = open_store(self.path)
        out = {}
        for name, size in files_of(store, path, self.prefix):
            identity = first_line(store, name, size)
            if identity is not None:
                out[name] = {"first": identity, "end": lines_end(store, name, size)}
        return out

    def initialOffset(self) -> dict:
        return {"files": {} if self.from_start else self._now()}

    def latestOffset(self) -> dict:
        return {"files": self._now()}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        return ranges(start["files"], end["files"], self.split)

    def _open(self, store: pafs.FileSystem, part: LineRange):
        """The file of a range, wherever it has been renamed to since."""
        _, path = open_store(self.path)
        names = [part.path, *(n for n, _ in files_of(store, path, self.prefix) if n != part.path)]
        for name in names:
            info = store.get_file_info(name)
            if info.type == pafs.FileType.File and info.size >= part.end and first_line(store, name, info.size) == part.identity:
                return store.open_input_file(name)
        raise FileNotFoundError(f"{part.path}: lines up to byte {part.end} were announced and are gone")

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        with self._open(store, partition) as file:
            at = partition.start
            rest = b""
            cut = at > partition.floor
            if cut:  # a line that began before belongs to the range before
                at -= 1
            file.seek(at)
            lines: list[tuple[int, str]] = []
            while at < partition.end or rest:
                block = file.read(CHUNK)
                if not block:
                    break
                data = rest + block
                begin = 0
                while (stop := data.find(b"\n", begin)) >= 0:
                    if cut:
                        cut = False
                    elif at < partition.end:
                        lines.append((at, data[begin:stop].decode("utf-8", "replace")))
                    at += stop + 1 - begin
                    begin = stop + 1
                    if at >= partition.end:
                        break
                rest = data[begin:] if at < partition.end else b""
                if len(lines) >= BATCH_LINES or (at >= partition.end and lines):
                    yield self._batch(partition.path, lines)
                    lines = []
            if lines:
                yield self._batch(partition.path, lines)

    def _batch(self, path: str, lines: list[tuple[int, str]]) -> pa.RecordBatch:
        columns = [pa.array([path] * len(lines), pa.string()), pa.array([at for at, _ in lines], pa.int64()), pa.array([line for _, line in lines], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "position", "line"])

    def commit(self, end: dict) -> None:
        return None


class EventTail(DataSource):
    """Options: ``path`` (a file, or a folder), ``prefix`` of file names in a folder, ``from`` (end or start), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "event_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
