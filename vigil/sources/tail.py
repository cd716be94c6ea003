"""Streaming source `tail`: complete lines that are appended to log files, read by the executors in bounded ranges of bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of all files in one batch, and of one file in one task, unless options say otherwise.
BATCH_BYTES, PARTITION_BYTES = 256 << 20, 32 << 20
_STEP = 1 << 16


def read_new(path: str, start: int) -> tuple[list[tuple[str, str]], int]:
    """Whole lines behind a byte offset, and the offset behind the last of them. An unfinished line waits; blank lines and carriage
    returns are dropped; a file that is shorter than the offset is read from its beginning; a missing one has no lines."""
    try:
        size = os.path.getsize(path)
    except OSError:
        return [], start
    begin = start if start <= size else 0
    end = whole_lines(path, begin, size, size - begin)
    return list(read_range(path, begin, begin, end)), end


def whole_lines(path: str, start: int, size: int, most: int) -> int:
    """The offset behind the last whole line that ends within `most` bytes from start; a first line that is longer is taken whole if it is
    complete. start if no line is."""
    with open(path, "rb") as f:
        at = min(size, start + most)
        while at > start:
            low = max(start, at - _STEP)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
        at = min(size, start + most)
        f.seek(at)
        while at < size and (part := f.read(min(_STEP, size - at))):
            if (found := part.find(b"\n")) >= 0:
                return at + found + 1
            at += len(part)
    return start


def read_range(path: str, first: int, start: int, end: int) -> Iterator[tuple[str, str]]:
    """Lines that begin in start to end; first: where the first line of all ranges begins."""
    try:
        f = open(path, "rb")
    except OSError:
        return
    with f:
        at = start
        if start > first:  # a line that began before belongs to the range before
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        f.seek(at)
        while at < end and (line := f.readline()):
            at += len(line)
            text = line.rstrip(b"\n").rstrip(b"\r").decode(errors="replace")
            if text.strip():
                yield text, path


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    start: int
    end: int

    def __init__(self, path: str, first: int, start: int, end: int):
        super().__init__((path, start))
        self.path, self.first, self.start, self.end = path, first, start, end


def _inode(path: str) -> int:
    try:
        return os.stat(path).st_ino
    except OSError:
        return 0


class _TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.paths = [p.strip() for p in options.get("paths", options.get("path", "")).split(",") if p.strip()]
        self.most, self.part = int(options.get("maxBytesPerBatch", BATCH_BYTES)), int(options.get("bytesPerPartition", PARTITION_BYTES))
        self.seen: dict | None = None  # the last offsets that are known here

    def initialOffset(self) -> dict:
        return {p: {"at": 0, "inode": 0} for p in self.paths}

    def latestOffset(self) -> dict:
        """Behind whole lines, so many bytes further at most. A query that starts anew asks this first; one that starts again has its last
        batch planned before, which tells where it stood."""
        left, out = self.most, {}
        for p in self.paths:
            was = (self.seen or {}).get(p, {"at": 0, "inode": 0})
            try:
                now = os.stat(p)
            except OSError:
                out[p] = was
                continue
            at = was["at"] if was["inode"] in (0, now.st_ino) and was["at"] <= now.st_size else 0  # another file, or a shorter one
            end = whole_lines(p, at, now.st_size, left) if left > 0 else at
            left -= end - at
            out[p] = {"at": end, "inode": now.st_ino}
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = end
        out: list[InputPartition] = []
        for p in self.paths:
            a, b = start.get(p, {"at": 0, "inode": 0}), end.get(p, {"at": 0, "inode": 0})
            begin = a["at"]
            if a["inode"] not in (0, b["inode"]):  # rotated: the rest of the old file first, if it still lies beside the new one
                old = self._moved(p, a["inode"])
                if old:
                    size = os.path.getsize(old)
                    out += self._ranges(old, a["at"], whole_lines(old, a["at"], size, size))
                begin = 0
            out += self._ranges(p, begin if begin <= b["at"] else 0, b["at"])
        return out

    def _ranges(self, path: str, first: int, end: int) -> list[InputPartition]:
        return [_Range(path, first, x, min(end, x + self.part)) for x in range(first, end, self.part)]

    @staticmethod
    def _moved(path: str, inode: int) -> str | None:
        folder = os.path.dirname(path) or "."
        names = os.listdir(folder) if os.path.isdir(folder) else []
        return next((os.path.join(folder, n) for n in sorted(names) if n.startswith(os.path.basename(path)) and _inode(os.path.join(folder, n)) == inode), None)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_range(partition.path, partition.first, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        """Offsets live in the query's checkpoint."""


class TailSource(DataSource):
    """Rows value and source_file. Options: `paths` (files, comma-separated, that driver and executors see under the same names),
    `maxBytesPerBatch`, `bytesPerPartition`.

    The driver looks for line ends alone; executors read the lines, each in a range of bytes of its own. A file that was truncated is read
    from its beginning; of one that was rotated (told by its inode) the rest is read first, where it lies beside the new one under a longer
    name. At-least-once: replays are exact while the files still hold the bytes."""

    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return "value string, source_file string"

    def streamReader(self, schema):
        return _TailReader(self.options)
