"""A streaming source that follows many growing files at once, read by executors.

The driver looks only at the files' sizes and at the bytes behind their last line end; what to read is handed out as byte ranges, so
a large backlog or hundreds of files spread over all tasks. A range holds the lines that begin in it, and a line may be of any length. The
offset is, per file, its inode, the byte behind the last whole line, and a checksum of its beginning, as a number may be
given to another file: a restart goes on where the last batch ended. A file that was renamed is read to its end under its new name, its successor from the start; one that shrank is read anew.
The files' folder must be visible to driver and executors alike.

Options: path (a glob pattern), start (`end`, the default, or `begin`) for files that are there when the query first starts; files
that come later are read from their start. line_no is the byte at which a line begins, plus one, so it grows within a file.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range, and of the steps in which line ends are looked for.
RANGE_BYTES, STEP = 32 << 20, 1 << 16
#: Bytes by which a file is known again.
HEAD = 256


@dataclass
class FileRange(InputPartition):
    """Bytes of one file."""

    path: str  # where the bytes are now
    name: str  # the file as it was called when they were written
    first: int
    last: int  # lines that begin before it
    end: int  # the byte behind the last whole line


class TailsSource(DataSource):
    @classmethod
    def name(cls):
        return "audit_tails"

    def schema(self):
        return "file string, line_no long, value string"

    def streamReader(self, schema):  # noqa: N802
        return TailsReader(self.options)


def beginning(path: str, size: int) -> list[int]:
    """[size, checksum of so many bytes]; another size if the file has fewer."""
    with open(path, "rb") as f:
        head = f.read(size)
    return [len(head), zlib.crc32(head)]


def whole_lines(path: str, size: int) -> int:
    """The byte behind the last line end within the first `size` bytes."""
    with open(path, "rb") as f:
        high = size
        while high > 0:
            low = max(0, high - STEP)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return 0


class TailsReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern, self.start, self.range_bytes = options["path"], options.get("start", "end"), int(options.get("rangebytes", RANGE_BYTES))

    def _files(self) -> dict[str, tuple[int, int]]:
        """(inode, size) of each file of the pattern."""
        found = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                stat = os.stat(path)
            except FileNotFoundError:
                continue
            found[path] = (stat.st_ino, stat.st_size)
        return found

    def _whole(self) -> dict:
        found = {}
        for path, (inode, size) in self._files().items():
            try:
                end = whole_lines(path, size)
                found[path] = [inode, end, *beginning(path, min(end, HEAD))]
            except FileNotFoundError:
                continue
        return found

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": self._whole() if self.start == "end" else {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": self._whole()}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        """Ranges between two offsets."""
        before = {inode: (name, byte, head) for name, (inode, byte, *head) in start["files"].items()}
        ranges: list[FileRange] = []
        seen = set()
        for path, (inode, byte, *_) in end["files"].items():
            name, known, head = before.get(inode, (path, 0, [0, 0]))
            if known <= byte and beginning(path, head[0]) == head:
                seen.add(inode)
            else:  # another file, or one that was written anew
                name, known = path, 0
            ranges += self._cut(path, name, known, byte)
        for inode, (name, known, head) in before.items():
            if inode not in seen:  # maybe renamed out of the pattern: what was still to be read is under another name
                moved = self._find(inode, os.path.dirname(name))
                if moved is not None and moved not in end["files"] and beginning(moved, head[0]) == head:
                    ranges += self._cut(moved, name, known, whole_lines(moved, os.path.getsize(moved)))
        return ranges

    def _cut(self, path: str, name: str, first: int, end: int) -> list[FileRange]:
        return [FileRange(path, name, low, min(low + self.range_bytes, end), end) for low in range(first, end, self.range_bytes)] if end > first else []

    @staticmethod
    def _find(inode: int, folder: str) -> str | None:
        with os.scandir(folder or ".") as entries:
            return next((e.path for e in entries if e.is_file() and e.inode() == inode), None)

    def read(self, partition: FileRange) -> Iterator[tuple]:
        p = partition
        with open(p.path, "rb") as f:
            at = p.first
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # a line that began before is the range's before
            else:
                f.seek(0)
            while at < p.last:
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                yield p.name, at + 1, line[:-1].decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass
