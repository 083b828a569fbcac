"""Text files that grow while they are read: a streaming source whose cursor is a byte offset a file."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file that one task reads, and of a look for the last end of a line.
SPLIT, LOOK = 64 << 20, 1 << 16


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole_lines(store: fs.FileSystem, path: str, size: int) -> int:
    """How many of the first ``size`` bytes are whole lines: a line that is still being written is left for later."""
    with store.open_input_file(path) as f:
        end = min(size, f.size())
        while end > 0:
            begin = max(0, end - LOOK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


class _Range(InputPartition):
    """The lines that begin in [begin, end) of a file; ``first`` is where the file's new lines begin and ``last`` where they end."""

    def __init__(self, path: str, first: int, begin: int, end: int, last: int):
        self.path, self.first, self.begin, self.end, self.last = path, first, begin, end, last


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Of each file, where its whole lines end. Sizes are all that is kept, so a restart needs nothing but the checkpoint."""
        store, path = _opened(self.path)
        folder, _, name = path.rpartition("/")
        pattern = any(c in name for c in "*?[")
        at = store.get_file_info(folder if pattern else path)
        found = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder if pattern else path, recursive=not pattern, allow_not_found=True))
        kept = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and (not pattern or fnmatch.fnmatchcase(f.base_name, name))]
        return {f.path: whole_lines(store, f.path, f.size) for f in kept}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """What was added to each file, in ranges; a file that is shorter than it was has been truncated, and is read from its start."""
        out = []
        for path, last in sorted(end.items()):
            first = start.get(path, 0)
            first = 0 if last < first else first
            out += [_Range(path, first, b, min(b + SPLIT, last), last) for b in range(first, last, SPLIT)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        with store.open_input_file(partition.path) as f:
            at = partition.begin
            if at > partition.first:  # the line that begins before belongs to the range before
                at -= 1
                f.seek(at)
                at += len(self._line(f, partition.last - at))
            f.seek(at)
            rest = b""
            while at < partition.end:
                while b"\n" not in rest:
                    more = f.read(min(LOOK, partition.last - at - len(rest)))
                    if not more:
                        return  # truncated since
                    rest += more
                *lines, rest = rest.split(b"\n")
                for line in lines:
                    if at >= partition.end:
                        return
                    yield partition.path, at, line.decode("utf-8", "replace")
                    at += len(line) + 1

    @staticmethod
    def _line(f, most: int) -> bytes:
        parts = []
        while most > 0 and (more := f.read(min(LOOK, most))):
            end = more.find(b"\n")
            if end >= 0:
                return b"".join([*parts, more[: end + 1]])
            parts.append(more)
            most -= len(more)
        return b"".join(parts)

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files").option("path", p)``: (path, offset, line) of each line once it is whole. ``p`` is a
    file, a folder with all below it, or a folder with a pattern of names."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def growing(spark: SparkSession, path: str):
    """The stream of lines that are added to files; ``offset`` is the byte at which a line begins."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", path).load()
