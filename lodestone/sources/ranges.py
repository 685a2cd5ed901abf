"""A data source of text files read in ranges of bytes.

A line belongs to the range in which it begins, so a file of any size is read by many tasks,
each of which knows the place of its lines within its range; with the numbers of lines of the
ranges before, that gives line numbers. Compressed files can't be entered in the middle and
are one range each, read as a stream.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, start long, pos long, line string"
RANGE, ROWS = 64 << 20, 20_000


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def lines_of(record: bytes) -> list[str]:
    """The lines of what stands before a line feed: a carriage return ends one too. Bytes that are no UTF-8 are replaced."""
    return record.removesuffix(b"\r").decode("utf-8", "replace").split("\r")


class TextRanges(DataSource):
    """Options: ``path``, a file or a folder with all below it; ``range``, bytes of a range; ``suffix`` of the files read."""

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)), self.options.get("suffix", ""))


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int, suffix: str) -> None:
        self.path, self.size, self.suffix = path, size, suffix

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Range]:
        files, top = self._files()
        info = files.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(top, recursive=True))
        named = [x for x in found if x.type == fs.FileType.File and x.path.endswith(self.suffix) and not x.base_name.startswith(("_", "."))]
        return [Range(x.path, i, i + self.size) for x in named for i in ([0] if x.path.endswith(".gz") else range(0, max(1, x.size), self.size))] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[str] = []
        pos = 0

        def out() -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([part.start] * n, pa.int64()), pa.array(range(pos - n, pos), pa.int64()), pa.array(rows, pa.string())], names=["path", "start", "pos", "line"])

        for record in self._records(part) if part.path else ():
            found = lines_of(record)
            rows += found
            pos += len(found)
            if len(rows) >= ROWS:
                yield out()
                rows = []
        yield out()

    def _records(self, part: Range) -> Iterator[bytes]:
        """What stands before each line feed, of the records that begin in the range."""
        files, _ = self._files()
        if part.path.endswith(".gz"):
            with files.open_input_file(part.path) as raw, gzip.open(raw) as stream:
                for record in stream:
                    yield record.removesuffix(b"\n")
            return
        with files.open_input_file(part.path) as raw:
            at = part.start
            if at:
                raw.seek(at - 1)
                at += self._skip(raw) - 1
            rest, begins = b"", at
            while begins < part.end:
                block = raw.read(1 << 20)
                if not block:
                    if rest:
                        yield rest
                    return
                *whole, rest = (rest + block).split(b"\n")
                for record in whole:
                    if begins >= part.end:
                        return
                    yield record
                    begins += len(record) + 1

    @staticmethod
    def _skip(raw) -> int:
        """Go past the next line feed; the bytes passed."""
        passed = 0
        while block := raw.read(1 << 16):
            at = block.find(b"\n")
            if at >= 0:
                raw.seek(raw.tell() - len(block) + at + 1)
                return passed + at + 1
            passed += len(block)
        return passed
