"""Mails of mbox files as a Spark data source: byte ranges, parted at whole envelope lines only."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: how an envelope line starts; a body line that merely begins with From has no weekday and month.
ENVELOPE = re.compile(rb"From \S+ (?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) [A-Z][a-z][a-z] +\d")
#: Bytes of a file that one task takes the mails of.
RANGE = 64 << 20


def split_mbox(lines: Iterator[bytes], start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """The mails whose envelope line starts in [start, end) of a file read by lines from `start` on; the last one is read to its end."""
    at, mail = start, []
    for line in lines:
        if ENVELOPE.match(line):
            if mail:
                yield b"".join(mail)
                mail = []
            if end is not None and at >= end:
                return
            mail.append(line)
        elif mail:
            mail.append(line)
        elif end is not None and at >= end:
            return
        at += len(line)
    if mail:
        yield b"".join(mail)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        system, path = self._system()
        top = system.get_file_info(path)
        files = [top] if top.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file]
        return [_Range(f.path, at, min(at + self.size, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.size)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.path:
            return
        system, _ = self._system()
        with system.open_input_file(part.path) as raw, io.BufferedReader(raw, 1 << 20) as file:
            at = part.start
            if at:
                # a line belongs to the range that its first byte is in
                file.seek(at - 1)
                at += len(file.readline()) - 1
            for mail in split_mbox(file, at, part.end):
                yield part.path.rpartition("/")[2], mail


class MboxSource(DataSource):
    """Format `mbox`: option path (file or folder) and range (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return "origin string, raw binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


def raw_mails(spark: SparkSession, path: str, size: int = RANGE):
    """(origin, raw) of every mail of the mbox file or folder at path."""
    spark.dataSource.register(MboxSource)
    return spark.read.format("mbox").option("range", size).load(path)
