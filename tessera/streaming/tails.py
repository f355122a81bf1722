"""A streaming source that follows a growing log file: whole lines only, from the start again when the file was cut."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "start long, line string"
#: Bytes of one task, and of the file's beginning by which a new file is told from the old one.
CHUNK, HEAD = 1 << 22, 64


class Piece(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class LogTail(DataSource):
    """format("log_tail").option("path", ...): start (byte place) and line of every whole line. The path is a file that the driver and all
    executors see. Register it with spark.dataSource.register(LogTail)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTailReader(self.options["path"])


class LogTailReader(DataSourceStreamReader):
    """An offset is the place behind the last line break and the file's first bytes. Between two offsets lies what stands between their
    places; if the later one is smaller, or the beginning is another, the file was cut or replaced, and all of it is new.

    A file that was cut and has grown beyond the old place with the same first bytes cannot be told from one that has only grown.
    """

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"at": 0, "head": ""}

    def latestOffset(self) -> dict:
        if not os.path.exists(self.path):
            return self.initialOffset()
        with open(self.path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at:
                start = max(0, at - CHUNK)
                f.seek(start)
                found = f.read(at - start).rfind(b"\n")
                if found >= 0:
                    f.seek(0)
                    return {"at": start + found + 1, "head": f.read(min(HEAD, start + found + 1)).hex()}
                at = start
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        same = end["at"] >= start["at"] and end["head"].startswith(start["head"])
        first = start["at"] if same else 0
        return [Piece(at, min(at + CHUNK, end["at"])) for at in range(first, end["at"], CHUNK)]

    def read(self, partition: Piece) -> Iterator[tuple[int, str]]:
        """Lines that begin in the piece; the last of them may end behind it."""
        with open(self.path, "rb") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of a line that began before
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)
