"""Live capture: messages of a socket to numbered files, and a stream over them that can be read again from any message."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Files are named by their first message's number and how many they hold.
_NAME = re.compile(r"(\d{15})-(\d{9})\.log$")


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def captured_files(folder: str) -> list[tuple[int, int, str]]:
    """(first, count, path) of each finished file in order; raises if messages are missing between two."""
    system, path = _at(folder)
    found = []
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if name := _NAME.search(info.path):
            found.append((int(name[1]), int(name[2]), info.path))
    found.sort()
    for (first, count, _), (following, *_) in zip(found, found[1:]):
        if first + count != following:
            raise ValueError(f"messages {first + count} to {following - 1} are missing in {folder}")
    return found


def captured(folder: str) -> int:
    """How many messages there are."""
    files = captured_files(folder)
    return sum(files[-1][:2]) if files else 0


def capture(messages: Iterable[str], folder: str, per_file: int = 1000, now: Callable[[], int] = time.time_ns) -> int:
    """Writes messages (what a socket gives, one after another) as lines ``received_ns||message`` and returns how many.

    A file appears under its name when it is whole, so that a reader never sees part of one; capturing again goes on with the
    next number. What was received but not yet written when a capture breaks off is lost to it, as it is for any socket.
    """
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    at = begin = captured(folder)
    source = iter(messages)
    while lines := [f"{now()}||{m}" for m in islice(source, per_file)]:
        if any("\n" in x for x in lines):
            raise ValueError("a message holds a line break")
        name = f"{path}/{at:015d}-{len(lines):09d}.log"
        with system.open_output_stream(f"{name}.open") as out:
            out.write("".join(f"{x}\n" for x in lines).encode())
        system.move(f"{name}.open", name)
        at += len(lines)
    return at - begin


class _Reader(DataSourceStreamReader):
    """Offsets are numbers of messages; a partition is the part of one file that lies between two."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"message": 0}

    def latestOffset(self) -> dict:
        return {"message": captured(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = start["message"], end["message"]
        parts = [(path, first, max(lo, first), min(hi, first + count)) for first, count, path in captured_files(self.folder)]
        return [InputPartition(p) for p in parts if p[2] < p[3]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, first, lo, hi = partition.value
        with _at(self.folder)[0].open_input_stream(path) as f:
            lines = f.read().decode().split("\n")
        yield from ((number, lines[number - first]) for number in range(lo, hi))


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_messages"

    def schema(self) -> str:
        return "message long, value string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["folder"])


def live(spark: SparkSession, folder: str) -> DataFrame:
    """message (its number) and value (the line) of what is captured in a folder that driver and executors share, as a stream.

    A query that starts again from its checkpoint goes on behind the last message that it handled, and a micro-batch that is
    run again reads the same messages. ``market_data.parse_log`` makes trades of the lines.
    """
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("captured_messages").option("folder", folder).load()
