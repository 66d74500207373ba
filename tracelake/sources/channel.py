"""A channel of numbered records as a streaming source with a cursor.

A channel is a folder of append-only segments of JSON lines with ascending ``record_id``s; a segment's name is its first
record's number. The offset of a batch is a cursor: the last record's number and the SHA-256 of its line. Spark stores it with the
query, before what the batch writes counts as done, so a restart goes on behind the last batch that was accepted, and a batch that is
refused is read again.

A cursor is checked against the channel before anything behind it is read. If its record is gone or has another hash, or the channel's
last number is smaller, the channel was reset (cleared, or numbered anew) and is read from its begin; if the records behind it don't
follow on, some were lost. In both cases the first record of the batch has ``gap``, which collectors count.

Segments are read by the executors, a partition each, through any file system that pyarrow knows; the driver reads the last lines
of one segment and the one that holds the cursor.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "event_channel"
SCHEMA = "record_id long, raw string, gap boolean"
#: Bytes read from the end of a segment at first when its last line is looked for.
TAIL = 1 << 16
START = {"record_id": 0, "sha256": ""}


class Segment(InputPartition):
    def __init__(self, name: str, after: int, upto: int, gap_at: int | None, before: int | None):
        super().__init__(name)
        self.name, self.after, self.upto, self.gap_at, self.before = name, after, upto, gap_at, before


def number_of(line: bytes) -> int:
    found = json.loads(line)["record_id"]
    if type(found) is not int or found < 1:
        raise ValueError("a record's number must be a whole number above 0")
    return found


class Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self.open()

    def open(self) -> None:
        self.files, self.at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def __getstate__(self) -> dict:
        return {"path": self.path}

    def __setstate__(self, state: dict) -> None:
        self.path = state["path"]
        self.open()

    def segments(self) -> list[tuple[int, str]]:
        found = self.files.get_file_info(fs.FileSelector(self.at, allow_not_found=True))
        return sorted((int(f.base_name.removesuffix(".jsonl")), f.path) for f in found if f.base_name.removesuffix(".jsonl").isdigit() and f.size)

    def lines(self, name: str) -> Iterator[bytes]:
        """The whole lines of a segment; one that is still being written counts when its line feed is there."""
        rest = b""
        with self.files.open_input_stream(name) as f:
            while data := f.read(1 << 20):
                *whole, rest = (rest + data).split(b"\n")
                yield from (x for x in whole if x.strip())

    def last_line(self, name: str) -> bytes | None:
        with self.files.open_input_file(name) as f:
            size, take = f.size(), TAIL
            while True:
                f.seek(max(0, size - take))
                whole = f.read(take).split(b"\n")
                whole = [x for x in (whole[:-1] if take >= size else whole[1:-1]) if x.strip()]
                if whole or take >= size:
                    return whole[-1] if whole else None
                take *= 2

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        for _, name in reversed(self.segments()):
            if line := self.last_line(name):
                return {"record_id": number_of(line), "sha256": hashlib.sha256(line).hexdigest()}
        return START

    def holds(self, cursor: dict) -> bool:
        """Whether the cursor's record is in the channel as it was."""
        there = [name for first, name in self.segments() if first <= cursor["record_id"]]
        return bool(there) and any(number_of(x) == cursor["record_id"] and hashlib.sha256(x).hexdigest() == cursor["sha256"] for x in self.lines(there[-1]))

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        fresh = start["record_id"] == 0
        reset = not fresh and (end["record_id"] < start["record_id"] or not self.holds(start))
        after = 0 if reset else start["record_id"]
        segments = self.segments()
        wanted = [(first, name) for i, (first, name) in enumerate(segments) if first <= end["record_id"] and (i + 1 == len(segments) or segments[i + 1][0] > after + 1)]
        first = next((n for _, name in wanted for n in map(number_of, self.lines(name)) if n > after), None)
        gap = reset or (not fresh and first is not None and first > after + 1)
        ends = [number_of(x) if (x := self.last_line(name)) else None for _, name in wanted[:-1]]
        return [Segment(name, after, end["record_id"], first if gap else None, before) for (_, name), before in zip(wanted, [None, *ends])]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str, bool]] = []
        before = partition.before
        schema = pa.schema([("record_id", pa.int64()), ("raw", pa.string()), ("gap", pa.bool_())])
        for line in self.lines(partition.name):
            n = number_of(line)
            if partition.after < n <= partition.upto:
                # Numbers that are missing within a batch are lost as well.
                lost = n == partition.gap_at or (before is not None and n > max(before, partition.after) + 1)
                rows.append((n, line.rstrip(b"\r").decode(), lost))
                before = n
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def commit(self, end: dict) -> None:
        pass  # segments are the channel's own; nothing is deleted


class ChannelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"])


def read_channel(spark: SparkSession, path: str) -> DataFrame:
    """The records of a channel as a stream of lines for ``events.parsed``: the channel stands for the source, a record's number for its line."""
    spark.dataSource.register(ChannelSource)
    rows = spark.readStream.format(FORMAT).option("path", path).load()
    return rows.select(F.sha2(F.lit(path), 256).alias("source_sha256"), F.col("record_id").alias("source_line"), "raw", "gap")
