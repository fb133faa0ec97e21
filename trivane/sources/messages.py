"""A replayable message log as a Spark stream: files of JSON lines that only grow, read by byte offsets.

Feeds (sensors, brokers that are dumped to storage) arrive as lines ``{"topic": …, "at": seconds, "value": …}`` appended to
files of a folder.  The source is a Python Data Source, so its offsets live in the query's checkpoint: a query that is
started again reads on where it stopped, and a batch that is run again reads the same bytes.  Each file's new bytes are cut
into pieces that tasks read independently.  :func:`readings` turns messages into triples with event time.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from trivane.functions.expressions import as_number

FORMAT = "message_log"
SCHEMA = "topic string, at bigint, value string, line string"
# Bytes of a file that one task reads; lines belong to the piece they begin in.
PIECE_BYTES = 32 << 20
TAIL_BYTES = 1 << 16


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


class Piece(InputPartition):
    """Bytes start to end of a file; a line that begins before the end is read to its own end."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def complete(folder: str) -> dict[str, int]:
    """Bytes up to the last line end, by file name: what no writer will change any more."""
    system, root = _system(folder)
    found = {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
            found[info.base_name] = _last_line_end(system, info.path, info.size)
    return found


def _last_line_end(system: fs.FileSystem, path: str, size: int) -> int:
    with system.open_input_file(path) as file:
        end = size
        while end > 0:
            start = max(0, end - TAIL_BYTES)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def pieces(before: dict[str, int], after: dict[str, int]) -> list[Piece]:
    """The new bytes, cut so that no task reads much."""
    cut = []
    for name, end in sorted(after.items()):
        for start in range(before.get(name, 0), end, PIECE_BYTES):
            cut.append(Piece(name, start, min(start + PIECE_BYTES, end)))
    return cut


def read_piece(folder: str, piece: Piece) -> Iterator[tuple]:
    """The messages of the lines that begin in a piece; a line that is no message has its text only."""
    system, root = _system(folder)
    with io.BufferedReader(system.open_input_file(f"{root}/{piece.path}"), TAIL_BYTES) as file:
        at = piece.start
        if at > 0:
            # The line before may run into this piece, and then belongs to the one before.
            file.seek(at - 1)
            at += len(file.readline()) - 1
        file.seek(at)
        while at < piece.end:
            line = file.readline()
            at += len(line)
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text:
                yield _message(text)


def _message(text: str) -> tuple:
    try:
        made = json.loads(text)
        value = made["value"]
        return str(made["topic"]), int(made["at"]), value if isinstance(value, str) else json.dumps(value), text
    except (ValueError, KeyError, TypeError):
        return None, None, None, text


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self._folder = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return complete(self._folder)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return pieces(start, end)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return read_piece(self._folder, partition)

    def commit(self, end: dict) -> None:
        """The log is kept, so that it can be replayed."""


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._folder = options["path"]

    def partitions(self) -> Sequence[InputPartition]:
        return pieces({}, complete(self._folder))

    def read(self, partition: Piece) -> Iterator[tuple]:
        return read_piece(self._folder, partition)


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as they come: (topic, at, value, line); topic is null where a line is no message."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format(FORMAT).load(folder)


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """All messages there are, as a batch."""
    spark.dataSource.register(MessageLog)
    return spark.read.format(FORMAT).load(folder)


def readings(messages: DataFrame, predicate: str = "reading") -> DataFrame:
    """Timestamped triples (s, p, o, o_num, ts): the topic has the reading; lines that are no messages give none."""
    return messages.filter(F.col("topic").isNotNull()).select(
        F.col("topic").alias("s"),
        F.lit(predicate).alias("p"),
        F.col("value").alias("o"),
        as_number(F.col("value")).alias("o_num"),
        F.col("at").alias("ts"),
    )


def write_messages(messages: DataFrame, folder: str) -> None:
    """Append messages (topic, at, value) to the log: one file per task, never written again."""
    line = F.to_json(F.struct("topic", "at", "value"))
    messages.select(line.alias("value")).write.mode("append").text(folder)
