"""The byte container as a Spark data source, `blockarchive`: block rows out of archives, and archives out of block rows.

Reading: the driver walks headers only, and checks them; each task takes blocks of some bytes (option
partitionBytes) and seeks to their payloads. Filters on block_index are pushed down, so that a range of
blocks can be read alone. An archive with the stream pass holds blocks of a collapsed stream, which is
refused unless the option `collapsed` asks for them. Writing: tasks put their blocks into parts beside the
target; the commit joins them in order, a piece at a time, and renames the result. Options `directory`, and
`stream` (collapsed size, checksum, slot bits) with `originalSize`, go into the header. Paths are local or on
a file system mounted alike on all machines.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..codec import FormatError, container

SCHEMA = "block_index long, mode long, lzp boolean, original_size long, payload_size long, primary_index long, intermediate_size long, checksum long, payload binary"


@dataclass
class _Range(InputPartition):
    heads: list


class _Reader(DataSourceReader):
    def __init__(self, path: str, bytes_: int, collapsed: bool) -> None:
        self.path, self.bytes, self.collapsed, self.least, self.most = path, bytes_, collapsed, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("block_index",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    bound = f.value - isinstance(f, LessThan)
                    self.most = bound if self.most is None else min(self.most, bound)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as file:

            def read(place: int, n: int) -> bytes:
                file.seek(place)
                return file.read(n)

            index = container.index(read, os.path.getsize(self.path))
        if index.stream and not self.collapsed:
            raise FormatError("blocks of this archive join to a collapsed stream; read it whole, or with the option collapsed")
        heads = index.heads if self.most is None else index.heads[: self.most + 1]
        out, held, size = [], [], 0
        for number in range(self.least, len(heads)):
            held.append((number, heads[number]))
            size += heads[number].payload_size
            if size >= self.bytes:
                out.append(_Range(held))
                held, size = [], 0
        return [*out, _Range(held)] if held or not out else out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            for number, h in partition.heads:
                file.seek(h.place)
                yield number, h.mode, h.lzp, h.original_size, h.payload_size, h.primary_index, h.intermediate_size, h.checksum, file.read(h.payload_size)


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: list


class _Writer(DataSourceWriter):
    def __init__(self, path: str, block_size: int, directory: bool, original_size: int, stream: container.StreamHeader | None) -> None:
        self.path, self.block_size, self.directory, self.original_size, self.stream = path, block_size, directory, original_size, stream

    def write(self, rows: Iterator) -> _Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        path, found = f"{self.path}.part.{context.partitionId()}.{context.taskAttemptId()}", []
        with open(path, "wb") as file:
            for r in rows:
                payload = bytes(r.payload)
                found.append((r.block_index, file.tell(), container.HEADER_BYTES + len(payload), r.original_size))
                file.write(container.pack_block_header(r.mode, r.lzp, r.original_size, len(payload), r.primary_index, r.intermediate_size, r.checksum) + payload)
        return _Part(path, found)

    def commit(self, messages: list) -> None:
        parts = [m for m in messages if m is not None]
        order = sorted((index, m.path, place, length, size) for m in parts for index, place, length, size in m.rows)
        if [o[0] for o in order] != list(range(len(order))):
            self.abort(messages)
            raise FormatError("blocks are missing or doubled")
        size = sum(o[4] for o in order) if self.stream is None else self.original_size
        staging = f"{self.path}.tmp.{uuid.uuid4().hex}"
        with open(staging, "wb") as out:
            out.write(container.pack_file_header(self.block_size, size, len(order), self.directory, self.stream))
            for _, path, place, length, _ in order:
                with open(path, "rb") as file:
                    file.seek(place)
                    for at in range(0, length, 1 << 20):
                        out.write(file.read(min(1 << 20, length - at)))
        os.replace(staging, self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class BlockArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockarchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partitionBytes", 32 << 20)), self.options.get("collapsed", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        stream = self.options.get("stream")
        header = container.StreamHeader(*map(int, stream.split(","))) if stream else None
        return _Writer(self.options["path"], int(self.options["blockSize"]), self.options.get("directory", "false").lower() == "true", int(self.options.get("originalSize", -1)), header)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; with pushdown, so that block ranges are read alone."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockArchive)
