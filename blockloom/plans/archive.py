"""Whole archives: files and folders to containers and back, archives as rows, checks and statistics."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kernels
from ..codec import FormatError, container, tree
from ..functions import columns as c
from ..operators import stages


@contextmanager
def replaced(target: str, directory: bool = False) -> Iterator[str]:
    """A sibling path to write to; it takes the target's place at the end, or goes if anything fails. A folder is put in place by itself."""
    if os.path.lexists(target) and (directory or not os.path.isfile(target)):
        raise ValueError(f"{target} exists" if directory else f"{target} is not a regular file")
    staging = f"{target}.tmp.{uuid.uuid4().hex}"
    try:
        yield staging
        if not directory:
            os.replace(staging, target)
    except BaseException:
        with suppress(FileNotFoundError):
            os.remove(staging)
        raise


def refuse_same(source: str, target: str) -> None:
    if os.path.abspath(source) == os.path.abspath(target) or (os.path.exists(target) and os.path.samefile(source, target)):
        raise ValueError("input and output are the same")


# --- files ---


def _stored(source: str, staging: str) -> tuple[str, int, bool]:
    """(path, size, whether it is a folder) of what is to be coded; a folder's tar stream is written to `staging`."""
    if not os.path.isdir(source):
        return source, os.path.getsize(source), False
    tree.write_tree(source, staging)
    return staging, os.path.getsize(staging), True


def _file_blocks(spark: SparkSession, path: str, size: int, block_size: int) -> DataFrame:
    """The blocks of a file that all machines see, each read by the task that codes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as file:
            for batch in batches:
                for number in batch.column("block_index").to_pylist():
                    file.seek(number * block_size)
                    part = file.read(block_size)
                    if len(part) != min(block_size, size - number * block_size):
                        raise OSError("input changed while it was read")
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([number], pa.int64()), pa.array([part], pa.binary())], ["stream", "block_index", "bytes"])

    count = container.block_count(size, block_size)
    numbers = spark.range(0, count, 1, max(1, count)).withColumnRenamed("id", "block_index")
    return numbers.mapInArrow(run, "stream long, block_index long, bytes binary")


def _collapsed(spark: SparkSession, path: str, size: int) -> DataFrame:
    """One row (short, checksum) of a file of STREAM_MOST bytes at most, in one task; short is null where nothing is gained."""
    whole = kernels.ready(_file_blocks(spark, path, size, max(1, size)))
    return whole.select(kernels.collapse("bytes", container.slot_bits(size)).alias("short"), kernels.checksum("bytes").alias("checksum"))


def _coded_part(blocks: DataFrame, path: str) -> int:
    """Writes coded blocks with their headers, in order, to a part file; returns its bytes. One task's blocks at a time are at hand."""
    coded = stages.with_coded(blocks).select("block_index", *stages.FIELDS)
    with open(path, "wb") as out:
        for row in coded.toLocalIterator(prefetchPartitions=True):  # partitions are in the order of blocks
            out.write(container.pack_block_header(row.mode, row.lzp, row.original_size, row.payload_size, row.primary_index, row.intermediate_size, row.checksum))
            out.write(row.payload)
    return os.path.getsize(path)


def compress_file(spark: SparkSession, source: str, target: str, block_size: int | None = None, profile: str = "default") -> dict:
    """Writes the archive of a file or a folder; returns its statistics.

    Tasks read the blocks they code; the driver has a few coded blocks at a time, on their way to the target.
    The stream-wide pass is one task's work, for inputs of STREAM_MOST bytes at most.
    """
    began = time.time()
    if not os.path.exists(source):
        raise FileNotFoundError(source)
    refuse_same(source, target)
    with replaced(target) as staging, tempfile.TemporaryDirectory(prefix=f"{os.path.basename(target)}.tmp.", dir=os.path.dirname(os.path.abspath(target))) as folder:
        path, size, directory = _stored(source, os.path.join(folder, "tree"))
        block = container.choose_block_size(size, block_size, profile)
        plain, passed, stream = (os.path.join(folder, name) for name in ("plain", "passed", "stream"))
        kept, decisive, header = False, False, None
        if block < size <= container.STREAM_MOST:
            row = _collapsed(spark, path, size).first()
            if row.short is not None:
                with open(stream, "wb") as out:
                    out.write(row.short)
                short = len(row.short)
                header = container.StreamHeader(short, row.checksum, container.slot_bits(size))
                del row
                with_pass = _coded_part(_file_blocks(spark, stream, short, block), passed)
                sizes = spark.range(1).select(*(F.lit(x).alias(n) for n, x in (("n", size), ("short", short), ("a", with_pass))))
                decisive = kept = sizes.select(c.stream_pass_decisive(F.col("n"), F.col("short"))).first()[0]
        if not decisive:
            without = _coded_part(_file_blocks(spark, path, size, block), plain)
            if header:
                kept = sizes.select(c.stream_pass_kept(F.col("n"), F.col("short"), F.col("a"), F.lit(without))).first()[0]
        if os.path.getsize(path) != size:
            raise OSError("input changed while it was read")
        count = container.block_count(header.coded_size if kept else size, block)
        with open(staging, "wb") as out, open(passed if kept else plain, "rb") as body:
            out.write(container.pack_file_header(block, size, count, directory, header if kept else None))
            shutil.copyfileobj(body, out, 1 << 20)
        with open(staging, "rb") as file:
            heads = _index(file).heads
        written = os.path.getsize(staging)
    return statistics(size, written, count, sum(h.mode == 0 for h in heads), time.time() - began)


def _index(file) -> container.Index:
    def read(place: int, n: int) -> bytes:
        file.seek(place)
        return file.read(n)

    return container.index(read, os.fstat(file.fileno()).st_size)


def _payloads(spark: SparkSession, path: str, index: container.Index) -> DataFrame:
    """The blocks table of an archive that all machines see; each payload is read by the task that decodes it."""
    names = ["mode", "lzp", "original_size", "payload_size", "primary_index", "intermediate_size", "checksum", "place"]
    heads = [(0, i, *(getattr(h, n) for n in names)) for i, h in enumerate(index.heads)]
    schema = "stream long, block_index long, mode long, lzp boolean, original_size long, payload_size long, primary_index long, intermediate_size long, checksum long, place long"
    rows = spark.createDataFrame(heads, schema).repartitionByRange(max(1, len(heads)), "block_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as file:
            for batch in batches:
                for i, (place, size) in enumerate(zip(batch.column("place").to_pylist(), batch.column("payload_size").to_pylist(), strict=True)):
                    file.seek(place)
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-1], pa.array([file.read(size)], pa.binary())], [*batch.schema.names[:-1], "payload"])

    return rows.mapInArrow(run, schema.replace("place long", "payload binary"))


def decompress_file(spark: SparkSession, source: str, target: str) -> dict:
    """Restores a file or a folder from an archive; nothing is written unless all of it is sound."""
    began = time.time()
    refuse_same(source, target)
    with open(source, "rb") as file:
        index = _index(file)
    with replaced(target, index.directory) as staging, tempfile.TemporaryDirectory(prefix=f"{os.path.basename(target)}.tmp.", dir=os.path.dirname(os.path.abspath(target))) as folder:
        data = os.path.join(folder, "stream") if index.directory or index.stream else staging
        with open(data, "wb") as out:
            if index.heads:
                for row in stages.decode(_payloads(spark, source, index), F.lit(index.version)).toLocalIterator(prefetchPartitions=True):
                    if row.error is not None:
                        raise FormatError(row.error)
                    out.write(row.bytes)
        if index.stream:
            whole = kernels.ready(_file_blocks(spark, data, index.stream.coded_size, max(1, index.stream.coded_size)))
            found = whole.select(kernels.expand("bytes", index.original_size, index.stream.hash_bits).alias("f")).select("f.*", kernels.checksum("f.bytes").alias("checksum")).first()
            if found.error is not None or found.checksum != index.stream.checksum:
                raise FormatError(found.error or "stream checksum mismatch")
            data = os.path.join(folder, "restored") if index.directory else staging
            with open(data, "wb") as out:
                out.write(found.bytes)
            del found
        if os.path.getsize(data) != index.original_size:
            raise FormatError("archive restores another size")
        if index.directory:
            tree.extract_file(data, target)
    raw = sum(h.mode == 0 for h in index.heads)
    return statistics(os.path.getsize(source), index.original_size, len(index.heads), raw, time.time() - began)


def statistics(read: int, written: int, blocks: int, raw: int, seconds: float) -> dict:
    """What a run did; ratio and savings are those of its sizes, 0 for an empty input."""
    return {"input_size": read, "output_size": written, "block_count": blocks, "raw_blocks": raw, "transformed_blocks": blocks - raw, "seconds": seconds, "ratio": written / read if read else 0.0, "savings_percent": (1 - written / read) * 100 if read else 0.0}


# --- archives as rows ---


def archives(streams: DataFrame, block_size: int | None = None, profile: str = "default") -> DataFrame:
    """Rows (stream, archive): each stream's container bytes, stream pass included.

    Streams are told apart by their keys. Blocks are coded wherever there is room; a stream's coded blocks meet
    in one task, as its archive is one value.
    """
    if block_size is not None:
        container.choose_block_size(0, block_size)
    n = F.length("content").cast("long")
    sized = kernels.ready(streams).withColumn("n", n).withColumn("size", F.lit(block_size).cast("long") if block_size else c.block_size(n, profile)).withColumn("bits", c.hash_bits(n))
    short = F.when((F.col("size") < F.col("n")) & (F.col("n") <= container.STREAM_MOST), kernels.collapse("content", F.col("bits")))
    passed = sized.withColumn("short", short).withColumn("m", F.length("short").cast("long")).withColumn("sum", F.when(F.col("short").isNotNull(), kernels.checksum("content")))
    tried = F.coalesce(~c.stream_pass_decisive(F.col("n"), F.col("m")), F.lit(True))
    ways = F.array(F.struct(F.lit(False).alias("passed"), F.when(tried, F.col("content")).alias("bytes")), F.struct(F.lit(True).alias("passed"), F.col("short").alias("bytes")))
    each = passed.select("stream", "n", "size", "bits", "m", "sum", F.explode(F.filter(ways, lambda w: w["bytes"].isNotNull())).alias("way"))
    keys = ["stream", "n", "size", "bits", "m", "sum", "passed"]
    blocks = each.withColumn("passed", F.col("way.passed")).select(*keys, F.posexplode_outer(stages.slices(F.col("way.bytes"), F.col("size"))).alias("block_index", "bytes"))
    coded = stages.with_coded(blocks.repartition(stages.width(streams.sparkSession), "stream", "passed", "block_index"))
    header = F.unhex(c.block_header_hex(*(F.col(f) for f in ("mode", "lzp", "original_size", "payload_size", "primary_index", "intermediate_size", "checksum"))))
    packed = coded.withColumn("packed", F.when(F.col("payload").isNotNull(), F.concat(header, "payload")))
    whole = packed.groupBy(*keys).agg(F.count("packed").alias("blocks"), stages.in_order("block_index", "packed").alias("body"))
    both = whole.groupBy("stream", "n", "size", "bits", "m", "sum").agg(*(F.max(F.when(F.col("passed") == way, F.struct("blocks", "body"))).alias(name) for way, name in ((False, "plain"), (True, "pass"))))
    kept = F.col("pass").isNotNull() & (F.col("plain").isNull() | c.stream_pass_kept(F.col("n"), F.col("m"), F.length("pass.body"), F.length("plain.body")))
    chosen = both.withColumn("kept", kept).withColumn("one", F.when(F.col("kept"), F.col("pass")).otherwise(F.col("plain")))
    head = c.file_header_hex(F.col("size"), F.col("n"), F.col("one.blocks"), F.lit(False), F.col("kept"), F.col("m"), F.col("sum"), F.col("bits"))
    return chosen.select("stream", F.concat(F.unhex(head), "one.body").alias("archive"))


_INDEXED = "error string, original_size_ long, coded_size long, stream_checksum long, bits long, version long, block_index long, mode long, lzp boolean, original_size long, payload_size long, primary_index long, intermediate_size long, checksum long, payload binary"


def indexed(packed: DataFrame) -> DataFrame:
    """A row for each block of archives (stream, archive), one for an archive without blocks, and one with an error for what is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _INDEXED.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        for batch in batches:
            for i, raw in enumerate(batch.column("archive").to_pylist()):
                raw = raw or b""
                try:
                    found = container.parse(raw)
                    s = found.stream
                    shared = (None, found.original_size, s and s.coded_size, s and s.checksum, s and s.hash_bits, found.version)
                    rows = [(*shared, k, h.mode, h.lzp, h.original_size, h.payload_size, h.primary_index, h.intermediate_size, h.checksum, raw[h.place : h.place + h.payload_size]) for k, h in enumerate(found.heads)]
                    rows = rows or [(*shared, *([None] * 9))]
                except FormatError as error:
                    rows = [(str(error), *([None] * 14))]
                columns = [pa.array(list(v), kinds[f.split()[1]]) for v, f in zip(zip(*rows, strict=True), _INDEXED.split(", "), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("stream").take(pa.array([i] * len(rows))), *columns], ["stream", *names])

    kind = packed.schema["stream"].dataType.simpleString()
    return packed.select("stream", "archive").mapInArrow(run, f"stream {kind}, {_INDEXED}")


def restored(packed: DataFrame) -> DataFrame:
    """Rows (stream, content, error) of rows (stream, archive): a malformed archive has an error instead of content.

    Streams are told apart by their keys.
    """
    rows = stages.with_decoded(indexed(packed).withColumnRenamed("error", "framing"), F.col("version"))
    error = F.coalesce("framing", "found.error")
    first = F.min(F.when(error.isNotNull(), F.struct(F.coalesce("block_index", F.lit(-1)).alias("at"), error.alias("error"))))["error"]
    shared = [F.max(x).alias(x) for x in ("original_size_", "coded_size", "stream_checksum", "bits")]
    whole = rows.withColumn("part", F.col("found.bytes")).groupBy("stream").agg(first.alias("error"), *shared, F.collect_list(F.when(F.col("part").isNotNull(), F.struct("block_index", "part"))).alias("parts"))
    joined = whole.withColumn("joined", kernels.join(F.transform(F.array_sort("parts"), lambda p: p["part"])))
    streamed = joined.withColumn("expanded", F.when(F.col("error").isNull() & F.col("bits").isNotNull(), kernels.expand("joined", F.col("original_size_"), F.col("bits"))))
    content = F.when(F.col("bits").isNull(), F.col("joined")).otherwise(F.col("expanded.bytes"))
    done = streamed.withColumn("content", content)
    late = F.when(F.col("expanded.error").isNotNull(), F.col("expanded.error")).when(F.col("bits").isNotNull() & (kernels.checksum("content") != F.col("stream_checksum")), "stream checksum mismatch").when(F.length("content") != F.col("original_size_"), "archive restores another size")
    judged = done.withColumn("error", F.coalesce("error", late))
    return judged.select("stream", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")


def verify(packed: DataFrame) -> DataFrame:
    """Rows (stream, error), error null for a sound archive; never raises."""
    return restored(packed).select("stream", "error")


def block_statistics(coded: DataFrame) -> DataFrame:
    """One row on a blocks table: sizes, counts, ratio and savings. It reads no payloads."""
    sums = coded.agg(
        F.coalesce(F.sum("original_size"), F.lit(0)).cast("long").alias("input_size"),
        F.coalesce(F.sum(F.col("payload_size") + container.HEADER_BYTES), F.lit(0)).cast("long").alias("output_size"),
        F.count("*").alias("block_count"),
        F.count_if(F.col("mode") == 0).alias("raw_blocks"),
        F.count_if(F.col("mode") != 0).alias("transformed_blocks"),
    )
    empty = F.col("input_size") == 0
    return sums.select("*", F.when(empty, 0.0).otherwise(F.col("output_size") / F.col("input_size")).alias("ratio"), F.when(empty, 0.0).otherwise((1 - F.col("output_size") / F.col("input_size")) * 100).alias("savings_percent"))


def missing_blocks(coded: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (stream, block_index) that a blocks table lacks, given rows (stream, block_count)."""
    all_of = expected.where("block_count > 0").select("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block_count") - 1)).alias("block_index"))
    return all_of.join(coded.select("stream", "block_index"), ["stream", "block_index"], "left_anti")
