"""Every stage as a DataFrame operator over rows (stream, block_index, bytes).

Coders are SQL functions of the JVM (`kernels`), so that a stage is a projection; what has a relational form
has it here. Arrow batches are used only where numpy counts bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import kernels
from ..codec.blocks import CONTEXT, EXTENSIONS, MIXED, RANKED, RAW, SLOT_FACTOR
from ..functions import columns as c
from ..session import shuffle_partitions

#: Bytes of blocks that a step in Python works on together.
BATCH_BYTES = 4 << 20
#: Rows that a step in Python returns together.
BATCH_ROWS = 1 << 17


def binary_stream(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (stream, content) of a string or binary column; null content is empty."""
    kind = df.schema[column].dataType.simpleString()
    content = F.col(column) if kind == "binary" else F.encode(F.col(column), "UTF-8")
    return df.select(F.col(key).alias("stream"), F.coalesce(content, F.lit(b"")).alias("content"))


def slices(content: Column, size: Column | int) -> Column:
    """A binary in equal parts as an array, the last one shorter; none for an empty one."""
    size = F.lit(size) if isinstance(size, int) else size
    number = F.floor((F.length(content) - 1) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), number), lambda i: F.substring(content, (i * size + 1).cast("int"), size.cast("int")))
    return F.when(F.length(content) > 0, parts).otherwise(F.array().cast("array<binary>"))


def split_blocks(streams: DataFrame, block_size: int) -> DataFrame:
    """Rows (stream, block_index, bytes): equal blocks, the last one shorter; an empty stream has none."""
    cut = streams.select("stream", F.posexplode(slices(F.col("content"), block_size)).alias("block_index", "bytes"))
    return cut.withColumn("block_index", F.col("block_index").cast("long"))


def per_block(blocks: DataFrame, fields: str, work: Callable[[list[bytes]], list[tuple]]) -> DataFrame:
    """Rows (stream, block_index, *fields): `work` gets a batch of blocks and returns a tuple for each."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches):
            rows = work([b or b"" for b in batch.column("bytes").to_pylist()])
            table = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
            columns = [pa.array(list(c), kinds[f.split()[1]]) for c, f in zip(table, fields.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("block_index"), *columns], ["stream", "block_index", *names])

    kind = blocks.schema["stream"].dataType.simpleString()
    return blocks.mapInArrow(run, f"stream {kind}, block_index long, {fields}")


def regroup(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of blocks, so that coders have many lanes and bounded memory."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        ends = np.cumsum([len(b.as_buffer() or b"") if b.is_valid else 0 for b in batch.column("bytes")]) if batch.num_rows else np.zeros(0, int)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, base + limit - size, side="right"))))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - base)
            at = to
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def width(spark: SparkSession) -> int:
    """Tasks over which blocks are spread: the shuffle width, or all cores."""
    return max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)


#: Times as many tasks where blocks are few and each takes seconds: dealt to fewer, one task gets several times its share.
FINE = 8


def deal(rows: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """Rows spread evenly, blocks by stream and index: streams differ in length, and coding costs more than moving."""
    return rows.repartition(times * width(rows.sparkSession), *(keys or ("stream", "block_index")))


# --- stages ---


def adler32(blocks: DataFrame) -> DataFrame:
    """Rows (stream, block_index, size, checksum)."""
    return kernels.ready(blocks).select("stream", "block_index", F.length("bytes").cast("long").alias("size"), kernels.checksum("bytes").alias("checksum"))


def byte_counts(blocks: DataFrame) -> DataFrame:
    """Rows (stream, byte, n): how often a stream has each byte that it has; summed up inside a task first."""
    counted = per_block(blocks, "counts binary", lambda bs: [(np.bincount(np.frombuffer(b, np.uint8), minlength=256).astype(">i8").tobytes(),) for b in bs])
    each = counted.select("stream", F.posexplode(F.sequence(F.lit(0), F.lit(255))).alias("byte", "_"), "counts")
    n = F.conv(F.hex(F.substring("counts", F.col("byte") * 8 + 1, F.lit(8))), 16, 10).cast("long")
    return each.select("stream", F.col("byte").cast("long").alias("byte"), n.alias("n")).where("n > 0").groupBy("stream", "byte").agg(F.sum("n").alias("n"))


def rarest_bytes(counts: DataFrame, streams: DataFrame) -> DataFrame:
    """Rows (stream, marker): the byte a stream has least, absent ones first, the least of equals."""
    every = streams.select("stream").distinct().select("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("byte"))
    filled = every.join(counts, ["stream", "byte"], "left").fillna(0, ["n"])
    return filled.groupBy("stream").agg(F.min(F.struct("n", "byte"))["byte"].alias("marker"))


def bwt(blocks: DataFrame) -> DataFrame:
    """Rows (stream, block_index, data, primary_index)."""
    return kernels.ready(blocks).select("stream", "block_index", kernels.sort("bytes").alias("s")).select("stream", "block_index", "s.data", "s.primary_index")


def unbwt(columns: DataFrame) -> DataFrame:
    """Rows (stream, block_index, bytes) of rows (stream, block_index, data, primary_index)."""
    return kernels.ready(columns).select("stream", "block_index", kernels.unsort("data", "primary_index").alias("bytes"))


def suffix_order(blocks: DataFrame) -> DataFrame:
    """Rows (stream, block_index, order): the places where a block's suffixes start, in the suffixes' order."""
    return kernels.ready(blocks).select("stream", "block_index", kernels.order("bytes").alias("order"))


def recency_ranks(blocks: DataFrame) -> DataFrame:
    """Rows (stream, block_index, ranks): a byte a rank."""
    return kernels.ready(blocks).select("stream", "block_index", kernels.ranks("bytes").alias("ranks"))


def lf_mapping(blocks: DataFrame) -> DataFrame:
    """Rows (stream, block_index, size, checksum): ranks by (byte, place), summed up with their places."""

    def work(some: list[bytes]) -> list[tuple]:
        out = []
        for b in some:
            rank = np.empty(len(b), np.int64)
            rank[np.argsort(np.frombuffer(b, np.uint8), kind="stable")] = np.arange(1, len(b) + 1)
            out.append((len(b), int((rank * np.arange(len(b))).sum())))
        return out

    return per_block(blocks, "size long, checksum long", work)


def _mtf_back(df: DataFrame) -> DataFrame:
    return df.withColumn("coded", kernels.ranks("bytes")).withColumn("back", kernels.unrank("coded"))


def _bwt_back(df: DataFrame) -> DataFrame:
    sorted_ = df.withColumn("s", kernels.sort("bytes")).withColumn("coded", F.col("s.data"))
    return sorted_.withColumn("back", kernels.unsort("coded", "s.primary_index"))


def _rc_back(df: DataFrame) -> DataFrame:
    coded = df.withColumn("s", kernels.sort("bytes")).withColumn("r", kernels.run_encode(kernels.ranks("s.data"), EXTENSIONS[0])).withColumn("coded", F.col("r.payload"))
    return coded.withColumn("back", kernels.unsort(kernels.unrank(kernels.run_decode("coded", "r.symbols", F.length("bytes"))), "s.primary_index"))


def _cm_back(df: DataFrame) -> DataFrame:
    return df.withColumn("coded", kernels.mix_encode("bytes")).withColumn("back", kernels.mix_decode("coded", F.length("bytes")))


def _lzp_back(df: DataFrame) -> DataFrame:
    bits = c.hash_bits(F.length("bytes"))
    short = df.withColumn("short", kernels.collapse("bytes", bits)).withColumn("coded", F.coalesce("short", "bytes"))
    return short.withColumn("back", F.when(F.col("short").isNull(), F.col("bytes")).otherwise(kernels.expand("short", F.length("bytes"), bits)["bytes"]))


def _block_back(df: DataFrame) -> DataFrame:
    return with_decoded(with_coded(df)).withColumn("coded", F.col("payload")).withColumn("back", F.col("found.bytes"))


ROUNDTRIPS: dict[str, Callable[[DataFrame], DataFrame]] = {"mtf": _mtf_back, "bwt": _bwt_back, "rc": _rc_back, "cm": _cm_back, "lzp": _lzp_back, "block": _block_back}


def roundtrip(blocks: DataFrame, stage: str) -> DataFrame:
    """Rows (stream, block_index, coded_size, bytes): blocks coded and restored by one stage, or by all of them."""
    done = ROUNDTRIPS[stage](kernels.ready(deal(blocks)))
    return done.select("stream", "block_index", F.length("coded").cast("long").alias("coded_size"), F.col("back").alias("bytes"))


#: Columns of a coded block.
FIELDS = ("mode", "lzp", "original_size", "payload_size", "primary_index", "intermediate_size", "checksum", "payload")


def with_candidates(df: DataFrame, give_up: bool = True) -> DataFrame:
    """Rows with a column `bytes` get each coding: mixed, run-coded with either spelling, collapsed and mixed.

    A coding is null where it would not be shorter than the block and all codings before it; without
    give_up, only where there is nothing to collapse.
    """

    def limit(*before: str) -> Column | int:
        if not give_up:
            return kernels.NO_LIMIT
        sizes = [F.length("bytes"), *(F.length(b) for b in before)]
        return (F.least(*sizes) if before else sizes[0]).cast("long")  # least() passes nulls over

    out = kernels.ready(df).withColumn("s", kernels.sort("bytes")).withColumn("short", kernels.collapse("bytes", c.hash_bits(F.length("bytes"))))
    out = out.withColumn("mixed", kernels.mix_encode("s.data", limit())).withColumn("ranks", kernels.ranks("s.data")).withColumn("short_s", kernels.sort("short"))
    out = out.withColumn("run_0", kernels.run_encode("ranks", EXTENSIONS[0], limit("mixed")))
    out = out.withColumn("run_1", kernels.run_encode("ranks", EXTENSIONS[1], limit("mixed", "run_0.payload")))
    return out.withColumn("collapsed", kernels.mix_encode("short_s.data", limit("mixed", "run_0.payload", "run_1.payload")))


_PAYLOADS = ("mixed", "run_0.payload", "run_1.payload", "collapsed")


def with_coded(df: DataFrame) -> DataFrame:
    """Rows with a column `bytes` get FIELDS, the block's least coding."""
    tried = with_candidates(df).withColumn("chosen", c.least_coding([F.length(p) for p in _PAYLOADS], F.length("bytes")))
    pick = lambda raw, mixed, first, second, short: F.when(F.col("chosen") == 0, mixed).when(F.col("chosen") == 1, first).when(F.col("chosen") == 2, second).when(F.col("chosen") == 3, short).otherwise(raw)
    zero, primary = F.lit(0).cast("long"), F.col("s.primary_index")
    fields = [
        pick(*(F.lit(m).cast("long") for m in (RAW, MIXED, RANKED, RANKED, MIXED))).alias("mode"),
        (F.col("chosen") == 3).alias("lzp"),
        F.length("bytes").cast("long").alias("original_size"),
        pick(F.col("bytes"), *(F.col(p) for p in _PAYLOADS)).alias("payload"),
        pick(zero, primary, primary, primary, F.col("short_s.primary_index")).alias("primary_index"),
        pick(zero, zero, F.col("run_0.symbols"), F.col("run_1.symbols"), F.length("short").cast("long")).alias("intermediate_size"),
        kernels.checksum("bytes").alias("checksum"),
    ]
    kept = [F.col(f"`{name}`") for name in df.columns if name not in FIELDS]
    return tried.select(*kept, *fields).withColumn("payload_size", F.length("payload").cast("long"))


def encode(blocks: DataFrame, times: int = 1) -> DataFrame:
    """The blocks table: each block's least coding."""
    return with_coded(deal(blocks, times=times)).select("stream", "block_index", *FIELDS)


def candidate_sizes(blocks: DataFrame) -> DataFrame:
    """Rows (stream, block_index, original_size, mixed, ranked_2, ranked_3, collapsed): payload bytes of each coding."""
    tried = with_candidates(deal(blocks), give_up=False)
    sizes = [F.length(p).cast("long").alias(name) for p, name in zip(_PAYLOADS, ("mixed", "ranked_2", "ranked_3", "collapsed"), strict=True)]
    return tried.select("stream", "block_index", F.length("bytes").cast("long").alias("original_size"), *sizes)


def with_decoded(coded: DataFrame, version: Column | None = None) -> DataFrame:
    """Rows with FIELDS get `found`, the struct (bytes, error): a malformed block has an error instead of bytes."""
    f = {name: F.col(name) for name in FIELDS}
    size = F.length("payload").cast("long")
    error = c.header_error(F.lit(2) if version is None else version, f["mode"], f["lzp"], f["original_size"], size, f["primary_index"], f["intermediate_size"])
    checked = kernels.ready(coded).withColumn("header_error", error)
    back = kernels.restore(f["mode"], f["lzp"], f["original_size"], f["primary_index"], f["intermediate_size"], f["checksum"], f["payload"], c.hash_bits(f["original_size"]))
    bad = F.struct(F.lit(None).cast("binary").alias("bytes"), F.col("header_error").alias("error"))
    return checked.withColumn("found", F.when(F.col("header_error").isNotNull(), bad).otherwise(back))


def decode(coded: DataFrame, version: Column | None = None) -> DataFrame:
    """Rows (stream, block_index, bytes, error) of the blocks table: a malformed block has an error instead of bytes."""
    return with_decoded(coded, version).select("stream", "block_index", "found.bytes", "found.error")


def in_order(key: str, value: str) -> Column:
    """A binary column's values as one, in the order of another column, as an aggregate; nulls are left out."""
    return kernels.join(F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(key, value)))), lambda p: p[value]))


def join_blocks(blocks: DataFrame) -> DataFrame:
    """Rows (stream, content): the blocks of each stream in order."""
    return kernels.ready(blocks).groupBy("stream").agg(in_order("block_index", "bytes").alias("content"))


def run_islands(blocks: DataFrame, block_size: int) -> DataFrame:
    """Rows (stream, start, length, byte) of blocks of one size: the maximal runs of each stream.

    Runs inside a block are found at once; only those that touch an edge of their block (two at most, or parts of 16 MiB) are
    put together with their neighbours', by gaps and islands.
    """

    def found(edges: bool) -> DataFrame:
        packed = kernels.ready(blocks).select("stream", "block_index", kernels.runs("bytes", edges).alias("runs"))
        run = F.col("run")
        start = F.col("block_index") * block_size + F.shiftright(run, 32)
        return packed.select("stream", "block_index", F.explode("runs").alias("run")).select("stream", start.alias("start"), F.shiftright(run, 8).bitwiseAND(0xFFFFFF).alias("length"), run.bitwiseAND(255).alias("byte"))

    along = Window.partitionBy("stream").orderBy("start")
    follows = (F.lag("byte").over(along) == F.col("byte")) & (F.lag("start").over(along) + F.lag("length").over(along) == F.col("start"))
    edges = found(True).withColumn("new", F.when(follows, 0).otherwise(1))
    islands = edges.withColumn("island", F.sum("new").over(along)).groupBy("stream", "island").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.first("byte").alias("byte"))
    return found(False).union(islands.select("stream", "start", "length", "byte"))


def slots(data: bytes, bits: int) -> np.ndarray:
    """The hash slot of the bytes before each position from CONTEXT on."""
    if len(data) <= CONTEXT:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), CONTEXT)[:-1]
    contexts = np.ascontiguousarray(windows).view(">u8").ravel().astype(np.uint64)
    return (contexts * np.uint64(SLOT_FACTOR) >> np.uint64(64 - bits)).astype(np.int64)


def _predictions(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places from CONTEXT on in the order of their slots, the slots, and the slot's last place where it is known that there is one."""
    slot = slots(data, bits)
    both = np.sort(slot << 32 | np.arange(CONTEXT, CONTEXT + len(slot)))
    pos, slot = both & 0xFFFFFFFF, both >> 32
    return pos, slot, np.r_[pos[:1], pos[:-1]], np.r_[slot[:1] < 0, slot[1:] == slot[:-1]]


def slot_predictions(streams: DataFrame, bits: int = 20) -> DataFrame:
    """Rows (stream, pos, slot, predicted): hash slots of the 8 bytes before a place, and the slot's last place.

    A stream is one row, so its slots are ordered where it is read and none of them moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column("content")):
                pos, slot, before, known = _predictions(content.as_buffer() or b"", bits)
                for at in range(0, len(pos), BATCH_ROWS):
                    some = slice(at, at + BATCH_ROWS)
                    owner = batch.column("stream").take(pa.array(np.full(len(pos[some]), i)))
                    yield pa.RecordBatch.from_arrays([owner, pa.array(pos[some]), pa.array(slot[some]), pa.array(before[some], mask=~known[some])], ["stream", "pos", "slot", "predicted"])

    kind = streams.schema["stream"].dataType.simpleString()
    return streams.select("stream", "content").mapInArrow(run, f"stream {kind}, pos long, slot long, predicted long")


def long_matches(streams: DataFrame, bits: int = 20, least: int = 128) -> DataFrame:
    """Rows (stream, pos, source): places whose next `least` bytes equal those at the place their slot predicts."""

    def found(data: bytes) -> list[tuple[int, int]]:
        at, _, source, known = _predictions(data, bits)
        inside = known & (at + least <= len(data))
        at, source = at[inside], source[inside]
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)).view(np.uint64).ravel() if len(at) else at
        likely = (eight[at] == eight[source]) & (eight[at + least - 8] == eight[source + least - 8]) if len(at) else np.zeros(0, bool)
        return sorted((a, b) for a, b in zip(at[likely].tolist(), source[likely].tolist(), strict=True) if data[a : a + least] == data[b : b + least])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column("content").to_pylist()):
                rows = found(content)
                at, source = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column("stream").take(pa.array([i] * len(rows), pa.int64())), pa.array(at, pa.int64()), pa.array(source, pa.int64())], ["stream", "pos", "source"])

    kind = streams.schema["stream"].dataType.simpleString()
    return streams.select("stream", "content").mapInArrow(run, f"stream {kind}, pos long, source long")


def collapse_streams(streams: DataFrame) -> DataFrame:
    """Rows (stream, size, collapsed_size, bytes): each stream collapsed as a whole, and restored."""
    done = _lzp_back(kernels.ready(streams).withColumnRenamed("content", "bytes"))
    return done.select("stream", F.length("bytes").cast("long").alias("size"), F.length("coded").cast("long").alias("collapsed_size"), F.col("back").alias("bytes"))


def compare_codecs(blocks: DataFrame) -> DataFrame:
    """Rows (stream, block_index, size, own, gzip, bzip2, xz): bytes by this coder and by common ones."""
    import bz2
    import lzma
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches):
            data = [b or b"" for b in batch.column("bytes").to_pylist()]
            sizes = [[len(b) for b in data], batch.column("payload_size").to_pylist(), *([len(pack(b)) for b in data] for pack in (lambda b: zlib.compress(b, 9), lambda b: bz2.compress(b, 9), lambda b: lzma.compress(b, preset=9)))]
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("block_index"), *(pa.array(s, pa.int64()) for s in sizes)], ["stream", "block_index", "size", "own", "gzip", "bzip2", "xz"])

    kind = blocks.schema["stream"].dataType.simpleString()
    coded = with_coded(deal(blocks, times=FINE)).select("stream", "block_index", "bytes", "payload_size")
    return coded.mapInArrow(run, f"stream {kind}, block_index long, size long, own long, gzip long, bzip2 long, xz long")
