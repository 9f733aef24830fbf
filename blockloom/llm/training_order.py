"""Training-order materialisation by a keyed Feistel permutation (operator 6).

Documents become sequences of `LENGTH` ids: their ids and a separator, cut and padded. Sequences are
numbered densely in order of doc_id: counts of a few ranges of doc_id give each range's first number,
and a running count goes on inside. A keyed Feistel network permutes the numbers within the next power
of four; whatever falls outside walks on along its cycle until it is inside, so that each sequence gets
one slot and each slot one sequence, with no sort by random keys and nothing to remember. Slots are
range-partitioned into shards, flat files with records of equal length: slot s stands in shard
s // slots_per_shard at (s % slots_per_shard) * STRIDE, so a reader seeks there and resumes anywhere. There
are as many shards as the bytes ask for.

Cases. Null or empty text: one sequence with the separator alone. Null doc_id: numbered last. Equal
doc_ids: ordered by a hash of the text; equal rows are interchangeable. Empty table: no rows and no
files. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import cut, range_of, shared_path, splitters, word_count
from .token_files import END_ID, ID_BYTES, PAD_ID, SHARD_BYTES, file_blocks, token_rows, write_records

LENGTH = 256
#: Bytes of a record: the ids, and the separator that ends each record of a flat file.
STRIDE = (LENGTH + 1) * ID_BYTES
KEY = "order-1"
ROUNDS = 4
#: Modulus and multipliers of the round function (a prime and two of its primitive roots).
PRIME, FIRST, SECOND = 2_147_483_647, 48_271, 16_807


def round_keys(key: str = KEY) -> list[int]:
    """ROUNDS numbers under 2^24 from a key."""
    return [int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:3], "big") for i in range(ROUNDS)]


def half_bits(count: int) -> int:
    """Bits of one half of the network for so many numbers."""
    return max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)


def feistel(numbers: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    """The permutation of the numbers under 2^(2 bits)."""
    mask = (1 << bits) - 1
    left, right = numbers >> bits, numbers & mask
    for k in keys:
        left, right = right, left ^ ((((right + k) * FIRST % PRIME) * SECOND % PRIME) & mask)
    return left << bits | right


def slots(numbers: np.ndarray, count: int, key: str = KEY) -> np.ndarray:
    """The slots of the numbers under `count`: the permutation, walked on until it is under `count`."""
    bits, keys = half_bits(count), round_keys(key)
    out = feistel(numbers.astype(np.int64), bits, keys)
    outside = np.flatnonzero(out >= count)
    while len(outside):
        out[outside] = feistel(out[outside], bits, keys)
        outside = outside[out[outside] >= count]
    return out


def cut_sequences(ids: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A document's ids and the separator as rows of `length` ids, the last one padded."""
    rows = len(ids) // length + 1
    out = np.full(rows * length, PAD_ID, "<u2")
    out[: len(ids)] = ids
    out[len(ids)] = END_ID
    return out.reshape(rows, length)


class Order:
    """How the sequences of documents are numbered, and the slots they get.

    The driver learns one count for each range of doc_id; ranges are a few times the shuffle width.
    """

    def __init__(self, docs: DataFrame, key: str = KEY) -> None:
        self.docs, self.key, self.kind = docs, key, docs.schema["doc_id"].dataType.simpleString()
        self.parts = shuffle_partitions(docs.sparkSession)
        self.range = range_of(F.col("doc_id"), splitters(docs.select("doc_id"), "doc_id", 2 * self.parts))
        sequences = (F.floor(word_count(F.col("text")) / LENGTH) + 1).cast("long")
        self.counted = cut(docs.select("doc_id", F.xxhash64("text").alias("text_key"), sequences.alias("n")).withColumn("part", self.range))
        counts = dict(sorted((r["part"], r["n"]) for r in self.counted.groupBy("part").agg(F.sum("n").alias("n")).collect()))
        self.starts, self.total = {}, 0
        for part, n in counts.items():
            self.starts[part], self.total = self.total, self.total + n

    def assigned(self) -> DataFrame:
        """Rows (doc_id, seq_no, slot), from the counts alone."""
        starts, total, key = self.starts, self.total, self.key
        along = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "text_key").rowsBetween(Window.unboundedPreceding, 0)
        first = self.counted.withColumn("first", F.sum("n").over(along) - F.col("n"))
        each = first.select("doc_id", "part", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("seq_no"))

        @F.arrow_udf("long")
        def slot(part: pa.Array, number: pa.Array) -> pa.Array:
            base = np.array([starts[p] for p in part.to_pylist()], np.int64)
            return pa.array(slots(base + number.to_numpy(zero_copy_only=False), total, key))

        return each.select("doc_id", "seq_no", slot(F.col("part"), F.col("first") + F.col("seq_no")).alias("slot"))

    def records(self) -> DataFrame:
        """Rows (slot, record) of all sequences; each text is tokenised once."""
        starts, total, key = self.starts, self.total, self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number = None, 0
            for batch in batches:
                rows, numbers = [], []
                for own, raw in zip(batch.column("part").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                    if own != part:
                        part, number = own, starts[own]
                    records = cut_sequences(np.frombuffer(raw, "<u2"))
                    rows.extend(r.tobytes() for r in records)
                    numbers.extend(range(number, number + len(records)))
                    number += len(records)
                yield pa.RecordBatch.from_arrays([pa.array(slots(np.array(numbers, np.int64), total, key)), pa.array(rows, pa.binary())], ["slot", "record"])

        placed = self.docs.select("doc_id", "text", self.range.alias("part"), F.xxhash64("text").alias("text_key"))
        dealt = token_rows(placed, "part,text_key").repartition(self.parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "text_key")
        return dealt.select("part", "tokens").mapInArrow(run, "slot long, record binary")


def materialise(docs: DataFrame, path: str, key: str = KEY, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """Writes the shards under a path: rows (doc_id, seq_no, slot) of what was written, and slots per shard."""
    order = Order(docs, key)
    shards = max(order.parts, -(-order.total * STRIDE // shard_bytes))
    per_shard = max(1, -(-order.total // shards))
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    rows = order.records().withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    write_records(rows.select("shard", "record"), path)
    return order.assigned(), per_shard


def read_slots(spark: SparkSession, path: str, per_shard: int, first: int = 0, records: int = 4096) -> DataFrame:
    """Rows (slot, n_tokens, ids) from slot `first` on, so many records a read; what is before it is not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, content in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("content"), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2").reshape(-1, LENGTH + 1)[:, :LENGTH]
                where = np.arange(len(ids)) + shard * per_shard + block * records
                ids, where = ids[where >= first], where[where >= first]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array((ids != PAD_ID).sum(1), pa.int64()), pa.array([r.tobytes() for r in ids], pa.binary())], ["slot", "n_tokens", "ids"])

    place = F.greatest(F.lit(0), F.lit(first) - F.col("shard") * per_shard).cast("long") * STRIDE
    return file_blocks(spark, path, records * STRIDE, place).mapInArrow(run, "slot long, n_tokens long, ids binary")


def ordered_sequences(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the shards and reads them back: rows (doc_id, seq_no, slot, n_tokens)."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "order")
    written, per_shard = materialise(docs, path)
    read = read_slots(spark, path, per_shard).select("slot", "n_tokens").hint("merge")  # a listing of files looks small, what is in them isn't
    return written.join(read, "slot").select("doc_id", "seq_no", "slot", "n_tokens")
