"""Flat token files: little-endian 16-bit ids, documents ended by a separator id, no index.

Files are written by Spark's own text source and read by byte ranges through the session's file systems, so
any storage it knows will do.
The text source ends each record with the characters of `lineSep`; with two line feeds these are the
bytes 0A 0A, that is, the id 2570, which therefore is the separator here. The hash tokenizer never gives it,
nor the id that pads sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kernels
from ..session import shuffle_partitions
from .common import pieces, utf8, word_hashes

#: The separator, as an id and as the text source writes it.
END_ID, END_TEXT = 0x0A0A, "\n\n"
ID_BYTES, PAD_ID = 2, 0xFFFF
#: Bytes of a file that writers aim at.
SHARD_BYTES = 64 << 20


def hash_tokens(texts: list[bytes]) -> list[np.ndarray]:
    """For each text one id a word: a hash, without the values of separator and padding. Needs no vocabulary."""
    hashes, at = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
    ids = hashes % np.uint64(PAD_ID - 1)
    ids = (ids + (ids >= END_ID)).astype("<u2")
    ends = np.searchsorted(at, np.cumsum([len(t) + 1 for t in texts]))
    return np.split(ids, ends[:-1]) if texts else []


def token_rows(docs: DataFrame, more: str = "") -> DataFrame:
    """Rows (doc_id, tokens, n_tokens): a document's ids as bytes. more: other columns to carry along."""
    kept = [c for c in more.split(",") if c]
    fields = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            ids = hash_tokens(utf8(batch.column("text")))
            columns = [batch.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64()), *(batch.column(c) for c in kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "n_tokens", *kept])

    return docs.select("doc_id", "text", *kept).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens binary, n_tokens long{fields}")


def shards_for(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """How many files to write: the shuffle width, or more for large tables, by the plan's own size estimate."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # Spark's figure for a plan of unknown size is the largest long
    return max(shuffle_partitions(docs.sparkSession), known // shard_bytes)


def write_records(rows: DataFrame, path: str) -> None:
    """Writes rows (shard, record), as they are ordered, to one flat file a shard; each record is ended by the separator."""
    rows.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", END_TEXT).mode("overwrite").text(path)


def file_blocks(spark: SparkSession, path: str, block: int, first: Column | int = 0) -> DataFrame:
    """Rows (shard, block, content): the files under a path in blocks of so many bytes, each read alone, from a place on.

    Only names and lengths are listed; a block is read by the task that works on it, wherever the file is, so
    that files may be of any size. first: the place from which a file is wanted, by its shard number.
    """
    files = kernels.ready(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path))
    if "shard" not in files.columns:
        return spark.createDataFrame([], "shard long, block long, content binary")
    least = F.floor((F.lit(first) if isinstance(first, int) else first) / block)
    numbers = F.sequence(least, F.floor((F.col("length") - 1) / block))
    listed = files.select(F.col("shard").cast("long").alias("shard"), "path", "length").where((F.col("length") > 0) & (least * block < F.col("length")))
    each = listed.select("shard", "path", "length", F.explode(numbers).alias("block"))
    dealt = each.repartition(shuffle_partitions(spark), "shard", "block")
    size = F.least(F.lit(block), F.col("length") - F.col("block") * block)
    return dealt.select("shard", "block", kernels.read("path", F.col("block") * block, size).alias("content"))
