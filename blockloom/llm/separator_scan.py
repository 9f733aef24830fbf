"""Token counts of the documents in flat, unindexed token files, by a separator scan (operator 5).

Files are cut into blocks by byte ranges, and blocks are dealt over tasks whatever file they are of. Each is
searched at once for the separator id, with no regard to its neighbours. What crosses blocks, and so tasks,
follows from a prefix scan over one narrow row a block: how many ids come before it, where the last separator
before it stands, and how many separators there were. So a document may run over any number of blocks, and a
file may be of any size.

Cases. Empty document: 0 ids, counted. Ids after the last separator: a document without an end, counted.
Empty file: no documents. Null text: empty. For `count_tokens`: null doc_id first in its file; equal
doc_ids by a hash of the text; repeated rows each count. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_path
from .token_files import END_ID, ID_BYTES, file_blocks, shards_for, token_rows, write_records

#: Bytes of a block.
BLOCK = 1 << 20


def scan_blocks(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Rows (shard, block, size, ends) of rows (shard, block, content): each block's ids, and the places of separators in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column("content")):
                raw = content.as_buffer()
                ids = np.frombuffer(raw, "<u2", raw.size // ID_BYTES)
                ends = np.flatnonzero(ids == end_id).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:2], pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int32()))], ["shard", "block", "size", "ends"])

    return blocks.select("shard", "block", "content").mapInArrow(run, "shard long, block long, size long, ends array<int>")


def stitch(blocks: DataFrame) -> DataFrame:
    """Rows (shard, doc_no, start, n_tokens) of all documents, from scanned blocks, which are read twice."""
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("shard").orderBy("block")
    zero = F.lit(0).cast("long")
    narrow = blocks.select("shard", "block", "size", F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    placed = narrow.select("*", F.coalesce(F.sum("size").over(earlier), zero).alias("base"), F.coalesce(F.sum("n").over(earlier), zero).alias("doc_base"), F.lead("block").over(along).isNull().alias("is_last"))
    after_end = F.col("base") + F.col("last") + 1
    carried = placed.withColumn("open", F.coalesce(F.max(after_end).over(earlier), zero))
    # a last document without a separator ends where the file does
    rest = F.col("base") + F.col("size") - F.coalesce(after_end, F.col("open"))
    scanned = carried.select("shard", "block", "base", "doc_base", "open", (F.col("is_last") & (rest > 0)).alias("tail"), (F.col("base") + F.col("size")).alias("stop"))
    joined = blocks.select("shard", "block", "ends").join(scanned, ["shard", "block"])
    ends = F.transform("ends", lambda e: F.col("base") + e)
    ends = F.when(F.col("tail"), F.concat(ends, F.array("stop"))).otherwise(ends)
    each = joined.select("shard", "doc_base", "open", ends.alias("all")).select("shard", "doc_base", "open", "all", F.posexplode("all").alias("nth", "end"))
    start = F.when(F.col("nth") == 0, F.col("open")).otherwise(F.get("all", F.col("nth") - 1) + 1)
    return each.select("shard", (F.col("doc_base") + F.col("nth")).alias("doc_no"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def scan_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Rows (shard, doc_no, start, n_tokens) of the flat token files under a path, in blocks of an even number of bytes."""
    return stitch(cut(scan_blocks(file_blocks(spark, path, block))))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the documents to flat token files and scans these: rows (doc_id, shard, doc_no, start, n_tokens).

    Within a file documents stand in the order of doc_id; only that order tells which is which.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    shards = shards_for(docs)
    text_key = F.xxhash64("text")  # it deals, too: null or equal doc_ids may be many
    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", text_key), F.lit(shards)).alias("shard"), text_key.alias("text_key"))
    rows = token_rows(placed, "shard,text_key").repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "text_key")
    write_records(rows.select("shard", F.col("tokens").alias("record")), path)
    order = Window.partitionBy("shard").orderBy("doc_id", "text_key")
    names = placed.select("doc_id", "shard", (F.row_number().over(order) - 1).cast("long").alias("doc_no"))
    return names.join(scan_files(spark, path), ["shard", "doc_no"]).select("doc_id", "shard", "doc_no", "start", "n_tokens")
