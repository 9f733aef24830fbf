"""Incremental coding: new rows of a table become rows of the blocks table, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import stages


def encode_new(spark: SparkSession, source: str, key: str, column: str, target: str, checkpoint: str, block_size: int = 65_536) -> StreamingQuery:
    """Codes the Parquet files of a folder that were not coded before, then stops.

    Blocks are independent, so no state goes from one run to the next; the stream-wide pass, which needs a
    whole stream at hand, takes no part.
    """
    schema = spark.read.parquet(source).schema
    new = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        blocks = stages.split_blocks(stages.binary_stream(batch, key, column), block_size)
        stages.encode(blocks).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
