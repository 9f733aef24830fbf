"""The corpus pipeline: toxic documents go, near-duplicates go, PII is replaced, sources are mixed, text is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns
of `documents`, but for the last, which returns each remaining row's token count and digests. run()
writes each stage as Parquet to the shared folder and reads it again, so that a lost executor never
costs more than the stage at hand; what a stage has read is deleted once the stage is written.

Cases, in all stages: null and empty texts score as clean, are near-duplicates of one another (the one with
the least doc_id stays), hold no personal data, and, having no words, are not taken by the mix. Repeated rows
are near-duplicates. A null doc_id counts as the greatest. Extra columns stay up to the last stage, whatever
they are called. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import bpe, mixing, pii, shingle_sets, simhash, toxicity
from blockloom.llm.common import drop_path, shared_path
from blockloom.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of those at hand, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of 5-word shingles: the one with the least doc_id."""
    return simhash.keep_one(docs, shingle_sets.near_duplicates(docs))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates in place of personal data and secrets."""
    return pii.replace_pii(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, for each row."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_pii),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: No SQL gives these rows: fingerprints, kernel scores and BPE are beyond it. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
