"""Mixing sources to target weights (operator 10).

Every document gets a hash-random key. Keys are uniform, so their leading hexadecimal digits are
range splitters that need no sample: each (source, digits) bucket is one range of the source's order,
small whatever share of the rows a source holds. A prefix sum over bucket totals plus one inside each
bucket places every document in its source's word stream, and each source is cut at its exact budget.

Cases. Null or wordless text: size 0, nothing taken. Null source: a source of its own, ordered last.
Null or repeated doc_id: ordered by the text's hash next; rows equal in both are interchangeable.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hex_digits, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MAX_EPOCHS = 3
SEED = "mix-1"


def order_key(doc_id: Column, seed: str = SEED) -> Column:
    """The hash-random key: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target (double) and budget (long) to rows of (source, source_size).

    Water filling: all targets are one level times the weight, but none above max_epochs times its
    source's size. With sources by rising ratio of that limit to the weight, the limited ones come
    first, and the level follows from running sums, in integers. One row per source is all that the
    unpartitioned windows see.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("most"), F.sum("source_size").over(everything).alias("all_size"))
    running = ranked.select(
        "*",
        F.row_number().over(by_ratio).alias("place"),
        (F.col("all_size") - F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most")).alias("left"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    free = F.min(F.when(F.col("left") * F.col("weight") <= F.col("most") * F.col("rest"), F.col("place"))).over(everything)
    level = running.select("*", free.alias("first_free"))
    at = lambda c: F.max(F.when(F.col("place") == F.col("first_free"), F.col(c))).over(everything)
    limited = F.col("first_free").isNull() | (F.col("place") < F.col("first_free"))
    return level.select("source", "source_size", "weight", "most", limited.alias("limited"), at("left").alias("num"), at("rest").alias("den")).select(
        "source",
        "source_size",
        F.when(F.col("limited"), F.col("most").cast("double")).otherwise((F.col("num") * F.col("weight")).cast("double") / F.col("den")).alias("target"),
        F.when(F.col("limited"), F.col("most")).otherwise(F.expr("(num * weight) div den")).alias("budget"),
    )


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, key, text_key, size, source_size, target, taken), one per document.

    `taken` counts the words the mix takes of the document: whole epochs for all of its source, then
    one more pass in key order up to the budget, where the last document is taken in part.
    """
    name = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            name.alias("source_key"),
            word_count(F.col("text")).alias("size"),
            order_key(F.col("doc_id"), seed).alias("key"),
            F.md5(F.coalesce("text", F.lit(""))).alias("text_key"),
        )
    )
    digits = hex_digits(sized.count())
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    sums = sized.groupBy("source_key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    totals = sums.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs).withColumn("source_key", name).drop("source")
    before = F.sum("bucket_size").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("bucket_size")
    starts = sums.select("source_key", "bucket", before.alias("bucket_start")).join(targets, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(starts, ["source_key", "bucket"])
    epochs = F.expr("CASE WHEN source_size = 0 THEN 0 ELSE budget div source_size END")
    last = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("bucket_start") - F.col("inside")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last))
    return placed.withColumn("epochs", epochs).select("doc_id", "key", "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix has them: a row for each whole pass, and one for the cut pass.

    A cut document keeps its first words, joined by one space. Columns stay as they are; n_chars
    follows the text where the table has it. Rows alike in doc_id and text share out their counts.
    """
    seed = options.get("seed", SEED)
    mixed = mix_sources(docs, **options).groupBy("key", "text_key", "size").agg(F.sort_array(F.collect_list("taken")).alias("takes"))
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), order_key(F.col("doc_id"), seed).alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    alike = Window.partitionBy("key", "text_key").orderBy("key", "text_key")
    rows = rows.join(mixed, ["key", "text_key"]).withColumn("taken", F.element_at("takes", F.least(F.row_number().over(alike), F.size("takes"))))
    passes = rows.where("taken > 0").select("row", "size", F.explode(F.sequence(F.lit(1), F.expr("cast((taken + size - 1) div size as int)"))).alias("nth"), "taken")
    rest = F.col("taken") - (F.col("nth") - 1) * F.col("size")
    first_words = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), 1, rest.cast("int")), " ")
    text = F.when(rest >= F.col("size"), F.col("row.text")).otherwise(first_words)
    changed = {"text": F.col("new_text"), "n_chars": F.char_length("new_text").cast("long")}
    return passes.withColumn("new_text", text).select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))
