"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows.

All run over whole tables and whole texts. Round trips return length and MD5 of what was restored, which
the SQL takes from the raw column. Coders work on blocks of the planned size, 4 MiB at least; where SQL spells
a stage out byte by byte, blocks are of 1 KiB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codec import tree
from .codec.container import AUTO_LEAST
from .functions import columns as c
from .operators import stages
from .plans import archive
from .session import cut, shared_path, spread, table
from .streaming import encode as incremental

KIB = 1024
#: Documents of so many consecutive ids of a source make one stream, however many a source has.
PART = 65_536


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.binary_stream(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source as streams, in order of doc_id, one for each PART ids."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", F.floor(F.col("doc_id") / PART)).alias("stream"), "doc_id", F.encode("text", "UTF-8").alias("content"))
    return stages.kernels.ready(docs).groupBy("stream").agg(stages.in_order("doc_id", "content").alias("content"))


def _digest(rows: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    return rows.select(F.col("stream").alias(key), F.length(content).cast("long").alias("n"), F.md5(content).alias("digest"))


def _roundtrip(stage: str, block: int) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks = stages.split_blocks(_documents(spark, sf_dir), block)
        return _digest(stages.join_blocks(stages.roundtrip(blocks, stage).select("stream", "block_index", "bytes")))

    query.__doc__ = f"Documents coded and restored by stage {stage}, in blocks of {block} bytes."
    return query


def _block_roundtrip(name: str, key: str, column: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        if name == "conversations":
            rows = rows.withColumn("k", F.concat_ws(":", "conv_id", "turn"))
        blocks = stages.split_blocks(stages.binary_stream(rows, key, column), AUTO_LEAST)
        back = stages.decode(stages.encode(blocks))
        return _digest(stages.join_blocks(back.where("error IS NULL")), "key")

    query.__doc__ = f"{name}.{column} through the block coder and back."
    return query


def source_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams and bytes of each source."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def block_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block size, count and slot bits for sources, with sizes scaled to cover all ranges."""
    sizes = source_size(spark, sf_dir).select("source", "bytes", F.explode(F.array(*(F.lit(10**k).cast("long") for k in range(6)))).alias("factor"))
    n = F.col("bytes") * F.col("factor")
    plain, ratio = c.block_size(n), c.block_size(n, "ratio")
    return sizes.select("source", n.alias("n"), plain.alias("block"), ratio.alias("ratio_block"), c.block_count(n, plain).alias("blocks"), c.hash_bits(n).alias("bits"), c.valid_block_size(n).alias("valid"))


def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in blocks of 1 KiB."""
    blocks = stages.split_blocks(_documents(spark, sf_dir), KIB)
    return blocks.select(F.col("stream").alias("doc_id"), "block_index", F.length("bytes").cast("long").alias("n"), F.md5(F.hex("bytes")).alias("digest"))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document."""
    return stages.byte_counts(stages.split_blocks(_documents(spark, sf_dir), 64 * KIB)).withColumnRenamed("stream", "doc_id")


def rarest_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker of each document."""
    streams = _documents(spark, sf_dir)
    return stages.rarest_bytes(stages.byte_counts(stages.split_blocks(streams, 64 * KIB)), streams).withColumnRenamed("stream", "doc_id")


def adler32_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of blocks of 1 KiB."""
    return stages.adler32(stages.split_blocks(_documents(spark, sf_dir), KIB)).withColumnRenamed("stream", "doc_id")


def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the suffixes in blocks of 1 KiB."""
    done = stages.suffix_order(stages.split_blocks(_documents(spark, sf_dir), KIB))
    return done.select(F.col("stream").alias("doc_id"), "block_index", F.size("order").cast("long").alias("n"), F.md5(F.array_join("order", ",")).alias("digest"))


def bwt_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last column and primary index in blocks of 1 KiB."""
    done = stages.bwt(stages.split_blocks(_documents(spark, sf_dir), KIB))
    return done.select(F.col("stream").alias("doc_id"), "block_index", "primary_index", F.md5(F.hex("data")).alias("digest"))


def lf_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by (byte, place) in blocks of 1 KiB."""
    return stages.lf_mapping(stages.split_blocks(_documents(spark, sf_dir), KIB)).select(F.col("stream").alias("doc_id"), "block_index", F.col("size").alias("n"), "checksum")


def mtf_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency ranks in blocks of 1 KiB."""
    done = stages.recency_ranks(stages.split_blocks(_documents(spark, sf_dir), KIB))
    return done.select(F.col("stream").alias("doc_id"), "block_index", F.md5(F.hex("ranks")).alias("digest"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run_islands(stages.split_blocks(_documents(spark, sf_dir), 64 * KIB), 64 * KIB)


def run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal bytes in documents: how many of each length."""
    return _runs(spark, sf_dir).groupBy("byte", "length").agg(F.count("*").alias("n"))


def run_symbol_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run symbols of documents' bytes with both spellings."""
    return _runs(spark, sf_dir).groupBy(F.col("stream").alias("doc_id")).agg(*(F.sum(c.run_symbol_count(F.col("byte"), F.col("length"), k)).alias(f"symbols_{k}") for k in (2, 3)))


def run_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run digits of documents' lengths."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", c.run_digits(n).alias("digits"), c.varint_bytes(n).alias("varint"), c.varint_bytes(n * n * 100).alias("long_varint"))


def lzp_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of documents' 8-byte contexts and the places they predict, summed up by document."""
    found = stages.slot_predictions(_documents(spark, sf_dir))
    checksum = F.sum(F.col("pos") * F.coalesce("predicted", F.lit(0))).cast("long")
    return found.groupBy(F.col("stream").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("slot").cast("long").alias("slots"), F.count("predicted").alias("predicted"), checksum.alias("checksum"))


def lzp_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of documents whose next 128 bytes are those that their slot predicts."""
    return stages.long_matches(_documents(spark, sf_dir)).withColumnRenamed("stream", "doc_id")


def lzp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents, collapsed as one stream for each PART ids and restored."""
    return _digest(stages.collapse_streams(_by_source(spark, sf_dir)), "source", "bytes")


def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as one stream for each PART ids, through the block coder in blocks of 4 MiB and back."""
    blocks = stages.split_blocks(_by_source(spark, sf_dir), AUTO_LEAST)
    return _digest(stages.join_blocks(stages.decode(stages.encode(blocks, stages.FINE)).where("error IS NULL")), "source")


def mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the documents' blocks table."""
    return archive.block_statistics(stages.encode(stages.split_blocks(_documents(spark, sf_dir), AUTO_LEAST)))


def codec_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each source's streams in blocks of 4 MiB by this coder and by gzip, bzip2 and xz."""
    sizes = stages.compare_codecs(stages.split_blocks(_by_source(spark, sf_dir), AUTO_LEAST))
    return sizes.agg(*(F.sum(k).alias(k) for k in ("size", "own", "gzip", "bzip2", "xz")))


def select_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least of four codings, ties by order, raw where none is shorter: the engine's rule on sizes made of part keys."""
    parts = table(spark, sf_dir, "part")
    sizes = [F.pmod(F.col("p_partkey") * m + F.col("p_size"), F.lit(97)).cast("long") for m in (31, 17, 13, 7)]
    chosen = parts.select("p_partkey", F.pmod(F.col("p_partkey") * 3, F.lit(90)).cast("long").alias("original"), F.array(*sizes).alias("sizes"))
    chosen = chosen.withColumn("coding", c.least_coding([F.col("sizes")[i] for i in range(4)], F.col("original")))
    return chosen.select("p_partkey", "coding", F.when(F.col("coding") < 0, F.col("original")).otherwise(F.get("sizes", F.col("coding").cast("int"))).alias("payload"))


def stream_lzp_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stream pass stays: the engine's rule on sizes made of order keys."""
    k = F.col("o_orderkey")
    sizes = table(spark, sf_dir, "orders").select("o_orderkey", (k * 7 % 1000 + 1000).alias("n"), (k * 13 % 1000 + 900).alias("collapsed"), (k * 11 % 700).alias("with_pass"), (k * 5 % 700).alias("without"))
    n, short = F.col("n"), F.col("collapsed")
    return sizes.select("o_orderkey", c.stream_pass_decisive(n, short).alias("decisive"), c.stream_pass_kept(n, short, F.col("with_pass"), F.col("without")).alias("kept"))


def ratio_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio, savings and printed sizes, of sizes made of documents' lengths."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(c.ratio(n, F.floor(n / 3)), 6).alias("ratio"), F.round(c.savings_percent(n, F.floor(n / 3)), 6).alias("saved"), c.format_bytes(n).alias("small"), c.format_bytes(n * 4096).alias("middle"), c.format_bytes(n * 4194304).alias("large"))


def pack_block_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header bytes of made-up blocks, in hexadecimal."""
    k = F.col("l_orderkey") * 1009 + F.col("l_linenumber")
    part = lambda m: F.pmod(k * m, F.lit(1 << 32)).cast("long")
    packed = c.block_header_hex(F.pmod(k, F.lit(3)).cast("long"), F.pmod(k, F.lit(2)) == 1, *(part(m) for m in (3, 5, 7, 11, 13)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", packed.alias("header"))


def pack_file_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header bytes of made-up archives, with and without the stream pass, in hexadecimal."""
    k = F.col("o_orderkey")
    part = lambda m, n=32: F.pmod(k * m, F.lit(1 << n)).cast("long")
    packed = c.file_header_hex(part(3), part(1_000_003, 48), part(5), part(1, 1) == 1, F.pmod(k, F.lit(3)) == 0, part(999_983, 40), part(7), F.pmod(k, F.lit(7)) + 20)
    return table(spark, sf_dir, "orders").select("o_orderkey", packed.alias("header"))


def verify_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with made-up block headers."""
    k = F.col("l_orderkey") * 1009 + F.col("l_linenumber")
    part = lambda m, n: F.pmod(k * m, F.lit(n)).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (part(3, 2) + 1).alias("version"), part(5, 4).alias("mode"), (part(7, 3) == 0).alias("lzp"), part(11, 60).alias("original"), part(13, 60).alias("payload"), part(17, 60).alias("primary"), part(19, 60).alias("middle"))
    error = c.header_error(*(F.col(x) for x in ("version", "mode", "lzp", "original", "payload", "primary", "middle")))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(error, F.lit("")).alias("error"))


def _stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "source", "lang", F.repeat(F.lit("d"), (F.col("doc_id") * 37 % 260).cast("int")), F.concat("doc_id", F.lit(".txt")))
    return docs.select("doc_id", name.alias("name"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))


def tar_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of documents in a tar stream, names up to 280 characters.

    Narrow rows are dealt by ranges of the name and kept; a running sum over one row a range places each.
    """
    named = _stored_names(spark, sf_dir).withColumn("taken", c.tar_bytes(F.col("name"), F.col("size")))
    dealt = cut(named.repartitionByRange("name").withColumn("range", F.spark_partition_id()))
    ranges = dealt.groupBy("range").agg(F.sum("taken").alias("all"))
    starts = ranges.select("range", (F.sum("all").over(Window.orderBy("range")) - F.col("all")).alias("start"))
    before = F.sum("taken").over(Window.partitionBy("range").orderBy("name")) - F.col("taken")
    placed = dealt.withColumn("before", before).join(starts, "range")
    return placed.select("doc_id", F.col("taken").alias("bytes"), (F.col("start") + F.col("before")).alias("offset"), c.needs_long_name(F.col("name")).alias("long"), c.octal_size(F.col("size")).alias("octal"))


def tar_total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each source's tar stream."""
    named = _stored_names(spark, sf_dir).withColumn("source", F.split("name", "/")[0])
    return named.groupBy("source").agg((F.sum(c.tar_bytes(F.col("name"), F.col("size"))) + 2 * tree.RECORD).alias("bytes"))


def tar_path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether paths made of page addresses may be extracted."""
    pages = table(spark, sf_dir, "pages")
    tails = F.array(*map(F.lit, ("a/b.txt", "../up", "./x//y", "/abs", "", "a/../b", "CON", "lpt1.txt", "end.", "c:d")))
    each = pages.select("page_id", "url", F.posexplode(tails).alias("nth", "tail"))
    path = F.when(F.col("nth") % 2 == 0, F.col("tail")).otherwise(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), "tail"))
    return each.select("page_id", F.col("nth").cast("long").alias("nth"), c.safe_path(path).alias("safe"), c.safe_windows_name(path).alias("windows"))


def tar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in one tar stream for each PART ids of a source, parsed again."""
    docs = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / PART).alias("part"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))

    def run(key, group):
        import pyarrow as pa

        entries = [tree.Entry(f"{d}.txt", False, x) for d, x in zip(group.column("doc_id").to_pylist(), group.column("content").to_pylist(), strict=True)]
        found = tree.parse(tree.write(entries))
        return pa.table({"stream": pa.array([int(e.path[:-4]) for e in found], pa.int64()), "content": pa.array([e.content for e in found], pa.binary())})

    return _digest(docs.groupBy("source", "part").applyInArrow(run, "stream long, content binary"))


def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as containers with blocks of 16 KiB, stream pass included, verified and restored."""
    back = archive.restored(archive.archives(_documents(spark, sf_dir), 16 * KIB))
    return _digest(back.where("error IS NULL"))


#: Ways to damage an archive: where bytes are replaced (from the end if negative), and by what in hexadecimal.
_DAMAGE = ((0, "4D5A4951"), (4, "09"), (5, "F0"), (6, "01"), (8, "01000000"), (8, "FFFFFFFF"), (20, "FFFFFF7F"), (24, "07"), (25, "F0"), (26, "01"), (28, "FFFFFFFF"), (32, "00000000"), (32, "FFFFFF7F"), (44, "00"))


def verify_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with archives of documents, most of which are damaged on purpose, each way in turn."""
    good = archive.archives(_documents(spark, sf_dir).where(F.length("content") > 0), 1 << 30)
    way = F.pmod(F.col("stream"), F.lit(len(_DAMAGE) + 3))
    raw, n = F.col("archive"), F.length("archive")
    bad = F.when(way == 1, F.substring(raw, F.lit(1), n - 1)).when(way == 2, F.concat(raw, F.unhex(F.lit("00"))))
    for i, (place, by) in enumerate(_DAMAGE, 3):
        old = F.substring(raw, place + 1, len(by) // 2)
        new = F.unhex(F.lit(by)) if by != "00" else F.unhex(F.lpad(F.hex(F.conv(F.hex(old), 16, 10).cast("long").bitwiseXOR(F.lit(255))), 2, "0"))
        bad = bad.when(way == i, F.concat(F.substring(raw, 1, place), new, F.substring(raw, F.lit(place + len(by) // 2 + 1), n)))
    found = archive.verify(good.select("stream", bad.otherwise(raw).alias("archive")))
    return found.select(F.col("stream").alias("doc_id"), F.coalesce("error", F.lit("")).alias("error"))


def partition_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents coded each in one partition and over many: blocks of either, and those on which they differ or that one lacks.

    One partition for all documents would be one task, however many machines there are.
    """
    docs = _documents(spark, sf_dir)
    one = stages.with_coded(stages.split_blocks(stages.deal(docs, "stream"), 16 * KIB))
    many = stages.encode(stages.split_blocks(docs, 16 * KIB))
    many, one = (b.select("stream", "block_index", F.md5("payload").alias(name)) for b, name in ((many, "in_many"), (one, "in_one")))
    both = one.join(many, ["stream", "block_index"], "full")
    return both.agg(F.count("in_one").alias("in_one"), F.count("in_many").alias("in_many"), F.count_if(~F.col("in_one").eqNullSafe(F.col("in_many"))).alias("differ"))


def incremental_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents coded as a stream of new rows, then restored from the blocks table."""
    target, checkpoint = shared_path(spark, "blocks"), shared_path(spark, "progress")
    incremental.encode_new(spark, f"{sf_dir}/documents.parque[t]", "doc_id", "text", target, checkpoint).awaitTermination()  # a pattern, as streams take no single file
    return _digest(stages.join_blocks(stages.decode(spark.read.parquet(target)).where("error IS NULL")))


# --- SQL ---

_BYTE = "((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)"


def _bytes_sql(name: str, key: str) -> str:
    return f"""pairs AS (SELECT {key} AS k, regexp_extract_all(hex(encode(text)), '..') AS hs FROM {name}),
      split AS (SELECT k, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM pairs),
      bytes AS (SELECT k, pos, CAST({_BYTE} AS BIGINT) AS byte FROM split)"""


def _raw_sql(name: str, key: str, column: str, alias: str) -> str:
    return f"SELECT {key} AS {alias}, CAST(strlen(coalesce({column}, '')) AS BIGINT) AS n, md5(coalesce({column}, '')) AS digest FROM {name}"


def _some_sql(name: str, key: str, column: str, alias: str) -> str:
    """The same, for round trips by blocks, of which an empty text has none."""
    return f"{_raw_sql(name, key, column, alias)} WHERE strlen({column}) > 0"


_TURN = "concat(conv_id, ':', turn)"
_STREAM = f"source || ':' || (doc_id // {PART})"
_RUNS = "islands AS (SELECT k, byte, pos - row_number() OVER (PARTITION BY k, byte ORDER BY pos) AS g FROM bytes), runs AS (SELECT k, byte, count(*) AS length FROM islands GROUP BY k, byte, g)"
_PARTS = """d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) > 0),
  e AS (SELECT doc_id, h, unnest(range((strlen(h) // 2 - 1) // 1024 + 1)) AS block_index FROM d),
  parts AS (SELECT doc_id, block_index, substr(h, 2048 * block_index + 1, 2048) AS part FROM e)"""
_SUFFIXES = f"""{_PARTS}, each AS (SELECT doc_id, block_index, part, unnest(range(strlen(part) // 2)) AS pos FROM parts),
  ranked AS (SELECT doc_id, block_index, part, pos, row_number() OVER (PARTITION BY doc_id, block_index ORDER BY substr(part, 2 * pos + 1)) AS rank FROM each)"""
_SYMBOLS = "CASE WHEN byte = 0 THEN length(bin(length + 1)) - 1 WHEN length < {k} THEN length ELSE length(bin(length)) END"
_NAMES = """named AS (SELECT doc_id, source, concat_ws('/', source, lang, repeat('d', CAST(doc_id * 37 % 260 AS INT)), doc_id || '.txt') AS name, strlen(coalesce(text, '')) AS size FROM documents),
  cut AS (SELECT *, length(name) AS l, CASE WHEN contains(substr(name, 1, 156), '/') THEN least(length(name), 156) - instr(reverse(substr(name, 1, 156)), '/') + 1 ELSE 0 END AS slash FROM named),
  flagged AS (SELECT *, l > 100 AND NOT (slash > 1 AND l - slash BETWEEN 1 AND 100) AS long FROM cut),
  sized AS (SELECT *, CAST(512 + size + (512 - size % 512) % 512 + CASE WHEN long THEN 512 + l + 1 + (512 - (l + 1) % 512) % 512 ELSE 0 END AS BIGINT) AS bytes FROM flagged)"""


def _le(value: str, width: int) -> str:
    digits = f"lpad(printf('%X', {value}), {2 * width}, '0')"
    return " || ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in range(width - 1, -1, -1))


def _size_text(value: str) -> str:
    return f"CASE WHEN {value} >= 1073741824 THEN printf('%.2f GiB', {value} / 1073741824.0) WHEN {value} >= 1048576 THEN printf('%.2f MiB', {value} / 1048576.0) WHEN {value} >= 1024 THEN printf('%.2f KiB', {value} / 1024.0) ELSE {value} || ' B' END"


_K = "(l_orderkey * 1009 + l_linenumber)"
ORACLE_SQL: dict[str, str] = {
    "source_size": "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source",
    "block_plan": """WITH s AS (SELECT source, CAST(sum(strlen(text)) AS BIGINT) * unnest([1, 10, 100, 1000, 10000, 100000]) AS n FROM documents GROUP BY source),
      b AS (SELECT source, n, least(greatest(n // 16, 4194304), 16777216) AS block, least(greatest(n, 1024), 1073741824) AS ratio_block FROM s)
      SELECT source, n, block, ratio_block, CASE WHEN n = 0 THEN 0 ELSE (n - 1) // block + 1 END AS blocks,
        CAST(least(26, greatest(20, ceil(log2(n / 4.0)))) AS BIGINT) AS bits, n BETWEEN 1024 AND 1073741824 AS valid FROM b""",
    "block_split": f"WITH {_PARTS} SELECT doc_id, block_index, CAST(strlen(part) // 2 AS BIGINT) AS n, md5(part) AS digest FROM parts",
    "suffix_array": f"WITH {_SUFFIXES} SELECT doc_id, block_index, count(*) AS n, md5(string_agg(pos, ',' ORDER BY rank)) AS digest FROM ranked GROUP BY ALL",
    "bwt_encode": f"""WITH {_SUFFIXES}, rows AS (SELECT doc_id, block_index, 0 AS rank, right(part, 2) AS b, NULL AS p FROM parts
        UNION ALL SELECT doc_id, block_index, rank, CASE WHEN pos > 0 THEN substr(part, 2 * pos - 1, 2) END, CASE WHEN pos = 0 THEN rank END FROM ranked)
      SELECT doc_id, block_index, max(p) AS primary_index, md5(string_agg(b, '' ORDER BY rank)) AS digest FROM rows GROUP BY ALL""",
    "mtf_ranks": f"""WITH {_bytes_sql('documents', 'doc_id')}, b AS (SELECT k, pos // 1024 AS block_index, pos % 1024 AS pos, byte FROM bytes),
      s AS (SELECT *, lag(pos) OVER w AS before, coalesce(lead(pos) OVER w, 1024) AS after FROM b WINDOW w AS (PARTITION BY k, block_index, byte ORDER BY pos)),
      r AS (SELECT x.k, x.block_index, x.pos, count(y.pos) + CASE WHEN any_value(x.before) IS NULL THEN any_value(x.byte) ELSE 0 END AS rank
        FROM s x LEFT JOIN s y ON x.k = y.k AND x.block_index = y.block_index AND y.pos < x.pos AND y.after >= x.pos AND CASE WHEN x.before IS NULL THEN y.byte > x.byte ELSE y.pos > x.before END
        GROUP BY x.k, x.block_index, x.pos)
      SELECT k AS doc_id, block_index, md5(string_agg(printf('%02X', rank), '' ORDER BY pos)) AS digest FROM r GROUP BY ALL""",
    "byte_histogram": f"WITH {_bytes_sql('documents', 'doc_id')} SELECT k AS doc_id, byte, count(*) AS n FROM bytes GROUP BY ALL",
    "rarest_byte": f"""WITH {_bytes_sql('documents', 'doc_id')}, counts AS (SELECT k, byte, count(*) AS n FROM bytes GROUP BY ALL),
      every AS (SELECT doc_id AS k, unnest(range(256)) AS byte FROM documents)
      SELECT e.k AS doc_id, arg_min(e.byte, coalesce(n, 0) * 256 + e.byte) AS marker FROM every e LEFT JOIN counts c ON e.k = c.k AND e.byte = c.byte GROUP BY e.k""",
    "adler32_block": f"""WITH {_bytes_sql('documents', 'doc_id')}, b AS (SELECT k, pos // 1024 AS block_index, pos % 1024 AS i, byte FROM bytes),
      s AS (SELECT k, block_index, count(*) AS n, sum(byte) AS a, sum(i * byte) AS w FROM b GROUP BY ALL)
      SELECT k AS doc_id, block_index, n AS size, CAST((n + n * a - w) % 65521 * 65536 + (1 + a) % 65521 AS BIGINT) AS checksum FROM s""",
    "lf_mapping": f"""WITH {_bytes_sql('documents', 'doc_id')}, b AS (SELECT k, pos // 1024 AS block_index, pos % 1024 AS i, byte FROM bytes),
      r AS (SELECT k, block_index, i, row_number() OVER (PARTITION BY k, block_index ORDER BY byte, i) AS rank FROM b)
      SELECT k AS doc_id, block_index, count(*) AS n, CAST(sum(rank * i) AS BIGINT) AS checksum FROM r GROUP BY ALL""",
    "run_islands": f"WITH {_bytes_sql('documents', 'doc_id')}, {_RUNS} SELECT byte, length, count(*) AS n FROM runs GROUP BY ALL",
    "run_symbol_count": f"WITH {_bytes_sql('documents', 'doc_id')}, {_RUNS} SELECT k AS doc_id, CAST(sum({_SYMBOLS.format(k=2)}) AS BIGINT) AS symbols_2, CAST(sum({_SYMBOLS.format(k=3)}) AS BIGINT) AS symbols_3 FROM runs GROUP BY k",
    "run_digits": """SELECT doc_id, translate(reverse(substr(bin(n_chars + 1), 2)), '01', 'AB') AS digits,
      CAST(CASE WHEN n_chars < 128 THEN 1 WHEN n_chars < 16384 THEN 2 WHEN n_chars < 2097152 THEN 3 ELSE 4 END AS BIGINT) AS varint,
      CAST(greatest(1, ceil(length(bin(n_chars * n_chars * 100)) / 7.0)) AS BIGINT) AS long_varint FROM documents""",
    "lzp_predictor": f"""WITH {_bytes_sql('documents', 'doc_id')}, contexts AS (
        SELECT k, pos + 1 AS pos, CAST(byte AS HUGEINT) + 256 * lag(byte, 1) OVER w + 65536 * lag(byte, 2) OVER w + 16777216 * lag(byte, 3) OVER w
          + 4294967296::HUGEINT * (lag(byte, 4) OVER w + 256 * lag(byte, 5) OVER w + 65536 * lag(byte, 6) OVER w + 16777216 * lag(byte, 7) OVER w) AS context,
          lead(byte) OVER w AS here FROM bytes WINDOW w AS (PARTITION BY k ORDER BY pos)),
      hashed AS (SELECT k, pos, CAST(((CAST(context AS UHUGEINT) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) // 17592186044416 AS BIGINT) AS slot FROM contexts WHERE pos >= 8 AND here IS NOT NULL AND context IS NOT NULL),
      found AS (SELECT k, pos, slot, lag(pos) OVER (PARTITION BY k, slot ORDER BY pos) AS predicted FROM hashed)
      SELECT k AS doc_id, count(*) AS n, CAST(sum(slot) AS BIGINT) AS slots, count(predicted) AS predicted, CAST(sum(pos * coalesce(predicted, 0)) AS BIGINT) AS checksum FROM found GROUP BY k""",
    **{name: f"SELECT {_STREAM} AS source, CAST(sum(strlen(text)) AS BIGINT) AS n, md5(string_agg(text, '' ORDER BY doc_id)) AS digest FROM documents GROUP BY ALL" for name in ("lzp_roundtrip", "stream_roundtrip")},
    "select_candidate": """WITH s AS (SELECT p_partkey, p_partkey * 3 % 90 AS original, [(p_partkey * 31 + p_size) % 97, (p_partkey * 17 + p_size) % 97, (p_partkey * 13 + p_size) % 97, (p_partkey * 7 + p_size) % 97] AS z FROM part)
      SELECT p_partkey, CAST(CASE WHEN list_min(z) < original THEN list_position(z, list_min(z)) - 1 ELSE -1 END AS BIGINT) AS coding, CAST(least(list_min(z), original) AS BIGINT) AS payload FROM s""",
    "stream_lzp_decision": """WITH s AS (SELECT o_orderkey, o_orderkey * 7 % 1000 + 1000 AS n, o_orderkey * 13 % 1000 + 900 AS collapsed, o_orderkey * 11 % 700 AS a, o_orderkey * 5 % 700 AS b FROM orders)
      SELECT o_orderkey, collapsed < n - n // 10 AS decisive, collapsed < n AND (collapsed < n - n // 10 OR a + 16 < b) AS kept FROM s""",
    "ratio_savings": f"""SELECT doc_id, round(CASE WHEN n_chars = 0 THEN 0.0::DOUBLE ELSE (n_chars // 3)::DOUBLE / n_chars END, 6) AS ratio,
      round(CASE WHEN n_chars = 0 THEN 0.0::DOUBLE ELSE (1 - (n_chars // 3)::DOUBLE / n_chars) * 100 END, 6) AS saved, {_size_text('n_chars')} AS small, {_size_text('(n_chars * 4096)')} AS middle, {_size_text('(n_chars * 4194304)')} AS large FROM documents""",
    "pack_block_header": f"SELECT l_orderkey, l_linenumber, {_le(f'{_K} % 3', 1)} || {_le(f'{_K} % 2', 1)} || '0000' || {' || '.join(_le(f'({_K} * {m} % 4294967296)', 4) for m in (3, 5, 7, 11, 13))} AS header FROM lineitem",
    "pack_file_header": f"""WITH s AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS stream, 4294967296 AS m FROM orders)
      SELECT o_orderkey, '4D5A495002' || printf('%02X', o_orderkey % 2 + CASE WHEN stream THEN 2 ELSE 0 END) || '0000' || {_le('(o_orderkey * 3 % m)', 4)} || {_le('(o_orderkey * 1000003 % 281474976710656)', 8)} || {_le('(o_orderkey * 5 % m)', 4)}
        || CASE WHEN stream THEN {_le('(o_orderkey * 999983 % 1099511627776)', 8)} || {_le('(o_orderkey * 7 % m)', 4)} || {_le('(o_orderkey % 7 + 20)', 1)} || '000000' ELSE '' END AS header FROM s""",
    "verify_headers": f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_K} * 3 % 2 + 1 AS version, {_K} * 5 % 4 AS mode, {_K} * 7 % 3 = 0 AS lzp, {_K} * 11 % 60 AS original, {_K} * 13 % 60 AS payload, {_K} * 17 % 60 AS prim, {_K} * 19 % 60 AS middle FROM lineitem)
      SELECT l_orderkey, l_linenumber, CASE WHEN mode > CASE WHEN version = 1 THEN 1 ELSE 2 END THEN 'unknown block mode' WHEN lzp AND version = 1 THEN 'unknown block flags'
        WHEN payload = 0 OR payload > original THEN 'impossible payload size' WHEN mode = 0 AND (payload <> original OR prim <> 0 OR middle <> 0 OR lzp) THEN 'invalid raw block'
        WHEN mode = 1 AND (lzp OR prim NOT BETWEEN 1 AND original OR middle NOT BETWEEN 1 AND original) THEN 'invalid ranked block'
        WHEN mode = 2 AND (prim NOT BETWEEN 1 AND CASE WHEN lzp THEN middle ELSE original END OR CASE WHEN lzp THEN middle >= original ELSE middle <> 0 END) THEN 'invalid mixed block' ELSE '' END AS error FROM s""",
    "tar_layout": f"WITH {_NAMES} SELECT doc_id, bytes, CAST(sum(bytes) OVER (ORDER BY name) - bytes AS BIGINT) AS offset, long, lpad(printf('%o', size), 11, '0') AS octal FROM sized",
    "tar_total_size": f"WITH {_NAMES} SELECT source, CAST(sum(bytes) + 1024 AS BIGINT) AS bytes FROM sized GROUP BY source",
    "tar_path_safety": r"""WITH t AS (SELECT page_id, url, unnest(['a/b.txt', '../up', './x//y', '/abs', '', 'a/../b', 'CON', 'lpt1.txt', 'end.', 'c:d']) AS tail, unnest(range(10)) AS nth FROM pages),
      p AS (SELECT page_id, nth, CASE WHEN nth % 2 = 0 THEN tail ELSE regexp_replace(url, '^[a-z]+://', '') || '/' || tail END AS path FROM t),
      q AS (SELECT *, list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM p)
      SELECT page_id, nth, path <> '' AND NOT regexp_matches(path, '^[/\\]|^.:') AND NOT list_contains(parts, '..') AND len(parts) > 0 AS safe,
        len(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '[\x00-\x1f<>:"|?*]|[ .]$|^(?i:con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$'))) = 0 AS windows FROM q""",
    "tar_roundtrip": _raw_sql("documents", "doc_id", "text", "doc_id"),
    "archive_roundtrip": _raw_sql("documents", "doc_id", "text", "doc_id"),
    "verify_archives": f"""SELECT doc_id, ['', 'truncated block payload', 'bytes after the end of the archive', 'not an archive', 'unknown version', 'unknown archive flags', 'unknown archive flags',
        'block size out of range', 'block size out of range', 'unexpected block count', 'unknown block mode', 'unknown block flags', 'unknown block flags', 'unexpected block size', 'bytes after the end of the archive',
        'truncated block payload', 'block checksum mismatch'][doc_id % 17 + 1] AS error FROM documents WHERE strlen(text) > 0""",
    "partition_invariance": "SELECT CAST(sum((strlen(text) + 16383) // 16384) AS BIGINT) AS in_one, CAST(sum((strlen(text) + 16383) // 16384) AS BIGINT) AS in_many, CAST(0 AS BIGINT) AS differ FROM documents",
    "incremental_roundtrip": _some_sql("documents", "doc_id", "text", "doc_id"),
    **{f"{stage}_roundtrip": _some_sql("documents", "doc_id", "text", "doc_id") for stage in ("bwt", "mtf", "rc", "cm", "block")},
    "pages_roundtrip": _some_sql("pages", "page_id", "html", "key"),
    "turns_roundtrip": _some_sql("conversations", _TURN, "text", "key"),
    "props_roundtrip": _some_sql("events", "event_id", "props", "key"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (source_size, block_plan, block_split, byte_histogram, rarest_byte, adler32_block, suffix_array, bwt_encode, lf_mapping, mtf_ranks, run_islands, run_symbol_count, run_digits, lzp_predictor, lzp_matches, lzp_roundtrip, stream_roundtrip, mode_counts, codec_comparison, select_candidate, stream_lzp_decision, ratio_savings, pack_block_header, pack_file_header, verify_headers, tar_layout, tar_total_size, tar_path_safety, tar_roundtrip, archive_roundtrip, verify_archives, partition_invariance, incremental_roundtrip)
}
QUERIES |= {f"{stage}_roundtrip": _roundtrip(stage, AUTO_LEAST) for stage in ("bwt", "mtf", "rc", "cm", "block")}
QUERIES |= {"pages_roundtrip": _block_roundtrip("pages", "page_id", "html"), "turns_roundtrip": _block_roundtrip("conversations", "k", "text"), "props_roundtrip": _block_roundtrip("events", "event_id", "props")}
