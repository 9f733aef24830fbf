"""Near-duplicates by the similarity of their sets of word shingles (the pipeline's stage; operator 2 has its own contract).

Two texts link where their sets of 5-word shingles have a Jaccard similarity of 0.8 or more, counted on
the whole sets. Equal sets are one node from the start.

1. Fingerprints: each set has `PRINTS` 64-bit SimHash fingerprints, each of hashes of its own. Fingerprints
   that share one of operator 2's Golay-code keys and differ in at most `DISTANCE` bits are linked by that
   operator; sets that hang together by such links, or by equal fingerprints, are compared in one task.
2. Sets at 0.8 differ in about 10 bits of 64, and in any number up to 20, so that Golay keys miss some pairs.
   These are met by 16 keys of 4 least hashes each: a pair at 0.8 shares one with probability 0.9998, a pair
   at 0.9 with 1 - 1e-7. What the fingerprints have linked isn't compared again, nor under the other 14 keys
   what two have.

The members of a key are compared in one task, by a spanning forest. A key with more than `BUCKET` members
is dealt over blocks that share some members; then, under least hashes, whatever is outside the key's largest
component meets every block, so no pair is left out.

Cases as for operator 2: null, empty and wordless texts have the empty set and are alike; under five words
the whole sequence is the one shingle; null doc_id never names a component unless all of it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, shuffle_partitions
from .common import cut, utf8
from .components import connected_components
from .simhash import fingerprint_links, print_of, row_key, shingle_hashes

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
#: Fingerprints of a set, and the bits in which linked ones may differ.
PRINTS, DISTANCE = 2, 12
BANDS, ROWS = 16, 4
#: Bands whose links are found first.
FIRST = 2
#: Members of a key that a task compares, and those that all blocks of a fuller key share.
BUCKET, HUBS = 256, 16
_DRAW = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_TIMES, _PLUS = _DRAW[0] << np.uint64(1) | np.uint64(1), _DRAW[1]
_SALTS = np.random.default_rng(6).integers(0, 1 << 63, PRINTS, dtype=np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, ascending."""
    return np.unique(shingle_hashes(text, SHINGLE))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The SimHash fingerprints (uint64) of a set, the first of its hashes as they are."""
    out = [print_of(hashes)]
    for salt in _SALTS[1:]:
        mixed = (hashes ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        out.append(print_of(mixed ^ mixed >> np.uint64(29)))
    return np.array(out, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key (uint64) for each band of least hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, at : at + 2048] * _TIMES + _PLUS).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64)


def alike(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether each of some sets is similar enough to one set."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), max(0, len(one) - 1))
    total = np.r_[0, np.cumsum(one[at] == flat if len(one) else np.zeros(len(flat), bool))]
    ends = np.cumsum(sizes)
    both = total[ends] - total[ends - sizes]
    over, under = SIMILAR
    return under * both >= over * (len(one) + sizes - both)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints, keys = [], [], []
        for text in utf8(batch.column("text")):
            hashes = shingle_set(text)
            nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
            prints.append(fingerprints(hashes).view(np.int64))
            keys.append(band_keys(hashes).view(np.int64))
        lists = [pa.ListArray.from_arrays(np.arange(len(nodes) + 1, dtype=np.int32) * n, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x, n in ((prints, PRINTS), (keys, BANDS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), *lists], ["doc_id", "row_key", "node", "prints", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingle_set(t).tobytes() for t in utf8(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), sets], ["node", "hashes"])


def _forest(members: dict[int, tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of some nodes' similarity graph; nodes of one root are linked already."""
    rest = list(members)
    while rest:
        queue = [rest.pop()]
        while queue and rest:
            root, hashes = members[at := queue.pop()]
            near = alike(hashes, [members[n][1] for n in rest]) | np.array([members[n][0] == root for n in rest])
            found, rest = [n for n, y in zip(rest, near, strict=True) if y], [n for n, y in zip(rest, near, strict=True) if not y]
            yield from ((max(at, n), min(at, n)) for n in found)
            queue.extend(found)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among the rows of each (key, block), which come sorted."""
    held, members = None, {}

    def rows() -> pa.RecordBatch:
        links = list(_forest(members))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("key", "block", "node", "root", "hashes"))
        for key, block, node, root, hashes in zip(*columns, strict=True):
            if (key, block) != held:
                yield rows()
                held, members = (key, block), {}
            members[node] = root, np.frombuffer(hashes, np.uint64)
    yield rows()


def _grouped(nodes: DataFrame) -> DataFrame:
    """Members (key, node, root, n) of groups of nodes (node, prints) that hang together by their fingerprints."""
    placed = nodes.select("node", F.explode("prints").alias("fp"))
    first = cut(placed.groupBy("fp").agg(F.min("node").alias("first")))
    close = fingerprint_links(first.select("fp"), DISTANCE).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    equal = placed.join(first, "fp").where("node <> first").select("node", "first")
    groups = cut(connected_components(close.select("x", "y").union(equal).toDF("a", "b")).toDF("node", "key"))
    counts = groups.groupBy("key").agg(F.count("*").alias("n"))
    return groups.join(counts, "key").withColumn("root", F.col("node"))


def _linked(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    parts = shuffle_partitions(sets.sparkSession)
    dealt = tasks.select("key", "block", "node", "root").join(sets, "node").repartition(parts, "key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (key, node, n) of keys that still have several components, each with its root."""
    named = cut(members.join(roots.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return named.join(mixed, "key")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (a, root) with more links (a, b): those found go in as stars, which takes fewer rounds than all links."""
    return connected_components(roots.toDF("a", "b").union(links))


def _parted(members: DataFrame) -> DataFrame:
    """With the number of blocks of the key and the member's own block."""
    parts = F.ceil(F.col("n") / BUCKET).cast("long")
    return members.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node", "key"), "parts"))


def _blocks(members: DataFrame) -> DataFrame:
    """Each member in its block, and the hubs of fuller keys in all blocks."""
    own = _parted(members)
    least = Window.partitionBy("key").orderBy("node")
    hubs = own.where(F.col("n") > BUCKET).withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= HUBS)
    spread = hubs.drop("block", "nth").withColumn("block", F.explode(F.expr("sequence(0L, parts - 1)")))
    return own.unionByName(spread)


def _across(members: DataFrame) -> DataFrame:
    """Whatever is outside its key's largest component, in chunks, with each block of the key."""
    own = _parted(members)
    counted = own.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = counted.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("main"))
    least = Window.partitionBy("key").orderBy("node")
    few = own.join(main, "key").where("root <> main").withColumn("chunk", F.floor((F.row_number().over(least) - 1) / BUCKET))
    few = cut(few)
    chunks = few.groupBy("key").agg((F.max("chunk") + 1).alias("chunks"))
    many = own.join(chunks, "key").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
    few = few.withColumn("block", F.explode(F.expr("sequence(0L, parts - 1)")))
    columns = ["key", "node", "root", F.expr("chunk * parts + block").alias("block")]
    return few.select(*columns).unionByName(many.select(*columns))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row_key, node, root, component_id): the shingle set's hash, and the least doc_id within reach."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key string, node long, prints array<long>, keys array<long>"
    sketched = cut(docs.select("doc_id", "text", row_key(docs).alias("row_key")).mapInArrow(_sketches, schema))
    nodes = cut(sketched.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.first("prints").alias("prints"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = cut(keyed.join(shared, "key"))
    grouped = cut(_grouped(nodes.select("node", "prints")))
    release(spark)
    wanted = buckets.select("node").union(grouped.select("node")).distinct().join(nodes.select("node", "row_key"), "node")
    texts = docs.select(row_key(docs).alias("row_key"), "text").join(wanted, "row_key").dropDuplicates(["row_key"])
    sets = cut(texts.select("node", "text").mapInArrow(_sets, "node long, hashes binary"))
    roots = connected_components(_linked(_blocks(grouped), sets))
    for some in (F.col("band") < FIRST, F.col("band") >= FIRST):
        release(spark)
        roots = _joined(roots, _linked(_blocks(_unsettled(buckets.where(some), roots)), sets))
    full = buckets.where(F.col("n") > BUCKET)
    if not full.isEmpty():
        release(spark)
        roots = _joined(roots, _linked(_across(_unsettled(full, roots)), sets))
    release(spark)
    joined = nodes.select("node", "least").join(roots.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = joined.join(names, "root").select("node", "root", "component_id")
    return sketched.join(by_node, "node").select("doc_id", "row_key", "node", "root", "component_id")
