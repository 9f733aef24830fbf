"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 2).

Fingerprints of 64 bits link at 3 or fewer differing bits. Equal fingerprints are one node from the
start, so copies never multiply. A fingerprint is cut into segments A and B of 23 bits and C of 18.
Whatever way 3 errors fall on them, one of these keys is shared (errors in A, B, C):

    exact A, Golay keys of B            0, up to 2, any
    Golay keys of A, exact B            up to 2, 0, any
    exact B and C; exact A and C        3, 0, 0 and 0, 3, 0
    Golay keys of A and B, half of C    1 or 2 in A and B, up to 1 in C: one half of C is exact

Each key is 33 to 41 bits long, so that unrelated fingerprints seldom meet. Rows are dealt by key and
sorted; within a key every pair is verified where it lies, and only links of a spanning forest leave.
A key with more than `BUCKET` fingerprints isn't compared in one task: its fingerprints go to
`ball_links`, which needs no pairs at all.

Cases. Null, empty or wordless text: fingerprint zero, linked like any other. Under three words: the
whole sequence is the one shingle. Null doc_id: kept; it never names a component unless all of it are
null. Repeated rows: each stays, in the same component. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import cut, utf8
from .components import connected_components
from .golay import codeword_indices

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints under one key that a task compares; those of fuller keys take the other way.
BUCKET = 4096
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hash of each word shingle of a UTF-8 text, in order; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words])[: max(1, len(words) - width + 1)].tolist()
    ends = ends[width - 1 :].tolist() if len(words) >= width else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text, unsigned."""
    return print_of(shingle_hashes(text, width))


def print_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of some hashes: a bit is 1 where more than half of them have it."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t) for t in utf8(batch.column("text"))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(prints.view(np.int64))], ["doc_id", "row_key", "fp"])


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints (uint64), and for each key the place of its fingerprint."""
    v = prints.astype(np.uint64)
    a, b, c = (v >> np.uint64(41)).astype(np.int64), ((v >> np.uint64(18)) & np.uint64(0x7FFFFF)).astype(np.int64), (v & np.uint64(0x3FFFF)).astype(np.int64)
    at_a, at_b, rows = codeword_indices(a), codeword_indices(b), np.arange(len(v))
    keys, places = [], []

    def add(kind: int, key: np.ndarray, good: np.ndarray) -> None:
        keys.append((np.int64(kind) << 58 | key)[good])
        places.append(np.broadcast_to(rows[:, None], key.shape)[good])

    add(0, a[:, None] << 12 | at_b, at_b >= 0)
    add(1, b[:, None] << 12 | at_a, at_a >= 0)
    every = np.ones((len(v), 1), bool)
    add(2, (a << 18 | c)[:, None], every)
    add(3, (b << 18 | c)[:, None], every)
    both = (at_a[:, :, None] << 12 | at_b[:, None, :]).reshape(len(v), -1)
    good = ((at_a >= 0)[:, :, None] & (at_b >= 0)[:, None, :]).reshape(len(v), -1)
    add(4, both << 9 | (c >> 9)[:, None], good)
    add(5, both << 9 | (c & 511)[:, None], good)
    return np.concatenate(keys), np.concatenate(places)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 5000):
            part = prints[at : at + 5000]
            keys, places = golay_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[places])], ["key", "fp"])


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _forest(prints: np.ndarray, distance: int) -> tuple[list, list]:
    """Links of a spanning forest of the closeness graph of some distinct fingerprints."""
    left, right, rest = [], [], prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _close(rest, at, distance)
            if near.any():
                found, rest = rest[near], rest[~near]
                left.extend([at] * len(found))
                right.extend(found.tolist())
                queue.extend(found)
    return left, right


def _links_in_order(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal keys; keys are sorted, and none has over BUCKET rows."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= 16), sizes)
    k, p = keys[small], prints[small]
    for apart in range(1, 16):
        if len(k) <= apart:
            break
        same = (k[apart:] == k[:-apart]) & _close(p[apart:], p[:-apart], distance)
        left.append(p[:-apart][same])
        right.append(p[apart:][same])
    for start, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        a, b = _forest(prints[start : start + size], distance)
        left.append(np.array(a, np.uint64))
        right.append(np.array(b, np.uint64))
    a, b = np.concatenate(left or [prints[:0]]), np.concatenate(right or [prints[:0]])
    return np.maximum(a, b), np.minimum(a, b)


def _links(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows sorted by key; a fingerprint under an overfull key goes out as (a, null)."""
    seen: set[tuple[int, int]] = set()
    held_k, held_p, full = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def rows(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), other], ["a", "b"])

    def done(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(keys)])
        over = np.repeat(sizes > BUCKET, sizes)
        if over.any():
            yield rows(np.unique(prints[over]), None)
        a, b = _links_in_order(keys[~over], prints[~over], distance)
        fresh = [pair for pair in dict.fromkeys(zip(a.tolist(), b.tolist(), strict=True)) if pair not in seen]
        if len(seen) < 1_000_000:
            seen.update(fresh)
        if fresh:
            yield rows(*(np.array(x, np.uint64) for x in zip(*fresh, strict=True)))

    for batch in batches:
        keys = np.r_[held_k, batch.column("key").to_numpy(zero_copy_only=False)]
        prints = np.r_[held_p, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
        last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if full is not None and len(keys):  # the rest of a key found overfull before
            same = keys == full
            if same.any():
                yield rows(np.unique(prints[same]), None)
            keys, prints = keys[~same], prints[~same]
            full, last = (full if not len(keys) else None), (np.searchsorted(keys, keys[-1]) if len(keys) else 0)
        if len(keys) - last > BUCKET:
            full = keys[-1]
            yield from done(keys, prints)
            held_k, held_p = keys[:0], prints[:0]
        else:
            yield from done(keys[:last], prints[:last])
            held_k, held_p = keys[last:], prints[last:]
    yield from done(held_k, held_p)


def _ball_masks() -> tuple[np.ndarray, np.ndarray]:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.r_[np.zeros(1, np.uint64), one, one[i] | one[j]]
    return masks, np.bitwise_count(masks) <= 1


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks, near = _ball_masks()
    for batch in batches:
        prints = batch.column("a").to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 100):
            part = prints[at : at + 100].view(np.uint64)
            words = (part[:, None] ^ masks[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.repeat(part.view(np.int64), len(masks))), pa.array(np.tile(near, len(part)))], ["word", "fp", "near"])


def ball_links(prints: DataFrame) -> DataFrame:
    """All links (a, b) among distinct fingerprints `a`, up to components, without comparing pairs.

    Two fingerprints within 3 have a word within 1 of the one and 2 of the other. Whatever is within 2 of
    a word truly links to whatever is within 1 of it, so each word links everything to its least near
    fingerprint. A word has at most 2,081 fingerprints around it, so no group is large.
    """
    balls = prints.mapInArrow(_balls, "word long, fp long, near boolean")
    hubs = balls.where("near").groupBy("word").agg(F.min("fp").alias("hub"))
    return balls.join(hubs, "word").where("fp <> hub").select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct()


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's doc_id and text; rows that share it are interchangeable."""
    return F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"], F.lit(""))))


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp` that share a key and differ in at most `distance` bits, up to components.

    All that differ in DISTANCE bits share a key; of those that differ in more, some do.
    """
    keyed = prints.mapInArrow(_key_rows, "key long, fp long")
    dealt = keyed.repartition(shuffle_partitions(prints.sparkSession), "key").sortWithinPartitions("key")
    found = cut(dealt.mapInArrow(partial(_links, distance=distance), "a long, b long").distinct())
    links, full = found.where("b is not null"), found.where("b is null").select("a")
    return links if full.isEmpty() else links.union(ball_links(full))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row_key, fp, root, component_id): fingerprint as a long, and the least doc_id within reach.

    row_key is a hash of doc_id and text; root is the least fingerprint of the component.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key string, fp long"
    prints = cut(docs.select("doc_id", "text", row_key(docs).alias("row_key")).mapInArrow(_fingerprints, schema))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    joined = nodes.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = joined.join(names, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def fingerprint_hex(column: str) -> Column:
    """16 lowercase hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The documents without near-duplicates: one row of each component stays, whole and unchanged.

    It is the row with the least doc_id (null last), then the least hash of its content. Other groups than
    those of near_duplicates are rows (doc_id, row_key, root).
    """
    groups = near_duplicates(docs) if groups is None else groups
    first = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "row_key"))
    kept = groups.groupBy("root").agg(first.alias("first")).select("first.row_key")
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), row_key(docs).alias("row_key"))
    alike = Window.partitionBy("row_key").orderBy("row_key")
    once = rows.join(kept, "row_key", "left_semi").withColumn("nth", F.row_number().over(alike)).where("nth = 1")
    return once.select(*(F.col(f"row.`{c}`").alias(c) for c in names))
