"""Removal of long repeated byte strings by a distributed, sparse suffix array (operator 7).

Every byte covered by a string of `LENGTH` bytes that also starts elsewhere in the corpus goes. Sorting
a suffix for every byte would move each byte hundreds of times, so suffixes are taken where content says:
in each string of LENGTH bytes, the place whose `GRAM` bytes have the least hash is its anchor. Equal
strings have equal anchors at equal places, so comparing suffixes at anchors alone finds them all.

1. Anchors: one pass over the texts gives (hash, document, place, first and last string that it anchors).
   A hash met once can be in no repeat; the rest, found by counting, go on.
2. Suffixes: each remaining anchor becomes a suffix with its context, the bytes of all strings it
   anchors. Equal contexts of one hash are one row from here on.
3. Suffix array: sampled splitters range-partition the suffixes by their leading bytes, and buckets are
   sorted by multikey quicksort. A string that starts d bytes before its anchor is met again where another
   suffix has LENGTH - d bytes in common after the anchor and d before it. Both follow from the longest
   common prefixes of neighbours, of the suffixes and of the reversed bytes before them: no hash decides.
   Suffixes of equal leading bytes are never parted by a splitter, so nothing is to be compared across
   buckets. A bucket of more than `BUCKET` different contexts is split by the strings' 128-bit digests.
4. Runs of repeated strings return to their documents, are united and cut out.

Matches never cross documents, and all are judged on the input.

Cases. Null text: no bytes. Texts under LENGTH bytes: never changed. Null or repeated doc_id and repeated
rows: each row is a text of its own, and equal rows are repeats of each other. Empty table: no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import cut, flat, pieces, utf8, window_hashes

LENGTH, GRAM = 400, 100
#: Contexts of equal leading bytes that one task compares.
BUCKET = 10_000
#: Bytes of text searched at a time; each takes some hundred bytes of arrays.
PIECE = 1 << 20
#: Hashes whose anchors are spread over so many tasks each, as they may be a large part of all.
HOT, SALTS = 1000, 64
#: Leading bytes that splitters are made of, and suffixes sampled for them, in all.
LEADING, SAMPLED = 16, 20_000


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's doc_id and text; rows that share it have the same repeats."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"], F.lit("")))))


#: Places in one block of the minimum search; they take the low bits of what is compared.
_BLOCK_BITS = 23


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of the least (by its high bits), the first of equals."""
    n = len(values) - width + 1
    out = np.zeros(max(n, 0), np.int64)
    step = (1 << _BLOCK_BITS) - width
    low = np.uint64((1 << _BLOCK_BITS) - 1)
    for at in range(0, n, step):
        part = values[at : at + step + width - 1]
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        padded = np.full(-(-len(part) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(part)] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(part) - width + 1
        least = np.minimum(back[:m], ahead[width - 1 : width - 1 + m])
        out[at : at + m] = (least & low).astype(np.int64) + at
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: anchors' hashes and texts, and from and to which string start each is the anchor.

    Starts are counted from the text's beginning.
    """
    sizes = np.diff(offsets)
    hashes = window_hashes(data, GRAM)
    at = window_minima(hashes, LENGTH - GRAM + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    whole = np.flatnonzero(np.arange(len(at)) + LENGTH <= offsets[1:][owner]) if len(at) else np.zeros(0, np.int64)
    at, owner = at[whole], owner[whole]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]) if len(at) else whole
    last = np.r_[new[1:], len(at)] - 1 if len(at) else new
    base = offsets[:-1][owner[new]]
    return hashes[at[new]], owner[new], at[new] - base, whole[new] - base, whole[last] - base


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE):
        hashes, owner, at, first, last = anchors(*flat(batch.column("text")))
        keys = batch.column("key").take(pa.array(owner))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), keys, *(pa.array(x.astype(np.int32)) for x in (at, first, last))], ["hash", "key", "at", "first", "last"])


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE):
        data, offsets = flat(batch.column("text"))
        _, owner, at, _, _ = anchors(data, offsets)
        raw, places = data.tobytes(), (at + offsets[:-1][owner]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([raw[p : p + LEADING] for p in places], pa.binary())], ["lead"])


def sample_splitters(docs: DataFrame, sampled: int = SAMPLED, per_bucket: int = 5_000) -> list[bytes]:
    """Leading bytes that part suffixes into buckets of about so many, from a sample of bounded size."""
    rows = docs.count()
    share = min(1.0, 1000 / max(1, rows))
    drawn = docs.select("text").sample(share, seed=7).mapInArrow(_leading, "lead binary").limit(50 * sampled)
    leads = drawn.orderBy(F.xxhash64("lead")).limit(sampled).toArrow().column(0).to_pylist()
    estimate = drawn.count() / share if leads else 0
    buckets = int(min(len(leads), max(1, estimate / per_bucket)))
    leads = sorted(leads)
    return sorted({leads[i * len(leads) // buckets] for i in range(1, buckets)}) if buckets > 1 else []


def multikey_order(texts: list[bytes], least: int = 24) -> list[int]:
    """The order of byte strings by multikey quicksort, eight bytes a key; equal strings keep their order."""
    if not texts:
        return []
    size = max(map(len, texts)) // 8 * 8 + 8
    words = np.frombuffer(b"".join(t.ljust(size, b"\0") for t in texts), ">u8").reshape(len(texts), -1)
    out: list[int] = []
    stack = [(np.arange(len(texts)), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= least or depth == words.shape[1]:
            out.extend(sorted(group.tolist(), key=lambda i: (texts[i], i)))
            continue
        keys = words[group, depth]
        pivot = np.sort(keys[:: max(1, len(keys) // 63)])[len(keys[:: max(1, len(keys) // 63)]) // 2]
        stack.append((group[keys > pivot], depth))
        stack.append((group[keys == pivot], depth + 1))
        stack.append((group[keys < pivot], depth))
    return out


def _suffix_rows(cuts: list[bytes], bytes_too: bool):
    """Suffixes of the remaining anchors with their contexts, from rows (key, text, found)."""
    bounds = np.array([c.ljust(LEADING, b"\0") for c in cuts], f"S{LEADING}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            out: list[tuple] = []
            for key, text, found in zip(batch.column("key").to_pylist(), utf8(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                for at, first, last in sorted({(f["at"], f["first"], f["last"]) for f in found or ()}):
                    context = text[first : last + LENGTH]
                    name = hashlib.blake2b(context, digest_size=16, salt=(at - first).to_bytes(4, "little")).digest()
                    out.append((name, key, first, at - first, context))
            names, keys, firsts, ahead, contexts = zip(*out, strict=True) if out else ([],) * 5
            columns = [pa.array(names, pa.binary()), pa.array(keys, pa.binary()), pa.array(firsts, pa.int32())]
            if bytes_too:
                leads = np.array([c[a : a + LEADING] for c, a in zip(contexts, ahead, strict=True)], f"S{LEADING}")
                columns = [columns[0], pa.array(np.searchsorted(bounds, leads, side="right").astype(np.int32)), pa.array(ahead, pa.int32()), pa.array(contexts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "bucket", "ahead", "context"] if bytes_too else ["name", "key", "first"])

    return run


def neighbour_prefixes(texts: list[bytes]) -> np.ndarray:
    """The longest common prefix of each byte string and the next."""
    sizes = np.array([len(t) for t in texts])
    width = max(1, int(sizes.max()))
    rows = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def common_length(a: bytes, b: bytes) -> int:
    """The longest common prefix of two byte strings."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def repeated_strings(contexts: list[bytes], ahead: list[int], copies: list[int]) -> list[list[tuple[int, int]]]:
    """For contexts in the order of their suffixes: from and to which place strings of LENGTH bytes start that another place also has.

    ahead: how many bytes of a context stand before its suffix.
    """
    if len(contexts) == 1:
        return [[(0, len(contexts[0]) - LENGTH)] if copies[0] > 1 else []]
    if len(contexts) == 2 and max(copies) == 1:
        (one, other), (a, b) = contexts, ahead
        before, after = common_length(one[:a][::-1], other[:b][::-1]), common_length(one[a:], other[b:])
        return [[(max(0, at - before), at - (LENGTH - after))] if before + after >= LENGTH else [] for at in (a, b)]
    n, at, sizes = len(contexts), np.array(ahead), np.array([len(c) for c in contexts])
    lefts = [c[:a][::-1] for c, a in zip(contexts, ahead, strict=True)]
    by_left = multikey_order(lefts)
    after = neighbour_prefixes([c[a:] for c, a in zip(contexts, ahead, strict=True)])[:, None]
    before = neighbour_prefixes([lefts[i] for i in by_left])[:, None]
    least, most = int(np.maximum(0, at - (sizes - LENGTH)).min()), int(at.max())
    again = np.zeros((n, most - least + 1), bool)
    for low in range(least, most + 1, 64):  # strings that start d bytes before their anchor, for some d at a time
        d = np.arange(low, min(low + 64, most + 1))
        there = (d <= at[:, None]) & (at[:, None] - d + LENGTH <= sizes[:, None])
        right, left = np.zeros((2, n, len(d)), np.int64)
        right[1:] = np.cumsum(after < LENGTH - d, axis=0)
        left[by_left[1:]] = np.cumsum(before < d, axis=0)
        groups = np.where(there, right * n + left, n * n + np.arange(n)[:, None])
        order = np.argsort(groups, axis=0, kind="stable")
        ordered = np.take_along_axis(groups, order, axis=0)
        same = np.zeros((n + 1, len(d)), bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        np.put_along_axis(again[:, low - least : low - least + len(d)], order, same[1:] | same[:-1], axis=0)
        again[:, low - least : low - least + len(d)] |= there & (np.array(copies) > 1)[:, None]
    edges = np.diff(np.pad(again[:, ::-1], ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for (row, start), (_, stop) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist(), strict=True):
        out[row].append((ahead[row] - most + start, ahead[row] - most + stop - 1))
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (name, copies, from, to) of repeated strings, from rows sorted by bucket.

    A bucket that is too full goes out string by string instead, as (name, copies, at, at, the string's digest).
    """
    held: list[tuple] = []
    bucket, over = None, False

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ([],) * 5
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "copies", "start", "stop", "string"])

    def strings(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        for name, _, context, copies in some:
            yield rows([(name, copies, i, i, hashlib.blake2b(context[i : i + LENGTH], digest_size=16).digest()) for i in range(len(context) - LENGTH + 1)])

    def settled(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        order = multikey_order([c[a:] for _, a, c, _ in some])
        leads = [some[i][2][some[i][1] : some[i][1] + GRAM] for i in order]
        at, found = 0, []
        while at < len(order):  # neighbours with one gram are compared, a run of them at a time
            to = at + 1
            while to < len(order) and leads[to] == leads[at]:
                to += 1
            names, ahead, contexts, copies = zip(*(some[i] for i in order[at:to]), strict=True)
            for name, n, spans in zip(names, copies, repeated_strings(list(contexts), list(ahead), list(copies)), strict=True):
                found += [(name, n, a, b, None) for a, b in spans]
            at = to
        yield rows(found)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "name", "ahead", "context", "copies")), strict=True):
            if row[0] != bucket:
                yield from (strings if over else settled)(held)
                held, bucket, over = [], row[0], False
            held.append(row[1:])
            if len(held) > BUCKET:
                over = True
                yield from strings(held)
                held = []
    yield from (strings if over else settled)(held)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE):
        out = []
        for text, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            kept, at, removed, runs, stop = [], 0, 0, 0, -1
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > stop:
                    kept.append(text[at:a])
                    runs += 1
                    removed += b - a
                    at = stop = b
                elif b > stop:
                    removed += b - stop
                    at = stop = b
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((len(text), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
        n_bytes, removed, runs, digests, rests = zip(*out, strict=True) if out else ([],) * 5
        columns = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array([r > 0 for r in removed], pa.bool_()), pa.array(rests, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats", "kept"])


def salted_join(found: DataFrame, twice: DataFrame) -> DataFrame:
    """The anchors whose hash is in `twice`; rows of the HOT most frequent hashes are spread over SALTS tasks each."""
    hot = F.broadcast(twice.orderBy(F.desc("n"), "hash").limit(HOT).select("hash", F.lit(True).alias("hot")))  # HOT rows at most
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = twice.join(hot, "hash", "left").select("hash", F.explode(salts).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key", "at"), F.lit(SALTS))).otherwise(0).cast("int")
    return found.join(hot, "hash", "left").withColumn("salt", salt).join(right, ["hash", "salt"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats, kept): `kept` is what is left, as bytes."""
    parts = shuffle_partitions(docs.sparkSession)
    cuts = sample_splitters(docs)
    keyed = docs.select(row_key(docs).alias("key"), "text")
    found = keyed.mapInArrow(_anchor_rows, "hash long, key binary, at int, first int, last int")
    twice = cut(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    by_text = salted_join(found, twice).groupBy("key").agg(F.collect_list(F.struct("at", "first", "last")).alias("found"))
    # dealt once: all joins with the texts read the same columns, so that they share this exchange
    dealt = docs.select(row_key(docs).alias("key"), "doc_id", "text").repartition(parts, "key")
    ready = dealt.join(by_text, "key", "left")
    contexts = ready.mapInArrow(_suffix_rows(cuts, True), "name binary, bucket int, ahead int, context binary")
    places = ready.mapInArrow(_suffix_rows(cuts, False), "name binary, key binary, first int")
    distinct = contexts.groupBy("name").agg(F.first("bucket").alias("bucket"), F.first("ahead").alias("ahead"), F.first("context").alias("context"), F.count("*").alias("copies"))
    sorted_in = distinct.repartition(parts, "bucket").sortWithinPartitions("bucket")
    runs = sorted_in.mapInArrow(_compared, "name binary, copies long, start int, stop int, string binary")
    pending = runs.where("string is not null")
    again = pending.groupBy("string").agg(F.sum("copies").alias("n")).where("n > 1").select("string")
    runs = runs.where("string is null").select("name", "start", "stop").union(pending.join(again, "string").select("name", "start", "stop"))
    # places of one context may be many: adaptive execution splits such a partition, as the groups come after another exchange
    spans = runs.join(places, "name").groupBy("key").agg(F.collect_list(F.struct((F.col("first") + F.col("start")).alias("a"), (F.col("first") + F.col("stop") + LENGTH).alias("b"))).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = dealt.join(spans, "key", "left")
    return done.mapInArrow(_cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeats boolean, kept binary")
