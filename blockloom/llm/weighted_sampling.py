"""Document fingerprints by consistent weighted sampling (operator 4).

Terms are words, weighted by how often a text has them. For each of `SAMPLES` samples a term draws, by
its hash, r and c from Gamma(2, 1) and b from the unit interval; with t = floor(ln w / r + b) its value
is ln c - r (t - b) - r, and the term of least value, with its t, is the sample. Two texts agree in a
sample with the probability of their generalised Jaccard similarity, the sum of lesser over the sum of
greater weights. Every term and sample has draws of its own, made of two 64-bit hashes: a Gamma(2, 1) is
minus the logarithm of the product of two uniform numbers, one from each half of a hash. A task keeps the
values of (term, weight) met before; what it keeps changes no result.

Each text is compared with its edited form and with its successor by descending doc_id. Rows are dealt
by ranges of doc_id, whose cuts are a few numbers, and sorted inside; the first row of a range also goes
to the range before it. No order over all rows is needed.

Cases. Null text: empty; an empty or wordless text has the all-ones fingerprint, like only to its own
kind. Null doc_id: last in order. Equal doc_ids: ordered by text. A single row is its own successor.
Repeated rows: each stays. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import pieces, range_of, splitters, word_hashes

SAMPLES = 64
#: Terms worked on at a time, and the binary logarithm of how many terms' values a task keeps (512 bytes each).
ROWS, KEPT_BITS = 4096, 17
_NONE = np.uint32(0xFFFFFFFF)
#: What sets the hashes of the samples apart, and what draws b from the first of them.
_SALTS = np.random.default_rng(4_711).integers(0, 1 << 63, (2, SAMPLES), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_THIRD = np.uint64(0xD1342543DE82EF95)
_UNIT, _BELOW_ONE = np.float32(2.0**-32), np.float32(1 - 2.0**-24)


def _hashed(terms: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each term and salt."""
    x = terms[:, None] ^ salts[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _gamma(hashes: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) from the two halves of each hash."""
    halves = (hashes.view(np.uint32).astype(np.float32) + np.float32(0.5)) * _UNIT
    return -np.log(np.minimum(halves[:, ::2] * halves[:, 1::2], _BELOW_ONE))


def draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, c and b of each term and sample."""
    first = _hashed(terms, _SALTS[0])
    return _gamma(first), _gamma(_hashed(terms, _SALTS[1])), ((first * _THIRD) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)


def sample_keys(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For terms and samples: the order of the value in the high half of a uint64, the term and its t in the low half."""
    r, c, b = draws(terms)
    low = np.broadcast_to((terms ^ (terms >> np.uint64(32)))[:, None], r.shape).astype(np.uint32)
    more = weights > 1
    t = np.floor(np.log(weights[more].astype(np.float32))[:, None] / r[more] + b[more])  # 0 where the weight is 1
    low[more] ^= t.astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1)
    ahead = 1 - b
    ahead[more] += t
    bits = (np.log(c) - r * ahead).view(np.uint32)
    order = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    return order.astype(np.uint64) << np.uint64(32) | low


def weighted_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of the text, the term's hash and its weight, for each distinct word of each text; texts in order."""
    terms, at = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
    owners = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, side="right")
    order = np.lexsort((terms, owners))
    terms, owners = terms[order], owners[order]
    starts = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (owners[1:] != owners[:-1])]) if len(terms) else order
    return owners[starts], terms[starts], np.diff(np.r_[starts, len(terms)])


class Sampler:
    """Signatures of texts; keeps the values of terms and their weights met before, each in a place of its own hash."""

    def __init__(self, kept_bits: int = KEPT_BITS) -> None:
        self.mask = np.uint64((1 << kept_bits) - 1)
        self.tags = np.zeros(1 << kept_bits, np.uint64)
        self.kept = np.empty((1 << kept_bits, SAMPLES), np.uint64)

    def signatures(self, texts: list[bytes]) -> np.ndarray:
        """A row of SAMPLES 32-bit numbers for each UTF-8 text."""
        owners, terms, weights = weighted_terms(texts)
        best = np.full((len(texts), SAMPLES), np.uint64(0xFFFFFFFFFFFFFFFF))
        full = np.zeros(len(texts), bool)
        for at in range(0, len(terms), ROWS):
            own = owners[at : at + ROWS]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.minimum.reduceat(self.keys(terms[at : at + ROWS], weights[at : at + ROWS]), starts, axis=0)
            best[own[starts]] = np.minimum(best[own[starts]], least)
            full[own] = True
        return np.where(full[:, None], best.astype(np.uint32), _NONE)

    def keys(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """sample_keys of the terms, worked out only for those that aren't kept."""
        tags = (terms ^ (weights.astype(np.uint64) * _THIRD)) | np.uint64(1)
        places = ((tags * _THIRD) >> np.uint64(32)) & self.mask
        out = self.kept[places]
        missing = np.flatnonzero(self.tags[places] != tags)
        if len(missing):
            _, first, again = np.unique(tags[missing], return_index=True, return_inverse=True)
            fresh = missing[first]
            made = sample_keys(terms[fresh], weights[fresh])
            out[missing] = made[again]
            self.kept[places[fresh]], self.tags[places[fresh]] = made, tags[fresh]
        return out


def fingerprint_hex(signature: np.ndarray) -> str:
    """Eight hexadecimal digits a sample."""
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples of signatures, row by row."""
    return (a == b).mean(axis=-1)


def edited_text(text: str, successor: str) -> str:
    """The text with its last half, rounded down, replaced by as many first characters of its successor."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (range, tail, doc_id descending, text); the last row waits for its successor."""
    sampler = Sampler()
    held, held_signature = None, None  # (range, doc_id, text)
    for batch in pieces(batches, "text"):
        ids, kind = batch.column("doc_id").to_pylist(), batch.schema.field("doc_id").type
        ranges, tails = batch.column("part").to_pylist(), batch.column("tail").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        signatures = sampler.signatures([t.encode() for t in texts])
        if held is not None:
            ids, texts, ranges, tails = [held[1], *ids], [held[2], *texts], [held[0], *ranges], [False, *tails]
            signatures = np.concatenate([held_signature[None], signatures])
        done = [i for i in range(len(ids) - 1) if not tails[i]]
        assert all(ranges[i] == ranges[i + 1] for i in done), "a range without its tail"
        edits = [edited_text(texts[i], texts[i + 1]).encode() for i in done]
        edited = sampler.signatures(edits)
        at = np.array(done, int)
        own, after = signatures[at], signatures[at + 1] if done else signatures[at]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in done], kind),
                pa.array([len(texts[i]) for i in done], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                pa.array([fingerprint_hex(s) for s in own], pa.string()),
                pa.array([fingerprint_hex(s) for s in edited], pa.string()),
                pa.array(likeness(own, edited), pa.float64()),
                pa.array(likeness(own, after), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
        held = None if tails[-1] else (ranges[-1], ids[-1], texts[-1])
        held_signature = None if held is None else signatures[-1]
    assert held is None, "a range without its tail"


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (part, tail, doc_id, text), dealt and sorted so that each row's successor comes right after it.

    The driver learns the ranges' cuts and each range's greatest doc_id: as many numbers as ranges.
    """
    parts = shuffle_partitions(docs.sparkSession)
    narrow = docs.select("doc_id", "text")
    place = range_of(F.col("doc_id"), splitters(narrow, "doc_id", 2 * parts), descending=True)
    firsts = dict(sorted((r["part"], r["first"]) for r in narrow.groupBy(place.alias("part")).agg(F.max("doc_id").alias("first")).collect()))
    order = list(firsts)
    before = {part: order[i - 1] for i, part in enumerate(order)}  # the first range comes after the last

    @F.arrow_udf("int")
    def previous(ids: pa.Array, places: pa.Array) -> pa.Array:
        """The range before a row's own, if the row's doc_id is the greatest of its range."""
        return pa.array([before.get(part) if own == firsts[part] else None for own, part in zip(ids.to_pylist(), places.to_pylist(), strict=True)], pa.int32())

    tail = F.array(F.struct(F.col("previous").alias("part"), F.lit(True).alias("tail")))
    tails = F.when(F.col("previous").isNotNull(), tail).otherwise(F.array().cast("array<struct<part:int,tail:boolean>>"))
    own = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")))
    return (
        narrow.withColumn("part", place)
        .withColumn("previous", previous(F.col("doc_id"), F.col("part")))
        .select("doc_id", "text", F.explode(F.concat(own, tails)).alias("to"))
        .select("to.part", "to.tail", "doc_id", "text")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")
    )


def compare_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: n_chars, the edited text's hash, both fingerprints, and the two likenesses."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs).mapInArrow(_compared, schema)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler = Sampler()
    for batch in pieces(batches, "text"):
        signatures = sampler.signatures([(t or "").encode() for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint_hex(s) for s in signatures], pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint), without any shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_signed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")
