"""Pieces shared by the operators: Arrow text access, ordered cuts, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_path, shared_dir, shared_path  # noqa: F401  operators take them from here

#: A word: a run of anything but space and the characters 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python step works on at a time.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about `limit` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(lengths(batch.column(text)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value, 0 for null."""
    return np.diff(flat(column)[1])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the n + 1 offsets; null has no bytes."""
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64, len(wide) + 1, wide.offset * 8) if len(wide) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def utf8(column: pa.Array) -> list[bytes]:
    """Each value's UTF-8 bytes; null gives empty bytes."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: bytes.split() parts at exactly space and 0x09 to 0x0D."""
    return text.split()


def word_count(text: Column) -> Column:
    """Words of a text as a long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_digits(rows: int, per_bucket: int = 20_000, most: int = 8) -> int:
    """Leading hexadecimal digits of a uniform hash that cut `rows` rows into buckets of about `per_bucket`."""
    digits = 1
    while digits < most and rows > per_bucket * 16**digits:
        digits += 1
    return digits


def splitters(df: DataFrame, column: str, parts: int, accuracy: int = 10_000) -> list:
    """At most parts - 1 ascending cut values of a numeric column, from one approximate-quantile pass.

    They are plain numbers on the driver, as many as there are partitions, and stay the same however
    often the plan that uses them is run again.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, shares, accuracy).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(column: Column, cuts: list, descending: bool = False) -> Column:
    """The number of the range a value falls into, by binary search over the cuts; null goes last.

    The cuts travel as one array beside the plan, whatever their number; only this column crosses to Python.
    """
    bounds, n = np.array(cuts), len(cuts)

    @F.arrow_udf("int")
    def place(values: pa.Array) -> pa.Array:
        known = values.is_valid().to_numpy(zero_copy_only=False)
        filled = values.fill_null(0).to_numpy(zero_copy_only=False)
        found = np.searchsorted(bounds, filled, side="left") if n else np.zeros(len(filled), np.int64)
        return pa.array(np.where(known, n - found if descending else found, n + 1).astype(np.int32))

    return place(column)


#: Base of the polynomial hashes, odd, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_BYTE_VALUES = (np.random.default_rng(20_240_601).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 20), base, np.uint64)])
    return have[:n]


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Rolling 64-bit hashes of all windows of `width` bytes, by the place where each starts.

    Polynomial over random byte values, modulo 2^64, by one running sum; the high bits are mixed down.
    """
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(_BYTE_VALUES[data] * _powers(_INVERSE, n))]
    hashes = (total[width:] - total[:-width]) * _powers(_BASE, n - width + 1)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(data: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the place where it starts; worked in pieces that end between words."""
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(at + piece, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            ahead = np.flatnonzero(_SPACE[data[end : end + piece]])
            end = end + int(ahead[0]) if len(ahead) else min(end + piece, len(data))
        part = data[at:end]
        edges = np.flatnonzero(np.diff(np.r_[True, _SPACE[part], True]))
        starts, stops = edges[::2], edges[1::2]
        total = np.r_[np.uint64(0), np.cumsum(_BYTE_VALUES[part] * _powers(_INVERSE, len(part)))]
        found = (total[stops] - total[starts]) * _powers(_BASE, len(part))[starts] + (stops - starts).astype(np.uint64)
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        hashes.append(found ^ (found >> np.uint64(32)))
        places.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)
