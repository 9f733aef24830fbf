"""Suffix-array repetition rule with base counts (operator 3).

Per text, over its words: suffixes are sorted by prefix doubling, where a suffix drops out once its
prefix is unique in its text, so that ordinary prose costs little more than finding its repeated words.
Neighbours' longest common prefixes follow from the kept ranks; the intervals of equal prefixes are the
maximal repeated substrings, and a position's longest repeat is the larger prefix it shares with a
neighbour. The union of the spans so given is the covered part of the text.

A text is dropped by the method if repeats of `MIN_WORDS` words or more cover over `MOST_COVERED` of
its words, or if one repeat is over `LONGEST` words long. No shuffle: each text is judged alone.

Cases. Null, empty or wordless text: all counts 0, base_failed (too few words), not kept. Null or
repeated doc_id and repeated rows: each row is judged for itself. Empty table: no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, pieces

SYMBOLS = b"[#*$%&|<>]"
WINDOW = 3
LEAST_WORDS = 50
#: Repeats count for the verdict from this many words on.
MIN_WORDS = 8
MOST_COVERED = 0.3
LONGEST = 100

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order-keeping ranks of values: each the place of its first equal, and how many are equal."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[starts, len(values)])
    rank, size = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    rank[order] = np.repeat(starts, sizes)
    size[order] = np.repeat(sizes, sizes)
    return rank, size


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring that starts there and again elsewhere in its text.

    words: numbers of words, text after text; ends: where each position's text ends. Numbers of different
    texts must differ. Lengths are in words; repeats may overlap.
    """
    n = len(words)
    result = np.zeros(n, np.int64)
    if not n:
        return result
    rank, size = _dense(words)
    ranks, reach = [rank], 1
    active = np.flatnonzero(size > 1)
    while len(active):
        # a suffix as short as the reach is its text's end: it comes before all longer ones, alone
        after = active + reach
        inside = after < ends[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        first_o, second_o = rank[active][order], second[order]
        new = np.r_[True, (first_o[1:] != first_o[:-1]) | (second_o[1:] != second_o[:-1]) | (second_o[1:] == 0)]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(order)])
        base = np.flatnonzero(np.r_[True, first_o[1:] != first_o[:-1]])
        offset = np.arange(len(order)) - np.repeat(base, np.diff(np.r_[base, len(order)]))
        rank = rank.copy()
        rank[active[order]] = first_o + np.repeat(offset[starts], sizes)
        ranks.append(rank)
        reach *= 2
        active = active[order][np.repeat(sizes > 1, sizes)]
    # the suffix array of all suffixes whose first word isn't alone, and the prefixes neighbours share
    repeated = np.flatnonzero(size > 1)
    suffixes = repeated[np.argsort(rank[repeated], kind="stable")]
    left, right = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(left), np.int64)
    alive = np.arange(len(left))
    for level in range(len(ranks) - 1, -1, -1):
        a, b = left[alive] + common[alive], right[alive] + common[alive]
        fits = (a < ends[left[alive]]) & (b < ends[right[alive]])
        same = fits & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        common[alive[same]] += 1 << level
    np.maximum.at(result, left, common)
    np.maximum.at(result, right, common)
    return result


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Whether each position lies in a repeat of at least `least` words."""
    at = np.flatnonzero(lengths >= least)
    steps = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + lengths[at], -1)
    return np.cumsum(steps[:-1]) > 0


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All counts of a string column, one value a text."""
    data, offsets = flat(column)
    raw, texts = data.tobytes(), len(offsets) - 1
    space = _SPACE[data]
    out = {"word_chars": _sums(_LEAD[data] & ~space, offsets), "n_symbols": _sums(_SYMBOL[data], offsets)}
    split = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    again = []
    for text in split:
        lines = [line for line in text.split(b"\n") if line and not line.isspace()] if b"\n" in text else ()
        again.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(again, np.int64)
    number: dict[bytes, int] = {}
    counts, parts = [], []
    for text in split:
        words = text.split()
        counts.append(len(words))
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    n_words = np.array(counts, np.int64)
    ends = np.cumsum(n_words)
    owner = np.repeat(np.arange(texts), n_words)
    words = np.concatenate(parts) + owner * len(number) if parts else np.zeros(0, np.int64)
    lengths = longest_repeats(words, ends[owner] if texts else words)
    bounds = np.r_[0, ends]
    out["n_words"] = n_words
    out["n_repeat_words"] = _sums(covered(lengths, WINDOW), bounds)
    out["n_covered"] = _sums(covered(lengths, MIN_WORDS), bounds)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, owner, lengths)
    out["longest_repeat"] = longest
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        m = measure(batch.column("text"))
        failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed & (m["n_covered"] <= MOST_COVERED * m["n_words"]) & (m["longest_repeat"] <= LONGEST)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        columns = [*(m[k] for k in names), failed, kept, m["n_covered"], m["longest_repeat"]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", *names, "base_failed", "kept", "n_covered", "longest_repeat"])


def judge_repetition(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base_failed, kept, words in long repeats, and the longest repeat in words."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"
    return docs.select("doc_id", "text").mapInArrow(_measured, schema)
