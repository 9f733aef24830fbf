"""BPE encoding and decoding with reuse of content-defined chunks (operator 8).

Rolling hashes cut texts into chunks at places that depend on nearby bytes only, so that copies and
shared passages fall into equal chunks wherever they stand. A task encodes each chunk once and keeps the
result while it has room. Chunk joins are then repaired: text around the join is encoded anew between
cuts that lie a little inside both chunks, and stands once its first and last stretch agree exactly with
the chunks' own ids; until then the cuts move outwards, to the ends of the text if need be.

A cut is a space between two ASCII letters: the pattern that splits text before merging always starts a
piece there, whatever comes before or after, and a special token never spans one.

Cases. Null or empty text: no ids, the hash of nothing. Special tokens written out in a text become
their ids, as the tokenizers library has it. Very long texts: worked chunk by chunk. Null or repeated
doc_id and repeated rows: each row for itself. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import flat, pieces, window_hashes

#: Bytes that decide on a chunk's end, the least and most bytes of a chunk, and the chance of an end at a place.
WINDOW, LEAST, MOST, ONE_IN = 32, 512, 16_384, 2048
#: Bytes of chunk text whose ids a task keeps.
KEPT_BYTES = 32 << 20
#: How text is split before merging; the same pieces as the tokenizers library's byte-level pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def byte_of_char() -> dict[str, int]:
    """Bytes by the printable character that stands for them in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of = byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = token
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        self.marks = tuple(s.encode() for s in self.special)

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a whole UTF-8 text, as uint32."""
        if any(mark in text for mark in self.marks):
            return np.array(self.encoding.encode(text.decode("utf-8"), allowed_special="all"), np.uint32)
        return np.array(self.encoding.encode_ordinary(text.decode("utf-8")), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the decoded text; broken sequences become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The codec of a file, loaded once a process."""
    return Codec(path)


def default_path() -> str:
    """The byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For texts laid end to end, each text's chunk ends, counted from its start; characters stay whole."""
    hashes = window_hashes(data, WINDOW)
    places = np.flatnonzero((hashes >> np.uint64(20)) % np.uint64(ONE_IN) == 0) + WINDOW
    lead = (data & 0xC0) != 0x80
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, last = [], start
        mine = places[np.searchsorted(places, start + LEAST) : np.searchsorted(places, end)].tolist()
        for place in [*mine, end]:
            if place != end and place - last < LEAST:
                continue
            while place - last > MOST:
                last += MOST
                while last > start and not lead[last]:
                    last -= 1
                ends.append(last - start)
            while place < end and not lead[place]:
                place += 1
            if place > last:
                ends.append(place - start)
                last = place
        out.append(ends)
    return out


class Chunk:
    """A chunk's ids, with its cuts as places in the bytes and in the ids."""

    __slots__ = ("cuts", "ids", "tokens")

    def __init__(self, text: bytes, own: Codec) -> None:
        self.ids = own.encode(text)
        data = np.frombuffer(text, np.uint8)
        letter = _LETTER[data]
        self.cuts = np.flatnonzero((data[1:-1] == 32) & letter[:-2] & letter[2:]) + 1 if len(data) > 2 else np.zeros(0, np.int64)
        self.tokens = np.searchsorted(np.r_[0, np.cumsum(own.width[self.ids])], self.cuts)


def join_chunks(text: bytes, ends: list[int], chunks: list[Chunk], own: Codec) -> np.ndarray:
    """The ids of the whole text, from its chunks' ids and repaired joins."""
    if len(chunks) == 1:
        return chunks[0].ids
    parts, taken, at = [], 0, 0  # of the chunk at `at`, ids up to `taken` are settled
    starts = [0, *ends[:-1]]
    while at < len(chunks) - 1:
        left, to = chunks[at], at + 1
        free = int(np.searchsorted(left.tokens, taken, side="right"))  # cuts from here on are open to the repair
        reach = 2
        while True:
            right = chunks[to]
            wide_l, wide_r = max(free, len(left.cuts) - reach), min(reach, len(right.cuts)) - 1
            from_cut = wide_l < len(left.cuts)
            begin = starts[at] + int(left.cuts[wide_l]) if from_cut else None
            if begin is None and taken:  # nothing left of this chunk but what is settled: go on from there
                begin = starts[at] + int(own.width[left.ids[:taken]].sum())
            elif begin is None:
                begin = starts[at]
            end = starts[to] + int(right.cuts[wide_r]) if wide_r >= 0 else ends[to]
            fresh = own.encode(text[begin:end])
            head = left.ids[left.tokens[wide_l] : left.tokens[wide_l + 1]] if wide_l + 1 < len(left.cuts) else fresh[:0]
            tail = right.ids[right.tokens[wide_r - 1] : right.tokens[wide_r]] if wide_r >= 1 else fresh[:0]
            agreed = np.array_equal(fresh[: len(head)], head) and np.array_equal(fresh[len(fresh) - len(tail) :], tail)
            if agreed and wide_r >= 0 or to == len(chunks) - 1 and (agreed or wide_l == free and wide_r == len(right.cuts) - 1):
                break
            if wide_r < 0 or wide_r == len(right.cuts) - 1 and wide_l == free:
                to += 1  # no agreement within this chunk: the repair takes it in whole
            reach *= 2
        if from_cut:
            parts.append(left.ids[taken : left.tokens[wide_l]])
        parts.append(fresh)
        at, taken = to, int(right.tokens[wide_r]) if wide_r >= 0 else len(right.ids)
    parts.append(chunks[at].ids[taken:])
    return np.concatenate(parts)


class Encoder:
    """Encodes texts, keeping the ids of chunks met before."""

    def __init__(self, own: Codec, room: int = KEPT_BYTES) -> None:
        self.own, self.room, self.held, self.chunks = own, room, 0, {}

    def chunk(self, text: bytes) -> Chunk:
        found = self.chunks.get(text)
        if found is None:
            found = self.chunks[text] = Chunk(text, self.own)
            self.held += len(text)
            while self.held > self.room:
                oldest = next(iter(self.chunks))
                self.held -= len(oldest)
                del self.chunks[oldest]
        return found

    def encode(self, text: bytes, ends: list[int]) -> np.ndarray:
        """Ids of a text with the given chunk ends."""
        if not text:
            return np.zeros(0, np.uint32)
        chunks = [self.chunk(text[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return join_chunks(text, ends, chunks, self.own)

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column; null is empty."""
        data, offsets = flat(column)
        raw = data.tobytes()
        for ends, a, b in zip(chunk_ends(data, offsets), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield self.encode(raw[a:b], ends)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), and with keep_ids the ids as 32-bit little-endian bytes.

    path: the vocabulary file, at the same place on every executor.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        encoder = Encoder(own)
        for batch in pieces(batches, "text"):
            counts, hashes, back, kept = [], [], [], []
            for ids in encoder.encode_column(batch.column("text")):
                raw = ids.astype("<u4").tobytes()
                counts.append(len(ids))
                hashes.append(_sha(raw))
                back.append(_sha(own.decode(ids)))
                kept.append(raw if keep_ids else None)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids binary" * keep_ids)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids) of 32-bit little-endian ids; null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
