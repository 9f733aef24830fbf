"""The byte container: little-endian headers around block payloads, written in version 2 and read in 1 and 2."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

from . import FormatError
from .blocks import LEAST_BLOCK, MOST_BLOCK

#: Fixed values of the byte format.
MAGIC, VERSION, DIRECTORY, STREAM_LZP = b"MZIP", 2, 1, 2
_FILE, _STREAM, _BLOCK = struct.Struct("<4sBB2sIQI"), struct.Struct("<QIB3s"), struct.Struct("<BBHIIIII")
HEADER_BYTES = _BLOCK.size
#: Longest input that the stream pass buffers.
STREAM_MOST = 512 << 20
AUTO_LEAST, AUTO_MOST, AUTO_PARTS = 4 << 20, 16 << 20, 16


@dataclass(frozen=True)
class StreamHeader:
    coded_size: int
    checksum: int
    hash_bits: int


@dataclass(frozen=True)
class Head:
    """A block's header, and where its payload begins."""

    mode: int
    lzp: bool
    original_size: int
    payload_size: int
    primary_index: int
    intermediate_size: int
    checksum: int
    place: int


@dataclass(frozen=True)
class Index:
    """What an archive's headers say."""

    version: int
    directory: bool
    block_size: int
    original_size: int
    stream: StreamHeader | None
    heads: list[Head]


def choose_block_size(size: int, explicit: int | None = None, profile: str = "default") -> int:
    """The block size for an input: as asked, or by the profile."""
    if explicit is not None:
        if not LEAST_BLOCK <= explicit <= MOST_BLOCK:
            raise ValueError(f"block size must be from {LEAST_BLOCK} to {MOST_BLOCK} bytes")
        return explicit
    if profile == "ratio":
        return min(max(size, LEAST_BLOCK), MOST_BLOCK)
    if profile != "default":
        raise ValueError(f"unknown profile {profile!r}")
    return min(max(size // AUTO_PARTS, AUTO_LEAST), AUTO_MOST)


def block_count(size: int, block_size: int) -> int:
    """Blocks of a stream, none for an empty one."""
    return (size - 1) // block_size + 1 if size else 0


def slot_bits(size: int) -> int:
    """Bits of the slot table for a stream: the least of 20 to 26 with a slot for every four bytes."""
    return next((b for b in range(20, 26) if 4 << b >= size), 26)


def pack_block_header(mode: int, lzp: bool, original: int, payload: int, primary: int, middle: int, checksum: int) -> bytes:
    return _BLOCK.pack(mode, int(lzp), 0, original, payload, primary, middle, checksum)


def pack_file_header(block_size: int, original: int, blocks: int, directory: bool = False, stream: StreamHeader | None = None, version: int = VERSION) -> bytes:
    flags = DIRECTORY * directory | STREAM_LZP * (stream is not None)
    head = _FILE.pack(MAGIC, version, flags, b"\0\0", block_size, original, blocks)
    return head + (_STREAM.pack(stream.coded_size, stream.checksum, stream.hash_bits, b"\0\0\0") if stream else b"")


def file_header_bytes(stream: bool) -> int:
    """Where the first block header is."""
    return _FILE.size + _STREAM.size * stream


def index(read: Callable[[int, int], bytes], size: int) -> Index:
    """The index of an archive of `size` bytes, of which read(place, n) gives n; payloads are not read.

    The framing is checked. What a block's own fields may be is the rule of `columns.header_error`, which
    decoding asks.
    """
    if size < _FILE.size:
        raise FormatError("truncated archive header")
    magic, version, flags, reserved, block_size, original, count = _FILE.unpack(read(0, _FILE.size))
    if magic != MAGIC:
        raise FormatError("not an archive")
    if version not in (1, 2):
        raise FormatError("unknown version")
    if flags & ~(DIRECTORY if version == 1 else DIRECTORY | STREAM_LZP) or reserved != b"\0\0":
        raise FormatError("unknown archive flags")
    if not LEAST_BLOCK <= block_size <= MOST_BLOCK:
        raise FormatError("block size out of range")
    place, stream, coded = _FILE.size, None, original
    if flags & STREAM_LZP:
        if size < place + _STREAM.size:
            raise FormatError("truncated stream header")
        coded, checksum, bits, reserved = _STREAM.unpack(read(place, _STREAM.size))
        place += _STREAM.size
        if reserved != b"\0\0\0" or not 0 < coded < original <= STREAM_MOST or not 20 <= bits <= 26:
            raise FormatError("invalid stream header")
        stream = StreamHeader(coded, checksum, bits)
    if count != block_count(coded, block_size):
        raise FormatError("unexpected block count")
    heads, left = [], coded
    for _ in range(count):
        if size < place + HEADER_BYTES:
            raise FormatError("truncated block header")
        mode, flag, reserved, part, payload, primary, middle, checksum = _BLOCK.unpack(read(place, HEADER_BYTES))
        place += HEADER_BYTES
        if flag & ~1 or reserved or (version == 1 and flag):
            raise FormatError("unknown block flags")
        if part != min(left, block_size):
            raise FormatError("unexpected block size")
        if payload > size - place:
            raise FormatError("truncated block payload")
        heads.append(Head(mode, bool(flag), part, payload, primary, middle, checksum, place))
        place, left = place + payload, left - part
    if place != size:
        raise FormatError("bytes after the end of the archive")
    return Index(version, bool(flags & DIRECTORY), block_size, original, stream, heads)


def parse(data: bytes) -> Index:
    """The index of an archive at hand."""
    return index(lambda place, n: data[place : place + n], len(data))
