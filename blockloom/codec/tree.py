"""Directory trees as tar streams: fixed metadata, sorted entries, long names, and safe extraction."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from . import FormatError

RECORD, NAME_MOST, PREFIX_MOST, LONG_MOST = 512, 100, 155, 65_536
#: Fixed values of the tar format: the name of a long-name record, and its magic.
LONG_NAME, USTAR = "././@LongLink", b"ustar\x0000"
OCTAL_MOST = 1 << 33


@dataclass(frozen=True)
class Entry:
    """A stored path, with its content; a directory has none."""

    path: str
    directory: bool
    content: bytes = b""


def padding(size: int) -> int:
    return -size % RECORD


def split_name(name: bytes) -> tuple[bytes, bytes] | None:
    """(prefix, name) as a header holds them, or None for a name that needs a record of its own."""
    if len(name) <= NAME_MOST:
        return b"", name
    cut = name.rfind(b"/", 0, PREFIX_MOST + 1)
    if cut > 0 and 0 < len(name) - cut - 1 <= NAME_MOST:
        return name[:cut], name[cut + 1 :]
    return None


def size_field(size: int) -> bytes:
    """Eleven octal digits, or the base-256 form of larger sizes."""
    return b"%011o\0" % size if size < OCTAL_MOST else b"\x80" + size.to_bytes(11, "big")


def header(name: bytes, size: int, kind: bytes) -> bytes:
    prefix, short = split_name(name) or (b"", name[:NAME_MOST])
    mode = b"0000755\0" if kind == b"5" else b"0000644\0"
    fields = struct.pack("<100s8s8s8s12s12s8sc100s8s32s32s8s8s155s12s", short, mode, b"0000000\0", b"0000000\0", size_field(size), b"00000000000\0", b" " * 8, kind, b"", USTAR, b"", b"", b"0000000\0", b"0000000\0", prefix, b"")
    return fields[:148] + b"%06o\0 " % sum(fields) + fields[156:]


def heads(path: str, directory: bool, size: int) -> bytes:
    """What goes before an entry's content: a long-name record if need be, and its header."""
    name, first = path.encode("utf-8", "surrogateescape") + (b"/" if directory else b""), b""
    if split_name(name) is None:
        first = header(LONG_NAME.encode(), len(name) + 1, b"L") + name + b"\0" * (1 + padding(len(name) + 1))
    return first + header(name, size, b"5" if directory else b"0")


def write(entries: list[Entry]) -> bytes:
    """The tar stream of entries, in the order of their paths."""
    ordered = sorted(entries, key=lambda e: e.path.encode())
    return b"".join(heads(e.path, e.directory, len(e.content)) + e.content + b"\0" * padding(len(e.content)) for e in ordered) + b"\0" * 2 * RECORD


def _below(root: str) -> Iterator[tuple[str, str, bool]]:
    """(stored path, full path, whether it is a folder) of what is below a folder; only regular files and folders are allowed."""
    for at, folders, files in os.walk(root):
        for name in folders + files:
            full = os.path.join(at, name)
            path = os.path.relpath(full, root).replace(os.sep, "/")
            if os.path.islink(full) or not (os.path.isdir(full) or os.path.isfile(full)):
                raise ValueError(f"{path} is neither a regular file nor a folder")
            yield path, full, os.path.isdir(full)


def write_tree(root: str, target: str) -> None:
    """Writes the tar stream of a folder to a file, a piece at a time."""
    with open(target, "wb") as out:
        for path, full, directory in sorted(_below(root), key=lambda e: os.fsencode(e[0])):
            size = 0 if directory else os.path.getsize(full)
            out.write(heads(path, directory, size))
            if not directory:
                start = out.tell()
                with open(full, "rb") as file:
                    shutil.copyfileobj(file, out, 1 << 20)
                if out.tell() - start != size:
                    raise OSError("input changed while it was read")
                out.write(b"\0" * padding(size))
        out.write(b"\0" * 2 * RECORD)


def safe_path(stored: str) -> str:
    """The path to extract to, below the target; FormatError for one that would leave it."""
    if not stored or stored.startswith(("/", "\\")) or stored[1:2] == ":":
        raise FormatError("unsafe path in archive")
    parts = [p for p in stored.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in parts or not parts:
        raise FormatError("unsafe path in archive")
    return "/".join(parts)


def _text(field: bytes) -> bytes:
    return field.split(b"\0", 1)[0]


def parse_size(field: bytes) -> int:
    if field[0] & 0x80:
        size = int.from_bytes(field, "big") & ((1 << 95) - 1)
        if size >> 63:
            raise FormatError("tar size out of range")
        return size
    digits = field.strip(b" \0")
    if any(c not in b"01234567" for c in digits):
        raise FormatError("bad digit in a tar size")
    return int(digits or b"0", 8)


def scan(read: Callable[[int, int], bytes], n: int) -> Iterator[tuple[str, bool, int, int]]:
    """(path, whether it is a folder, place and size of the content) of the entries of a tar stream of n bytes, of which read(place, size) gives a part.

    Paths are checked; FormatError where the stream turns out malformed.
    """
    place, long_name = 0, None
    while True:
        if place + RECORD > n:
            raise FormatError("tar stream ends early")
        record = read(place, RECORD)
        place += RECORD
        if not any(record):
            if long_name is not None or place + RECORD > n or any(read(place, RECORD)):
                raise FormatError("bad end of the tar stream")
            if n != place + RECORD:
                raise FormatError("bytes after the end of the tar stream")
            return
        kind, size = record[156:157], parse_size(record[124:136])
        if size > n - place:
            raise FormatError("tar entry longer than the stream")
        body, place = place, place + size + padding(size)
        if kind == b"L":
            if long_name is not None or not 0 < size <= LONG_MOST or not _text(read(body, size)):
                raise FormatError("bad long name in the tar stream")
            long_name = _text(read(body, size))
            continue
        prefix, name = _text(record[345:500]), _text(record[:100])
        full = long_name if long_name is not None else prefix + b"/" + name if prefix else name
        long_name = None
        if kind not in (b"0", b"\0", b"5") or (kind == b"5" and size):
            raise FormatError("unsupported tar entry")
        path = full.decode("utf-8", "surrogateescape")
        yield safe_path(path.rstrip("/") if kind == b"5" else path), kind == b"5", body, size


def parse(stream: bytes) -> list[Entry]:
    """The entries of a tar stream at hand."""
    return [Entry(path, directory, stream[place : place + size]) for path, directory, place, size in scan(lambda place, n: stream[place : place + n], len(stream))]


def extract_file(source: str, target: str) -> None:
    """Writes the entries of a tar file below a folder that must not exist, a piece at a time; nothing stays behind on failure."""
    if os.path.lexists(target):
        raise ValueError(f"{target} exists")
    staging = f"{target}.tmp.{uuid.uuid4().hex}"
    os.makedirs(staging)
    try:
        with open(source, "rb") as stream:

            def read(place: int, n: int) -> bytes:
                stream.seek(place)
                return stream.read(n)

            for path, directory, place, size in scan(read, os.path.getsize(source)):
                full = os.path.join(staging, path)
                os.makedirs(full if directory else os.path.dirname(full), exist_ok=True)
                if not directory:
                    with open(full, "wb") as out:
                        for at in range(place, place + size, 1 << 20):
                            out.write(read(at, min(1 << 20, place + size - at)))
        os.rename(staging, target)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
