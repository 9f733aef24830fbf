"""Column expressions of block planning, sizes, digits, checksums and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codec.blocks import LEAST_BLOCK, MOST_BLOCK
from ..codec.container import AUTO_LEAST, AUTO_MOST, AUTO_PARTS, DIRECTORY, HEADER_BYTES, MAGIC, STREAM_LZP, VERSION, file_header_bytes
from ..codec.tree import NAME_MOST, OCTAL_MOST, PREFIX_MOST, RECORD


def _whole(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("long")


def block_size(size: Column, profile: str = "default") -> Column:
    """Bytes of a block for an input of `size` bytes."""
    if profile == "ratio":
        return F.least(F.greatest(size, F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK)).cast("long")
    return F.least(F.greatest(_whole(size, AUTO_PARTS), F.lit(AUTO_LEAST)), F.lit(AUTO_MOST)).cast("long")


def valid_block_size(size: Column) -> Column:
    return size.between(LEAST_BLOCK, MOST_BLOCK)


def block_count(size: Column, block: Column) -> Column:
    """Blocks of an input, 0 for an empty one."""
    return F.when(size > 0, F.floor((size - 1) / block) + 1).otherwise(0).cast("long")


def hash_bits(size: Column) -> Column:
    """Slot table bits of a stream, 20 to 26."""
    out = F.lit(26)
    for bits in range(25, 19, -1):
        out = F.when(size <= 4 << bits, bits).otherwise(out)
    return out.cast("long")


def padding(size: Column) -> Column:
    """Bytes that fill a tar record."""
    return ((RECORD - size % RECORD) % RECORD).cast("long")


def octal_size(size: Column) -> Column:
    """A tar header's size field as text: eleven octal digits; null where the base-256 form is due."""
    return F.when(size < OCTAL_MOST, F.lpad(F.conv(size.cast("string"), 10, 8), 11, "0"))


def needs_long_name(name: Column) -> Column:
    """Whether a tar name neither fits its field nor splits at a slash into prefix and rest. ASCII names."""
    cut = F.least(F.length(name), F.lit(PREFIX_MOST + 1)) - F.locate("/", F.reverse(F.substring(name, 1, PREFIX_MOST + 1))) + 1
    has = F.locate("/", F.substring(name, 1, PREFIX_MOST + 1)) > 0
    rest = F.length(name) - cut
    return (F.length(name) > NAME_MOST) & ~(has & (cut > 1) & rest.between(1, NAME_MOST))


def tar_bytes(name: Column, size: Column) -> Column:
    """Bytes an entry takes in a tar stream, long-name record included."""
    long = F.length(name) + 1
    return (RECORD + size + padding(size) + F.when(needs_long_name(name), RECORD + long + padding(long)).otherwise(0)).cast("long")


def safe_path(path: Column) -> Column:
    """Whether a stored path stays below the folder it is extracted to."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    return (path != "") & ~path.rlike(r"^[/\\]|^.:") & ~F.array_contains(parts, "..") & (F.size(parts) > 0)


def safe_windows_name(path: Column) -> Column:
    """Whether no component of a path is refused by Windows: reserved characters, endings and device names."""
    bad = r'[\x00-\x1f<>:"|?*]|[ .]$|^(?i:con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$'
    return ~F.exists(F.split(path, "/"), lambda p: p.rlike(bad))


def run_digits(length: Column) -> Column:
    """Bijective base-2 digits of a run length as letters A and B, the lowest first."""
    return F.translate(F.reverse(F.substring(F.bin(length + 1), 2, 64)), "01", "AB")


def run_symbol_count(value: Column, length: Column, extension: int) -> Column:
    """Run symbols that a run of equal ranks is spelled with."""
    zero = F.length(F.bin(length + 1)) - 1
    return F.when(length == 1, 1).when(value == 0, zero).when(length < extension, length).otherwise(F.length(F.bin(length))).cast("long")


def varint_bytes(value: Column) -> Column:
    """Bytes of a number at seven bits each."""
    out = F.lit(6)
    for n in range(5, 0, -1):
        out = F.when(value < 1 << 7 * n, n).otherwise(out)
    return out.cast("long")


def ratio(original: Column, coded: Column) -> Column:
    return F.when(original == 0, F.lit(0.0)).otherwise(coded / original)


def savings_percent(original: Column, coded: Column) -> Column:
    return F.when(original == 0, F.lit(0.0)).otherwise((1 - coded / original) * 100)


def format_bytes(size: Column) -> Column:
    """A size with its unit: bytes as they are, larger ones with two decimals, halves to even."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, power in (("KiB", 10), ("MiB", 20), ("GiB", 30)):
        out = F.when(size >= 1 << power, F.concat(F.format_string("%.2f", F.bround(size / float(1 << power), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def le_hex(value: Column, width: int) -> Column:
    """An unsigned number as little-endian bytes in hexadecimal."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(width - 1, -1, -1)))


def block_header_hex(mode: Column, lzp: Column, original: Column, payload: Column, primary: Column, middle: Column, checksum: Column) -> Column:
    """A block header's 24 bytes in hexadecimal."""
    return F.concat(le_hex(mode, 1), le_hex(lzp.cast("long"), 1), F.lit("0000"), *(le_hex(c, 4) for c in (original, payload, primary, middle, checksum)))


def file_header_hex(block_size: Column, original: Column, blocks: Column, directory: Column, stream: Column, coded: Column, checksum: Column, bits: Column) -> Column:
    """An archive's header in hexadecimal; with the stream pass, the collapsed size, the checksum and the slot bits follow."""
    flags = F.when(directory, DIRECTORY).otherwise(0) + F.when(stream, STREAM_LZP).otherwise(0)
    head = F.concat(F.lit(MAGIC.hex().upper()), le_hex(F.lit(VERSION), 1), le_hex(flags, 1), F.lit("0000"), le_hex(block_size, 4), le_hex(original, 8), le_hex(blocks, 4))
    return F.when(stream, F.concat(head, le_hex(coded, 8), le_hex(checksum, 4), le_hex(bits, 1), F.lit("000000"))).otherwise(head)


def least_coding(sizes: list[Column], original: Column) -> Column:
    """Which coding of a block stays: the place of the least size, the first of equals; -1 for raw, where none is under the original's."""
    best = F.array_min(F.filter(F.array(*(F.struct(s.cast("long").alias("size"), F.lit(i).cast("long").alias("coding")) for i, s in enumerate(sizes))), lambda x: x["size"].isNotNull()))
    return F.when(best["size"] < original, best["coding"]).otherwise(F.lit(-1)).cast("long")


def stream_pass_decisive(original: Column, collapsed: Column) -> Column:
    """Whether a collapsed stream is shorter by more than a tenth: then the other way isn't tried."""
    return collapsed < original - F.floor(original / 10)


def stream_pass_kept(original: Column, collapsed: Column, with_pass: Column, without: Column) -> Column:
    """Whether a collapsed stream stays: if that is decisive, or its archive is smaller, stream header included."""
    header = file_header_bytes(True) - file_header_bytes(False)
    return (collapsed < original) & (stream_pass_decisive(original, collapsed) | (with_pass + header < without))


def header_error(version: Column, mode: Column, lzp: Column, original: Column, payload: Column, primary: Column, middle: Column) -> Column:
    """The first thing wrong with a block header, null if nothing is."""
    coded = F.when(lzp, middle).otherwise(original)
    return (
        F.when((mode < 0) | (mode > F.when(version == 1, 1).otherwise(2)), "unknown block mode")
        .when(lzp & (version == 1), "unknown block flags")
        .when((payload <= 0) | (payload > original), "impossible payload size")
        .when((mode == 0) & ((payload != original) | (primary != 0) | (middle != 0) | lzp), "invalid raw block")
        .when((mode == 1) & (lzp | ~primary.between(1, original) | ~middle.between(1, original)), "invalid ranked block")
        .when((mode == 2) & (~primary.between(F.lit(1), coded) | F.when(lzp, middle >= original).otherwise(middle != 0)), "invalid mixed block")
    )


def encoded_size(payload: Column) -> Column:
    """Bytes of blocks with their headers, as an aggregate."""
    return F.sum(payload + HEADER_BYTES).cast("long")
