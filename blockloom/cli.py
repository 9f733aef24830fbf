"""Command line: compress and decompress a file or a folder. `python -m blockloom.cli --help`."""

from __future__ import annotations

import sys

from .codec import FormatError

VERSION = "2.0.0"
USAGE = """usage: blockloom compress INPUT OUTPUT [--block-size BYTES] [--threads N] [--profile default|ratio]
       blockloom decompress INPUT OUTPUT [--threads N]
       blockloom --help | --version"""
MOST_THREADS = 256


class UsageError(ValueError):
    """Arguments that make no sense."""


def parse_number(text: str) -> int:
    """A whole decimal number under 2^32."""
    if not (text.isascii() and text.isdigit()) or int(text) >> 32:
        raise UsageError(f"not a number: {text}")
    return int(text)


def format_size(size: int) -> str:
    """A size with its unit: bytes as they are, larger ones with two decimals."""
    for unit, power in (("GiB", 30), ("MiB", 20), ("KiB", 10)):
        if size >= 1 << power:
            return f"{size / (1 << power):.2f} {unit}"
    return f"{size} B"


def parse_arguments(args: list[str]) -> tuple[str, str, str, dict]:
    """(command, input, output, options)."""
    if len(args) < 3 or args[0] not in ("compress", "decompress"):
        raise UsageError(USAGE)
    command, source, target, rest = args[0], args[1], args[2], args[3:]
    allowed = {"--threads"} if command == "decompress" else {"--threads", "--block-size", "--profile"}
    options: dict = {}
    for flag, value in zip(rest[::2], rest[1::2], strict=False):
        if flag not in allowed:
            raise UsageError(f"unknown option {flag}")
        if flag == "--profile":
            if value not in ("default", "ratio"):
                raise UsageError(f"unknown profile {value}")
            options["profile"] = value
        elif flag == "--threads":
            options["threads"] = parse_number(value)
            if options["threads"] > MOST_THREADS:
                raise UsageError(f"at most {MOST_THREADS} threads")
        else:
            options["block_size"] = parse_number(value)
    if len(rest) % 2:
        raise UsageError(f"option {rest[-1]} lacks a value")
    return command, source, target, options


def report(command: str, stats: dict) -> str:
    """What is printed after a run."""
    original, coded = (stats["input_size"], stats["output_size"]) if command == "compress" else (stats["output_size"], stats["input_size"])
    ratio = f"{coded / original:.4f} ({(1 - coded / original) * 100:.2f} % saved)" if original else "n/a"
    return f"input  {format_size(stats['input_size'])}\noutput {format_size(stats['output_size'])}\nratio  {ratio}\nblocks {stats['block_count']} ({stats['raw_blocks']} raw, {stats['transformed_blocks']} transformed)\ntime   {stats['seconds']:.3f} s"


def main(args: list[str]) -> int:
    """Exit code: 0 done, 1 error, 2 usage, 3 invalid archive."""
    if args[:1] in (["--help"], ["-h"]):
        print(USAGE)
        return 0
    if args[:1] == ["--version"]:
        print(VERSION)
        return 0
    try:
        command, source, target, options = parse_arguments(args)
        from .plans import archive
        from .session import any_session

        spark = any_session(options.pop("threads", 0))
        work = archive.compress_file if command == "compress" else archive.decompress_file
        print(report(command, work(spark, source, target, **options)))
        return 0
    except UsageError as error:
        print(error, file=sys.stderr)
        return 2
    except FormatError as error:
        print(f"invalid archive: {error}", file=sys.stderr)
        return 3
    except (OSError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
