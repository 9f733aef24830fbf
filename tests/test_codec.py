import hashlib
import io
import random
import tarfile
import zlib

import pytest
from plain import entropy, sorting
from pyspark.sql import functions as F

from blockloom import kernels
from blockloom.codec import FormatError, container, tree
from blockloom.codec.blocks import MIXED, RANKED, RAW
from blockloom.operators import stages
from blockloom.plans import archive


def shapes(seed, count=60):
    """Random blocks: small alphabets, runs, alternation, ramps, periods, noise."""
    rng = random.Random(seed)
    out = [b"", b"a", b"banana", bytes(range(256)), bytes(range(256)) * 20, b"\0" * 1000 + b"\xff" * 300, b"abc" * 300]
    for _ in range(count):
        n, kind = rng.randint(0, 900), rng.randrange(4)
        if kind == 0:
            out.append(bytes(rng.randrange(rng.choice([2, 4, 16, 256])) for _ in range(n)))
        elif kind == 1:
            data = b"".join(bytes([rng.randrange(256)]) * rng.randint(1, 200) for _ in range(8))
            out.append(data[:n])
        elif kind == 2:
            out.append(b"\0\xff" * (n // 2))
        else:
            out.append(bytes(97 + i % rng.choice([1, 2, 3, 5, 16]) for i in range(n)))
    return out


def rows(spark, some):
    return spark.createDataFrame([(i, 0, bytearray(b)) for i, b in enumerate(some)], "stream long, block_index long, bytes binary")


def values(df, *columns):
    """Values by stream; binaries as bytes."""
    plain = lambda v: bytes(v) if isinstance(v, (bytes, bytearray)) else v
    return [tuple(plain(r[c]) for c in columns) for r in sorted(df.collect(), key=lambda r: r.stream)]


def test_plain_block_sorting():
    assert sorting.bwt_encode([b"banana", b""]) == [(b"annbaa", 4), (b"", 0)]
    some = shapes(1)
    for block, (column, primary) in zip(some, sorting.bwt_encode(some), strict=True):
        order = sorted([block[i:], i] for i in range(len(block) + 1))
        assert column == bytes(block[i - 1] for _, i in order if i)
        assert sorting.bwt_decode(column, primary) == block


def test_coders_give_the_bytes_of_the_plain_ones(spark):
    rng = random.Random(11)
    noise = rng.randbytes(600)
    some = shapes(1) + shapes(2) + shapes(4) + [bytes(rng.choice(b"abc") for _ in range(3000)), noise * 7, noise + noise[:300] + noise[100:500] + b"\1" * 400, b"q" * 5000, rng.randbytes(4096), b"a" * 136]
    some += [b"\0" * n + b"\7" * n + b"\1" for n in (1, 2, 3, 8, 15, 16, 31, 255, 1000)]
    df = kernels.ready(rows(spark, some)).withColumn("s", kernels.sort("bytes"))
    df = df.select("stream", "s.*", kernels.order("bytes").alias("order"), kernels.ranks("bytes").alias("ranks"), kernels.mix_encode("bytes").alias("mixed"), kernels.collapse("bytes", 20).alias("short"), *(kernels.run_encode("bytes", k).alias(f"run_{k}") for k in (2, 3)))
    got = sorted(df.collect(), key=lambda r: r.stream)
    mixed, orders = entropy.cm_encode(some), sorting.suffix_arrays(some)
    runs = {k: [entropy.run_symbols(b, k) for b in some] for k in (2, 3)}
    coded = {k: entropy.rc_encode(runs[k]) for k in (2, 3)}
    for i, (row, block, column) in enumerate(zip(got, some, sorting.bwt_encode(some), strict=True)):
        assert (bytes(row.data), row.primary_index) == column and list(row.order) == orders[i].tolist()
        assert bytes(row.ranks) == sorting.mtf_encode(block) and bytes(row.mixed) == mixed[i]
        assert (None if row.short is None else bytes(row.short)) == sorting.lzp_encode(block)
        for k in (2, 3):
            assert (row[f"run_{k}"].symbols, bytes(row[f"run_{k}"].payload)) == (len(runs[k][i]), coded[k][i])


def test_coders_give_up_at_the_limit(spark):
    some = [b for b in shapes(3) if b]
    df = kernels.ready(rows(spark, some)).withColumn("whole", kernels.mix_encode("bytes")).withColumn("run", kernels.run_encode("bytes", 2)["payload"])
    n, m = F.length("whole").cast("long"), F.length("run").cast("long")
    tried = df.select("stream", "whole", "run", kernels.mix_encode("bytes", n).alias("a"), kernels.mix_encode("bytes", n + 1).alias("b"), kernels.run_encode("bytes", 2, m).alias("c"), kernels.run_encode("bytes", 2, m + 1)["payload"].alias("d"))
    for row in tried.collect():
        assert row.a is None and row.c is None and row.b == row.whole and row.d == row.run


@pytest.mark.parametrize("stage", sorted(stages.ROUNDTRIPS))
def test_stages_restore_their_blocks(spark, stage):
    some = [b for b in shapes(4) if b]  # no block is empty
    assert [b for (b,) in values(stages.roundtrip(rows(spark, some), stage), "bytes")] == some


def test_blocks_take_the_least_coding(spark):
    some = [b for b in shapes(6) if b] + [random.Random(7).randbytes(4096)]
    coded = stages.encode(rows(spark, some)).cache()
    assert values(stages.decode(coded), "bytes", "error") == [(b, None) for b in some]
    found = values(coded, "mode", "payload_size", "checksum")
    assert found[-1][0] == RAW and {m for m, _, _ in found} == {RAW, RANKED, MIXED}
    sizes = values(stages.candidate_sizes(rows(spark, some)), "original_size", "mixed", "ranked_2", "ranked_3", "collapsed")
    for (_, size, checksum), block, each in zip(found, some, sizes, strict=True):
        assert size == min(x for x in each if x is not None) and checksum == zlib.adler32(block)


def test_damaged_blocks_have_errors(spark):
    some = [b for b in shapes(5, 25) if len(b) > 20]
    coded = stages.encode(rows(spark, some)).cache()
    raw = F.col("payload")
    ways = [F.substring(raw, F.lit(1), F.length(raw) - 1), F.concat(raw, F.unhex(F.lit("78"))), F.substring(raw, 1, 3), F.unhex(F.lit(""))]
    for way in ways:
        back = stages.decode(coded.withColumn("payload", way))
        assert all(error for (error,) in values(back, "error"))
    flipped = coded.withColumn("payload", F.concat(F.substring(raw, F.lit(1), F.length(raw) - 1), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(raw, -1, 1)), 16, 10).cast("long").bitwiseXOR(F.lit(255))), 2, "0"))))
    for (data, error), block in zip(values(stages.decode(flipped), "bytes", "error"), some, strict=True):
        assert error or data == block  # a coder's last byte may be of no weight
    for field, value in (("checksum", F.col("checksum") + 1), ("primary_index", F.lit(0).cast("long")), ("primary_index", F.lit(10**6)), ("mode", F.lit(3).cast("long"))):
        kept = coded.where("mode <> 0").withColumn(field, value.cast("long"))
        assert all(error for (error,) in values(stages.decode(kept), "error"))


def pieces():
    return bytes(97 + i % 26 for i in range(600)) + b"\0" * 500 + b"x" * 300 + bytes(i * 37 % 251 for i in range(700))


def packed(spark, data, size=None, profile="default"):
    streams = spark.createDataFrame([(0, bytearray(data))], "stream long, content binary")
    return bytes(archive.archives(streams, size, profile).first().archive)


def restored(spark, *some):
    rows_ = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(some)], "stream long, archive binary")
    return values(archive.restored(rows_), "content", "error")


def test_format_pin(spark):
    """Any change to these bytes is a change of the format."""
    found = packed(spark, pieces(), 1024)
    assert hashlib.sha256(found).hexdigest() == PIN
    assert restored(spark, found) == [(pieces(), None)]


PIN = "260d03cadc4ec36a4241b2d865947bf9125f85a26ddfd90dab3f3b2d02c2583b"


@pytest.mark.parametrize("data,size,profile", [(b"", None, "default"), (b"a", None, "default"), (pieces() * 3, 1024, "default"), (pieces(), None, "ratio"), (b"".join(shapes(8, 10)), 1024, "default")])
def test_container_roundtrip(spark, data, size, profile):
    found = packed(spark, data, size, profile)
    index = container.parse(found)
    assert index.original_size == len(data) and restored(spark, found) == [(data, None)]
    assert len(found) == container.file_header_bytes(index.stream is not None) + sum(container.HEADER_BYTES + h.payload_size for h in index.heads)
    assert found.startswith(container.pack_file_header(index.block_size, len(data), len(index.heads), False, index.stream))
    for h in index.heads:
        head = container.pack_block_header(h.mode, h.lzp, h.original_size, h.payload_size, h.primary_index, h.intermediate_size, h.checksum)
        assert found[h.place - container.HEADER_BYTES : h.place] == head


def test_version_one_is_read(spark):
    data = b"a text that says itself again, " * 90
    parts = [data[i : i + 1024] for i in range(0, len(data), 1024)]
    out = container.pack_file_header(1024, len(data), len(parts), version=1)
    for part, (column, primary) in zip(parts, sorting.bwt_encode(parts), strict=True):
        symbols = entropy.run_symbols(sorting.mtf_encode(column), 2)
        (payload,) = entropy.rc_encode([symbols])
        out += container.pack_block_header(RANKED, False, len(part), len(payload), primary, len(symbols), zlib.adler32(part)) + payload
    mixed = bytearray(out)
    mixed[24] = MIXED
    assert restored(spark, out, mixed) == [(data, None), (None, "unknown block mode")]


def test_damage_is_an_error_or_harmless(spark):
    data = pieces()
    good = packed(spark, data, 4096)
    rng = random.Random(9)
    bad = []
    for round_ in range(150):
        some = bytearray(good)
        some[rng.randrange(len(good))] ^= 1 << rng.randrange(8)
        bad.append(bytes(some) if round_ % 3 else good[: rng.randrange(len(good))])
    for at in range(48):
        bad.append(good[:at] + bytes([good[at] ^ 255]) + good[at + 1 :])
    found = restored(spark, *bad)
    assert all(error or content == data for content, error in found)
    # another block size may fit a single block as well
    assert all(error or 8 <= at < 12 for at, (_, error) in enumerate(found[150:]))


def test_trees_match_the_common_format(tmp_path):
    entries = [tree.Entry("a.txt", False, b"x" * 3000), tree.Entry("empty.bin", False), tree.Entry("nested", True), tree.Entry("nested/deep/b.bin", False, bytes(range(256)) * 20), tree.Entry("n" * 180 + ".txt", False, b"long"), tree.Entry("p" * 120 + "/" + "q" * 90, False, b"split"), tree.Entry("é", True)]
    stream = tree.write(entries)
    wanted = sorted(entries, key=lambda e: e.path.encode())
    assert tree.parse(stream) == wanted
    with tarfile.open(fileobj=io.BytesIO(stream)) as tar:
        assert [(m.name, m.isdir(), m.mtime) for m in tar] == [(e.path, e.directory, 0) for e in wanted]
    (tmp_path / "tar").write_bytes(stream)
    tree.extract_file(str(tmp_path / "tar"), str(tmp_path / "out"))
    tree.write_tree(str(tmp_path / "out"), str(tmp_path / "again"))
    missing = {"p" * 120, "nested/deep"}  # folders that extraction made
    assert [e for e in tree.parse((tmp_path / "again").read_bytes()) if e.path not in missing] == wanted
    assert (tmp_path / "out" / "nested" / "deep" / "b.bin").read_bytes() == bytes(range(256)) * 20
    with pytest.raises(ValueError):
        tree.extract_file(str(tmp_path / "tar"), str(tmp_path / "out"))
    for path in ("../escape.txt", "/absolute.txt", "nested/../../escape.txt", "", "."):
        with pytest.raises(FormatError):
            tree.safe_path(path)
    for bad in (stream[:-512], stream + b"x" * 512, stream[:512], stream[512:]):
        with pytest.raises(FormatError):
            tree.parse(bad)
    assert tree.parse_size(tree.size_field(1 << 40)) == 1 << 40
