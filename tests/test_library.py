import os

import duckdb
import pytest
from pyspark.sql import functions as F

from blockloom import cli, queries
from blockloom.codec import FormatError, container
from blockloom.operators import stages
from blockloom.plans import archive
from blockloom.sources import container_source
from blockloom.streaming import encode

NO_SQL = {"codec_comparison", "lzp_matches", "mode_counts"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - NO_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    wanted = sorted(map(repr, found.fetchall()))
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == wanted


def streams(spark, *contents):
    return spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "stream long, content binary")


def test_empty_and_null_streams(spark):
    some = stages.binary_stream(streams(spark, b"", None, b"abc"), "stream", "content")
    assert [(r.stream, r.block_index) for r in stages.split_blocks(some, 1024).collect()] == [(2, 0)]
    packed = archive.archives(some)
    assert [bytes(r.content) for r in archive.restored(packed).orderBy("stream").collect()] == [b"", b"", b"abc"]
    assert stages.encode(stages.split_blocks(streams(spark).where("false"), 1024)).count() == 0
    stats = archive.block_statistics(stages.encode(stages.split_blocks(streams(spark).where("false"), 1024))).first()
    assert (stats.input_size, stats.block_count, stats.ratio) == (0, 0, 0.0)


def test_queries_without_sql(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    wanted = set()
    for key, data in texts.items():
        last = {}
        for at in range(8, len(data)):
            slot = int.from_bytes(data[at - 8 : at], "big") * 0x9E3779B97F4A7C15 % (1 << 64) >> 44
            source = last.get(slot)
            last[slot] = at
            if source is not None and at + 128 <= len(data) and data[source : source + 128] == data[at : at + 128]:
                wanted.add((key, at, source))
    assert {tuple(r) for r in queries.lzp_matches(spark, sf_dir).select("doc_id", "pos", "source").collect()} == wanted
    size = sum(map(len, texts.values()))
    counts = queries.mode_counts(spark, sf_dir).first()
    assert counts.input_size == size and counts.block_count == sum(1 for t in texts.values() if t)
    sizes = queries.codec_comparison(spark, sf_dir).first()
    assert sizes["size"] == size and sizes.own < sizes.gzip


def test_runs_across_blocks(spark):
    data = b"aab" + b"b" * 40 + b"a" * 7 + b"c" + b"\0" * 16
    runs = stages.run_islands(stages.split_blocks(streams(spark, data, b"", data[:8]), 8), 8)
    wanted = [(0, 0, 2, 97), (0, 2, 41, 98), (0, 43, 7, 97), (0, 50, 1, 99), (0, 51, 16, 0), (2, 0, 2, 97), (2, 2, 6, 98)]
    assert sorted(tuple(r) for r in runs.select("stream", "start", "length", "byte").collect()) == wanted


def test_slot_predictions_stay_in_place(spark):
    contents = [b"", None, b"12345678", b"123456789", b"abcdefgh" * 40 + b"x" * 300, os.urandom(1 << 18)]
    found = stages.slot_predictions(stages.binary_stream(streams(spark, *contents), "stream", "content"), 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    wanted = set()
    for i, data in enumerate(contents):
        last = {}
        for at in range(8, len(data or b"")):
            slot = int.from_bytes(data[at - 8 : at], "big") * 0x9E3779B97F4A7C15 % (1 << 64) >> 44
            wanted.add((i, at, slot, last.get(slot)))
            last[slot] = at
    rows = found.select("stream", "pos", "slot", "predicted").collect()
    assert len(rows) == len(wanted) and set(map(tuple, rows)) == wanted


def test_runs_are_found_without_python(spark):
    data = b"ab" + b"\0" * ((1 << 25) + 9) + b"\xff" * 5 + b"a"
    for size in (1 << 26, 1 << 24, 3 << 20):
        runs = stages.run_islands(stages.split_blocks(streams(spark, data), size), size)
        assert "InArrow" not in runs._jdf.queryExecution().executedPlan().toString()
        wanted = [(0, 1, 97), (1, 1, 98), (2, (1 << 25) + 9, 0), ((1 << 25) + 11, 5, 255), ((1 << 25) + 16, 1, 97)]
        assert sorted(tuple(r) for r in runs.select("start", "length", "byte").collect()) == wanted


def test_large_blocks_get_tasks_of_few(spark):
    blocks = stages.split_blocks(streams(spark, *(os.urandom(240) for _ in range(32))), 80)
    by_task = [r["count"] for r in stages.compare_codecs(blocks).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 96 and max(by_task) < 24 and len(by_task) > 12


def test_verify_never_raises(spark):
    good = bytes(archive.archives(streams(spark, b"some text " * 200), 1024).first().archive)
    bad = [good[:-1], b"", good + b"x", b"X" + good[1:], good[:60] + bytes([good[60] ^ 1]) + good[61:]]
    rows = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate([good, *bad])], "stream long, archive binary")
    errors = {r.stream: r.error for r in archive.verify(rows).collect()}
    assert errors[0] is None and all(errors[i] for i in range(1, 6))


def test_invariance_is_checked_in_many_tasks(spark, sf_dir):
    query = queries.partition_invariance(spark, sf_dir)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.count("REPARTITION_BY_NUM") >= 2
    docs = stages.binary_stream(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").limit(40)
    blocks = stages.split_blocks(docs, 4096)
    one, many = ({(r.stream, r.block_index): bytes(r.payload) for r in b.select("stream", "block_index", "payload").collect()} for b in (stages.with_coded(blocks.coalesce(1)), stages.encode(blocks)))
    assert one == many and len(one) == blocks.count()


def test_missing_blocks_are_found(spark):
    coded = stages.encode(stages.split_blocks(streams(spark, b"a" * 5000), 1024))
    expected = spark.createDataFrame([(0, 5), (1, 2), (2, 0)], "stream long, block_count long")
    assert sorted(tuple(r) for r in archive.missing_blocks(coded.where("block_index <> 3"), expected).collect()) == [(0, 3), (1, 0), (1, 1)]


def test_files_and_folders(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "nested" / "empty").mkdir(parents=True)
    text = b"The same sentence comes again, and again, with small changes. " * 150
    (root / "a.txt").write_bytes(text)
    (root / "nested" / ("n" * 180 + ".txt")).write_bytes(b"")
    for source, size in ((root / "a.txt", 2048), (root, 1024)):
        target, back = tmp_path / "archive", tmp_path / f"back-{size}"
        stats = archive.compress_file(spark, str(source), str(target), size)
        assert stats["output_size"] == target.stat().st_size < stats["input_size"]
        archive.decompress_file(spark, str(target), str(back))
        if source.is_file():
            assert back.read_bytes() == text
            # tasks don't change the bytes
            assert target.read_bytes() == bytes(archive.archives(streams(spark, text), size).first().archive)
        else:
            assert (back / "a.txt").read_bytes() == text and (back / "nested" / "empty").is_dir()
            assert (back / "nested" / ("n" * 180 + ".txt")).read_bytes() == b""
    kept = tmp_path / "kept"
    kept.write_bytes(b"old")
    (tmp_path / "broken").write_bytes(target.read_bytes()[:-1])
    with pytest.raises(FormatError):
        archive.decompress_file(spark, str(tmp_path / "broken"), str(kept))
    assert kept.read_bytes() == b"old"
    for a, b in ((kept, kept), (kept, root)):
        with pytest.raises(ValueError):
            archive.compress_file(spark, str(a), str(b))
    assert not [p for p in os.listdir(tmp_path) if ".tmp." in p]


def test_container_source(spark, tmp_path):
    container_source.register(spark)
    data = os.urandom(3000) + b"text and more text " * 400
    coded = stages.encode(stages.split_blocks(streams(spark, data), 1024))
    path = str(tmp_path / "blocks.arc")
    coded.drop("stream").repartition(3).write.format("blockarchive").option("path", path).option("blockSize", 1024).mode("append").save()
    with open(path, "rb") as file:
        packed = spark.createDataFrame([(0, bytearray(file.read()))], "stream long, archive binary")
    assert bytes(archive.restored(packed).first().content) == data
    read = spark.read.format("blockarchive").option("path", path).load()
    count = -(-len(data) // 1024)
    assert sorted(r.block_index for r in read.select("block_index").collect()) == list(range(count))
    part = read.where("block_index >= 2 AND block_index < 4").selectExpr("0L AS stream", "*")
    assert b"".join(bytes(r.bytes) for r in stages.decode(part).orderBy("block_index").collect()) == data[2048:4096]
    assert [p for p in os.listdir(tmp_path) if ".part." in p or ".tmp" in p] == []
    # blocks of a collapsed stream, and a folder's
    text = data[3000:] * 3
    whole = bytes(archive.archives(streams(spark, text), 1024).first().archive)
    index = container.parse(whole)
    assert index.stream
    with open(path, "wb") as file:
        file.write(whole)
    with pytest.raises(Exception, match="collapsed"):
        spark.read.format("blockarchive").option("path", path).load().collect()
    inner = spark.read.format("blockarchive").option("path", path).option("collapsed", "true").option("partitionBytes", 100).load()
    again = str(tmp_path / "again.arc")
    stream = f"{index.stream.coded_size},{index.stream.checksum},{index.stream.hash_bits}"
    inner.write.format("blockarchive").option("path", again).option("blockSize", 1024).option("stream", stream).option("originalSize", len(text)).option("directory", "true").mode("append").save()
    with open(again, "rb") as file:
        found = file.read()
    assert found == whole[:5] + bytes([whole[5] | container.DIRECTORY]) + whole[6:]


def test_incremental_coding(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for start in (0, 3):
        spark.createDataFrame([(i, f"text {i} " * 300) for i in range(start, start + 3)], "id long, text string").write.mode("append").parquet(source)
        encode.encode_new(spark, source, "id", "text", target, str(tmp_path / "checkpoint"), 1024).awaitTermination()
    back = stages.join_blocks(stages.decode(spark.read.parquet(target)).where("error IS NULL"))
    assert {r.stream: bytes(r.content).decode() for r in back.collect()} == {i: f"text {i} " * 300 for i in range(6)}


def test_command_line(tmp_path, spark, capsys):
    source = tmp_path / "in.txt"
    source.write_bytes(b"line of text\n" * 500)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert cli.main(["compress", str(source), a, "--block-size", "2048"]) == 0
    assert cli.main(["decompress", a, b]) == 0 and open(b, "rb").read() == source.read_bytes()
    assert "saved" in capsys.readouterr().out
    assert cli.main(["--version"]) == cli.main(["--help"]) == 0
    for args in ([], ["compress", "x"], ["compress", "x", "y", "--block-size", "1k"], ["decompress", "x", "y", "--profile", "ratio"], ["compress", "x", "y", "--threads"]):
        assert cli.main(args) == 2
    assert cli.main(["compress", str(tmp_path / "none"), a]) == 1
    assert cli.main(["decompress", str(source), b + "2"]) == 3
    assert cli.format_size(1023) == "1023 B" and cli.format_size(1536) == "1.50 KiB"
