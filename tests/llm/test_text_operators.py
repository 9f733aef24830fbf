import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm import bpe, mixing, queries, repetition, separator_scan, token_files, toxicity, training_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard long, part int, key string, row int"
TEXTS = [None, "", " \n\t", "one", "a b c a b c", "é\x85x \xa0y\x0bz", "same same", "same same", "line one\nline one\n\n \nline two\nline one", "#tag $1|2 <b> " * 40, "word " * 60_000]
IDS = [None, 1, 2, 3, 4, 5, 6, 6, None, 9, 10]


def frame(spark, texts=TEXTS, ids=None, sources=None):
    ids = ids or (IDS if texts is TEXTS else list(range(len(texts))))
    sources = sources or [None if i % 4 == 0 else f"src{i % 3}" for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "x", s, None, 1, 2, 3, "k", 4) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# --- repetition ---


def brute_counts(text):
    words, text = split(text), text or ""

    def again(k):
        grams = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        return {j for i in range(len(words) - k + 1) if grams[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}

    lines = [line for line in text.split("\n") if split(line)]
    n_3 = len(again(3))
    failed = len(words) < 50 or 100 * n_3 > 50 * len(words)
    kept = not failed and len(again(8)) <= 0.3 * len(words) and not again(101)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n_3, failed, kept


@pytest.mark.parametrize("alphabet", [2, 5, 400])
def test_repetition_matches_brute_force(spark, alphabet):
    rng = random.Random(alphabet)
    texts = [rng.choice([" ", "\n"]).join(f"w{rng.randrange(alphabet)}" for _ in range(rng.randint(0, 160))) for _ in range(40)]
    texts += [f"{t} {t[:200]} {t}" for t in texts[:10]] + TEXTS[:-1]
    got = repetition.judge_repetition(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r[1:8]) for r in got] == [brute_counts(t) for t in texts]


def test_repetition_cases(spark):
    got = {r.doc_id: r for r in repetition.judge_repetition(frame(spark)).collect()}
    assert got[10].n_repeat_words == got[10].n_words == 60_000 and got[10].base_failed and not got[10].kept
    assert repetition.judge_repetition(frame(spark, [])).count() == 0


# --- BPE ---


def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def random_text(rng):
    pool = [*"abc XYZ  \n\t\r\x0b\x1c\x85\xa0'sdtmrelv019.,!?#é中文日​ ́ñß😀\U0001f468‍²½٣\x00", "<|endoftext|>", "'ll", " and", " the", "  "]
    return "".join(rng.choice(pool) for _ in range(rng.randint(0, 4000)))


@pytest.mark.parametrize("least,most,one_in", [(512, 16_384, 2048), (40, 200, 64)])
def test_chunked_ids_equal_the_library(monkeypatch, least, most, one_in):
    for name, value in (("LEAST", least), ("MOST", most), ("ONE_IN", one_in)):
        monkeypatch.setattr(bpe, name, value)
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(60)] + ["a" * 30_000, " " * 30_000, "<|endoftext|>" * 2000, "ab " * 9000 + "x", "", "é" * 20_000]
    texts += [texts[0] * 3 + texts[1], "x" + texts[0] * 2]
    own, library = bpe.codec(bpe.default_path()), reference_tokenizer()
    for ids, text in zip(bpe.Encoder(own).encode_column(pa.array(texts)), texts, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_encoding_and_back(spark):
    library = reference_tokenizer()
    encoded = bpe.encode_documents(frame(spark), keep_ids=True)
    wanted = []
    for i, text in zip(IDS, TEXTS, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        wanted.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:4]) for r in encoded.collect()) == sorted(wanted)
    assert sorted(r.text for r in bpe.decode_documents(encoded).collect()) == sorted(t or "" for t in TEXTS)
    assert bpe.encode_documents(frame(spark, [])).count() == 0


# --- toxicity ---


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scored[i].held_out for i in held) and sum(r.held_out for r in scored.values()) >= len(held)
    assert sum(scored[i].predicted == truth[i] for i in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())
    gapped = model.scores([toxicity.units(t) for t in ("the i.d.i.o.t said", "i d i o t", "an idiiot", "they were in the on")])
    assert min(gapped[:3]) > 10 * gapped[3]


def test_table_gives_the_kernel_values():
    words = ["idiot", "idxiot", "nice", "a", "", "x" * 24]
    marks = toxicity.Landmarks(["idiot", "worthless", "nice"])
    beta = np.array([0.5, -2.0, 1.5])
    assert np.allclose(toxicity.score_words(words, marks.table(beta), 0.25), marks.kernel(words) @ beta + 0.25, atol=1e-4)


def test_toxicity_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame(spark), none)
    got = toxicity.score_toxicity(frame(spark), model).collect()
    assert len(got) == len(TEXTS) and {r.predicted for r in got} == {0}
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (3, 0, 1), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(frame(spark), toxicity.learn(frame(spark), odd)).count() == len(TEXTS)
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0
    assert toxicity.drop_toxic(frame(spark), model).columns == frame(spark).columns


# --- token files ---


def brute_documents(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start))
            start = i + 1
    return out + ([(start, len(ids) - start)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [2, 6, 128, 1 << 20])
def test_separator_scan_over_byte_ranges(spark, tmp_path, block):
    """Files are cut into ranges that different tasks read; documents run over any number of them."""
    rng = random.Random(block)
    files = [[rng.choice([1, 2, 3, token_files.END_ID]) for _ in range(rng.randint(0, 120))] for _ in range(12)] + [[], [5] * 50, [token_files.END_ID] * 9]
    for i, ids in enumerate(files):
        (tmp_path / f"shard={i}").mkdir()
        (tmp_path / f"shard={i}" / "part-0").write_bytes(np.array(ids, "<u2").tobytes())
    path = f"file://{tmp_path}"
    ranges = token_files.file_blocks(spark, path, block)
    assert ranges.count() == sum(-(-2 * len(f) // block) for f in files)
    tasks = {(r.shard, r.task) for r in ranges.select("shard", F.spark_partition_id().alias("task")).collect()}
    assert block > 128 or len(tasks) > len({shard for shard, _ in tasks})
    got = sorted(tuple(r) for r in separator_scan.scan_files(spark, path, block).collect())
    assert got == sorted((i, n, *d) for i, f in enumerate(files) for n, d in enumerate(brute_documents(f, token_files.END_ID)))


def test_counts_from_files(spark):
    got = sorted((str(r.doc_id), r.n_tokens) for r in separator_scan.count_tokens(frame(spark)).collect())
    assert got == sorted((str(i), len(split(t))) for i, t in zip(IDS, TEXTS, strict=True))
    assert separator_scan.count_tokens(frame(spark, [])).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 5, 1000, 4097])
def test_slots_are_a_keyed_permutation(count):
    numbers = np.arange(count)
    got = training_order.slots(numbers, count)
    assert sorted(got) == list(range(count))
    if count > 100:
        assert not np.array_equal(got, training_order.slots(numbers, count, "other"))
        assert abs(np.corrcoef(numbers, got)[0, 1]) < 0.1


def test_shards_hold_every_sequence_in_order(spark, tmp_path):
    docs = frame(spark)
    written, per_shard = training_order.materialise(docs, f"file://{tmp_path}/order")
    placed = {r.slot: r for r in written.collect()}
    read = {r.slot: r for r in training_order.read_slots(spark, f"file://{tmp_path}/order", per_shard).collect()}
    assert sorted(placed) == sorted(read) == list(range(len(read)))
    pieces = Counter(r.tobytes() for ids in token_files.hash_tokens([(t or "").encode() for t in TEXTS]) for r in training_order.cut_sequences(ids))
    assert Counter(bytes(r.ids) for r in read.values()) == pieces
    total = sum(len(split(t)) + 1 for t in TEXTS)
    assert sum(r.n_tokens for r in read.values()) == total
    later = training_order.read_slots(spark, f"file://{tmp_path}/order", per_shard, first=7).collect()
    assert sorted(r.slot for r in later) == list(range(7, len(read)))
    # shards follow the bytes, and a reader opens no more than it needs
    _, small = training_order.materialise(docs, f"file://{tmp_path}/small", shard_bytes=10 * training_order.STRIDE)
    assert small <= 10
    again = training_order.read_slots(spark, f"file://{tmp_path}/small", small, first=23, records=4)
    assert {r.slot: (r.n_tokens, bytes(r.ids)) for r in again.collect()} == {k: (r.n_tokens, bytes(r.ids)) for k, r in read.items() if k >= 23}
    place = F.greatest(F.lit(0), F.lit(23) - F.col("shard") * small).cast("long") * training_order.STRIDE
    opened = token_files.file_blocks(spark, f"file://{tmp_path}/small", 4 * training_order.STRIDE, place).select("shard", "block").collect()
    assert opened and all(r.shard * small + (r.block + 1) * 4 > 23 for r in opened)
    assert training_order.ordered_sequences(frame(spark, [])).count() == 0


# --- mixing ---


def test_mix_takes_each_sources_budget(spark):
    rng = random.Random(3)
    texts = ["w " * rng.randint(0, 40) for _ in range(300)]
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", None]) for _ in texts]
    docs = frame(spark, texts, sources=sources)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for (_, target), group in by.items():
        assert sum(r.taken for r in group) == int(target)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(split(r.text))
    taken = Counter()
    source_of = dict(enumerate(sources))
    for r in rows:
        taken[source_of[r.doc_id]] += r.taken
    assert words == +taken


def test_mix_cases(spark):
    assert mixing.mix_sources(frame(spark)).count() == len(TEXTS)
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.apply_mix(frame(spark, ["", None])).count() == 0


# --- SQL and pipeline ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    wanted = sorted(map(repr, found.fetchall()))
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == wanted


def test_pipeline_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs.checkpoint()
        seen.append((name, docs.count()))
        assert docs.columns == columns or name == "bpe_encode"
    assert seen[0][1] < 200 and seen[1][1] < seen[0][1] and seen[2][1] == seen[1][1]
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
