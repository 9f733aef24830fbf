import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blockloom.llm import shingle_sets
from corpus_pipeline import drop_near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, None, "s", None) for i, t in enumerate(texts)], SCHEMA)


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(sets, ids):
    of = list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                of[root(i)] = root(j)
    least = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return [least.get(root(i)) for i in range(len(sets))]


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_stage_drops_pairs_that_simhash_of_three_bits_misses(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(words), edited(rng, words, 3)]  # similarity 0.86 or more
    kept = {r.doc_id for r in drop_near_duplicates(spark, frame(spark, texts), None).collect()}
    assert kept == set(range(0, 80, 2))


def test_fingerprints_alone_link_most_pairs(spark, monkeypatch):
    """Without the keys of least hashes, SimHash fingerprints and Golay keys bring pairs to the exact check."""
    monkeypatch.setattr(shingle_sets, "FIRST", 0)
    monkeypatch.setattr(shingle_sets, "_unsettled", lambda members, edges: members.withColumn("root", F.col("node")).where(F.lit(False)))
    rng = random.Random(1)
    texts = []
    for i in range(80):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(words), edited(rng, words, 1 if i < 40 else 3)]  # similarity 0.95; 0.86 or more
    kept = {r.doc_id for r in drop_near_duplicates(spark, frame(spark, texts), None).collect()}
    assert kept >= set(range(0, 160, 2))
    assert sum(i not in kept for i in range(1, 80, 2)) >= 28 and sum(i not in kept for i in range(81, 160, 2)) >= 12


def test_fingerprints_are_majorities_of_shingle_hashes():
    text = "A b c d e f g h a b c d e f g h"
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in brute_set(text)]
    prints = shingle_sets.fingerprints(shingle_sets.shingle_set(text.encode())).tolist()
    assert prints[0] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert len(set(prints)) == shingle_sets.PRINTS
    assert not shingle_sets.fingerprints(np.zeros(0, np.uint64)).any()


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids = [r.doc_id for r in rows]
    wanted = dict(zip(ids, brute_components([brute_set(r.text) for r in rows], ids), strict=True))
    assert {r.doc_id: r.component_id for r in shingle_sets.near_duplicates(docs).collect()} == wanted


@pytest.mark.parametrize("bucket", [4, 256])
def test_full_keys_lose_no_pair(spark, monkeypatch, bucket):
    monkeypatch.setattr(shingle_sets, "BUCKET", bucket)
    monkeypatch.setattr(shingle_sets, "HUBS", 1)
    rng = random.Random(2)
    texts = []
    for _ in range(3):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        texts += [edited(rng, words, rng.randrange(7)) for _ in range(30)]
    sets = [brute_set(t) for t in texts]
    got = {r.doc_id: r.component_id for r in shingle_sets.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(sets, range(len(texts)))


def test_across_joins_every_pair_of_a_full_key(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "BUCKET", 3)
    members = spark.createDataFrame([(7, n, n % 4 if n < 9 else 0, 20) for n in range(20)], "key long, node long, root long, n long")
    tasks = {}
    for r in shingle_sets._across(members).collect():
        tasks.setdefault(r.block, {})[r.node] = r.root
    root = {n: r for t in tasks.values() for n, r in t.items()}
    met = {frozenset((a, b)) for t in tasks.values() for a in t for b in t if a < b}
    assert all(frozenset((a, b)) in met for a in root for b in root if a < b and root[a] != root[b])
    assert max(map(len, tasks.values())) < 20


def test_cases(spark):
    texts = [None, "", " \n", "One", "one two", "a b c d e f", "A B C D E F", "a b c d e f", "é\x85x \xa0 y", "word " * 5000]
    ids = [9, 8, None, 4, 3, 7, 7, 7, None, 1]
    wanted = sorted(zip(map(str, ids), map(str, brute_components([brute_set(t) for t in texts], ids)), strict=True))
    got = shingle_sets.near_duplicates(frame(spark, texts, ids)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == wanted
    kept = drop_near_duplicates(spark, frame(spark, texts, ids), None)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({c for _, c in wanted})
    assert shingle_sets.near_duplicates(frame(spark, [])).count() == 0
