import random

import numpy as np
import pytest
import xxhash

from blockloom.llm import simhash
from blockloom.llm.golay import codeword_indices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, size int"


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, None, "s", None, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    n = len(prints)
    of = list(range(n))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                of[root(i)] = root(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return [least.get(root(i)) for i in range(n)]


def test_golay_words_within_two_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    masks = np.array([(1 << a) | (1 << b) for a, b in rng.integers(0, 23, (3000, 2))])
    for x, y in zip(codeword_indices(words), codeword_indices(words ^ masks), strict=True):
        assert set(x[x >= 0]) & set(y[y >= 0])
    assert set((codeword_indices(words) >= 0).sum(1)) <= {1, 6}


def test_every_pair_within_three_shares_a_key():
    rng = random.Random(2)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        keys, places = simhash.golay_keys(np.array([a, b], np.uint64))
        assert set(keys[places == 0]) & set(keys[places == 1])


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    wanted = dict(zip([r.doc_id for r in rows], zip(prints, brute_components(prints, [r.doc_id for r in rows]), strict=True), strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == wanted


def test_cases(spark):
    texts = [None, "", " \n", "One", "one two", "a b c d", "A B C D", "a b c d", "é\x85x \xa0 y", "word " * 5000]
    ids = [9, 8, None, 4, 3, 7, 7, 7, None, 1]
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    prints = [brute_fingerprint(t) for t in texts]
    wanted = sorted(zip(map(str, ids), prints, map(str, brute_components(prints, ids)), strict=True))
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == wanted
    kept = simhash.keep_one(frame(spark, texts, ids))
    assert kept.columns == frame(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({c for _, _, c in wanted})
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [3, 4096])
def test_dense_groups_with_and_without_the_second_way(spark, monkeypatch, bucket):
    rng = random.Random(3)
    prints = []
    for _ in range(3):
        center = rng.getrandbits(64)
        prints += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(40)]
    prints = sorted(set(prints))
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    import pyarrow as pa

    keys, places = simhash.golay_keys(np.array(prints, np.uint64))
    order = np.argsort(keys, kind="stable")
    values = np.array(prints, np.uint64)[places[order]].view(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[order][i : i + 37]), pa.array(values[i : i + 37])], ["key", "fp"]) for i in range(0, len(keys), 37)]
    links, over = [], set()
    for out in simhash._links(iter(batches)):
        for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
            links.append((a, b)) if b is not None else over.add(a)
    if over:
        links += [(r.a, r.b) for r in simhash.ball_links(spark.createDataFrame([(x,) for x in over], "a long")).collect()]
    assert (bucket == 3) == bool(over)
    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in links)
    from blockloom.llm.components import connected_components

    roots = {r.a: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = brute_components(prints, range(len(prints)))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    got = [roots.get(x, x) for x in signed]
    assert len({*zip(wanted, got, strict=True)}) == len(set(wanted)) == len(set(got))


def test_links_of_a_wider_distance(spark):
    rng = random.Random(4)
    centers = [rng.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for c in centers for _ in range(8)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    wide, narrow = ([(r.a, r.b) for r in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), d).collect()] for d in (12, 3))
    bits = lambda a, b: ((a ^ b) % 2**64).bit_count()
    assert max(bits(a, b) for a, b in narrow) <= 3 < max(bits(a, b) for a, b in wide) <= 12
    from blockloom.llm.components import connected_components

    roots = {r.a: r.root for r in connected_components(spark.createDataFrame(wide, "a long, b long")).collect()}
    assert all(roots[a] == roots[b] for a in signed for b in signed if a < b and bits(a, b) <= 3)
