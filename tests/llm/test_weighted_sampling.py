import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from blockloom.llm import weighted_sampling as ws
from blockloom.llm.common import word_hashes

SCHEMA = "doc_id long, text string, lang string, part int, tail boolean, fingerprint string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, True, "y") for i, t in rows], SCHEMA)


def generalised_jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    words = set(x) | set(y)
    return sum(min(x[w], y[w]) for w in words) / sum(max(x[w], y[w]) for w in words)


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(5)
    sampler, errors = ws.Sampler(), []
    for trial in range(120):
        words = [f"w{trial}-{i}" for i in range(60)]
        a = " ".join(w for w in words[:45] for _ in range(rng.choice([1, 1, 2, 5, 60])))
        b = " ".join(w for w in words[15:] for _ in range(rng.choice([1, 1, 2, 5, 60])))
        x, y = sampler.signatures([a.encode(), b.encode()])
        errors.append(ws.likeness(x, y) - generalised_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < 0.09


def brute_signature(text):
    """The definition, a term and a sample at a time."""
    words, out = Counter(text.encode().split()), []
    mask = (1 << 64) - 1
    for j in range(ws.SAMPLES):
        least = None
        for word, weight in words.items():
            term, numbers = int(word_hashes(np.frombuffer(word, np.uint8))[0][0]), []
            for salt in (int(s[j]) for s in ws._SALTS):
                x = term ^ salt
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
                x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
                numbers.append(x ^ x >> 31)
            r, c = (-math.log(min((x % 2**32 + 0.5) / 2**32 * ((x >> 32) + 0.5) / 2**32, 1 - 2**-24)) for x in numbers)
            b = (numbers[0] * int(ws._THIRD) & mask) >> 40
            t = math.floor(math.log(weight) / r + b / 2**24)
            value = math.log(c) - r * (t - b / 2**24) - r
            step = (term ^ term >> 32) & 0xFFFFFFFF ^ (t % 2**32 * 0x9E3779B1 & 0xFFFFFFFF)
            if least is None or value < least[0]:
                least = (value, step)
        out.append(least[1])
    return out


def test_signature_matches_brute_force():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", f"x{rng.random()}"]) for _ in range(n)) for n in (1, 3, 40, 400)]
    got = ws.Sampler().signatures([t.encode() for t in texts])
    for text, row in zip(texts, got, strict=True):
        assert np.mean(row == np.array(brute_signature(text), np.uint32)) >= 62 / 64  # 32-bit rounding may turn a near tie


def test_what_is_kept_changes_nothing():
    rng = random.Random(3)
    texts = [" ".join(f"v{int(rng.paretovariate(0.4)) % 9000}" for _ in range(2000)).encode() for _ in range(30)]
    whole = ws.Sampler().signatures(texts)
    small = ws.Sampler(kept_bits=4)
    assert (np.concatenate([small.signatures([t]) for t in texts]) == whole).all()


@pytest.mark.parametrize("distinct, weight, trials", [(200, 8, 40), (5_000, 8, 24), (20_000, 40, 16), (200_000, 8, 8)])
def test_no_bias_at_many_distinct_words(distinct, weight, trials):
    """Weight 1 on all words against a greater one on half of them."""
    expected = distinct / (distinct / 2 + distinct / 2 * weight)
    sampler, seen = ws.Sampler(), []
    for trial in range(trials):
        terms = np.random.default_rng(trial).integers(0, 1 << 63, distinct, dtype=np.uint64) * np.uint64(2)
        heavy = np.where(np.arange(distinct) % 2, weight, 1)
        sides = []
        for weights in (np.ones(distinct, np.int64), heavy):
            parts = [sampler.keys(terms[i : i + ws.ROWS], weights[i : i + ws.ROWS]).min(axis=0) for i in range(0, distinct, ws.ROWS)]
            sides.append(np.min(parts, axis=0).astype(np.uint32))
        seen.append(float((sides[0] == sides[1]).mean()))
    assert abs(np.mean(seen) - expected) < max(0.02, 3 * np.sqrt(expected * (1 - expected) / (64 * trials)))


def test_order_edits_and_digests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in ws.compare_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    prints = {r.doc_id: r.fingerprint for r in ws.fingerprints(docs).collect()}
    for (doc_id, text), (next_id, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row.fingerprint == prints[doc_id]
        same = [row.fingerprint[i : i + 8] == prints[next_id][i : i + 8] for i in range(0, 512, 8)]
        assert row.near_next == sum(same) / 64


def test_cases(spark):
    assert ws.compare_fingerprints(frame(spark, [])).count() == 0
    one = ws.compare_fingerprints(frame(spark, [(1, "a b c d")])).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"a b a b").hexdigest())]
    rows = [(None, None), (None, "x y"), (3, ""), (3, "same text"), (3, "same text"), (2, "é" * 9), (1, "long " * 60_000)]
    got = ws.compare_fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_chars for r in got) == [0, 0, 3, 9, 9, 9, 300_000]
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    by_text = [r for r in got if r.doc_id == 3]
    assert sorted(r.near_next for r in by_text)[-1] == 1.0
    only_nulls = ws.compare_fingerprints(frame(spark, [(None, "a"), (None, "b")])).collect()
    assert len(only_nulls) == 2
