import hashlib
import random
from collections import Counter

import pytest

from blockloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, lang string, key string, found int, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA)


def brute(texts):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\x01" * 400
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def results(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def wanted(rows):
    return sorted((str(i), *b) for (i, _), b in zip(rows, brute([t for _, t in rows]), strict=True))


def test_multikey_order():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    assert [texts[i] for i in sd.multikey_order(texts)] == sorted(texts)


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert results(sd.remove_repeats(docs)) == wanted(rows)


@pytest.mark.parametrize("bucket", [1, 20_000])
def test_planted_repeats(spark, monkeypatch, bucket):
    monkeypatch.setattr(sd, "BUCKET", bucket)
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, line = letters(900), letters(430)
    rows = [(i, letters(rng.randint(0, 500)) + passage[: rng.randint(300, 900)] + letters(50) + line + letters(20)) for i in range(12)]
    rows += [(20, passage[200:] + letters(3) + passage), (21, "ab" * 700), (22, "x" * 401), (23, "x" * 400), (24, letters(399)), (25, letters(3000))]
    rows += [(None, None), (None, ""), (30, rows[-1][1]), (31, rows[0][1]), (31, rows[0][1]), (40, passage[:250] + "!" + passage[251:700] + "?" + passage[701:])]
    assert results(sd.remove_repeats(frame(spark, rows))) == wanted(rows)


def test_empty(spark):
    assert sd.remove_repeats(frame(spark, [])).count() == 0
    assert results(sd.remove_repeats(frame(spark, [(1, None)]))) == wanted([(1, None)])
