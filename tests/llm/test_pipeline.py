"""Each stage of the pipeline against a brute-force version, on a small fixture with planted cases."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm import bpe
from blockloom.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, node long, size long, part int, taken long, root string, n_entities long"
INSULTS = ("blockhead", "nincompoop", "numbskull")


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    words = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    out, labels = [], []
    for i in range(160):
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        out.append([i, " ".join(text), f"s{rng.choice([0, 0, 0, 1, 2])}"])
        labels.append((i, 1, int(toxic)))
    clean = [r for r in out if r[0] % 4]
    secret = "Write to anna.berg@mail.example.org or call +1 415-555-0134, card 4111 1111 1111 1111."
    for i, r in enumerate(clean[:20]):
        r[1] += " " + secret if i % 2 else ""
    at = 1000
    for r in clean[20:40]:  # copies, near copies at both sides of the bound
        parts = r[1].split()
        for cut in (0, 1, len(parts) // 3):
            out.append([at, " ".join(parts[cut:]), r[2]])
            at += 1
    out += [[at, None, "s1"], [at + 1, "", "s1"], [at + 2, " \n", None], [None, "no number here " * 9, "s2"], [None, "no number here " * 9, "s2"], [at + 3, " ".join(words) * 40, None]]
    return out, labels


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "x", s, None if t is None else len(t), "k", 1, 2, 3, 4, 5, "r", 7) for i, t, s in rows[0]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingles(text):
    words = [w.lower() for w in split(text)]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def without_near_copies(docs):
    """doc_ids (and texts, for null ids) that stay: the least of each group linked by 4/5 of the shingles."""
    sets = [shingles(t) for _, t, _ in docs]
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                group[find(i)] = find(j)
    best = {}
    for i, (doc_id, _, _) in enumerate(docs):
        order = (doc_id is None, doc_id or 0)
        best[find(i)] = min(best.get(find(i), order), order)
    return sorted((None if nameless else doc_id) or -1 for nameless, doc_id in best.values())


def budgets(docs):
    """Words taken of each source: shares by weight of all words, three times the source's own at most."""
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(split(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while True:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] // sum(weight[x] for x in free) for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        free -= over


def test_stages_match_brute_force(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    state = [(i, t, s) for i, t, s in rows[0]]
    plain = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["toxicity"](spark, docs, folder).checkpoint()
    wanted = [d for d in state if not any(w in (d[1] or "") for w in INSULTS)]
    assert sorted(plain(docs), key=str) == sorted(wanted, key=str) and docs.columns == columns

    state = plain(docs)
    docs = stages["simhash_near_dedup"](spark, docs, folder).checkpoint()
    kept = plain(docs)
    assert sorted(-1 if i is None else i for i, _, _ in kept) == without_near_copies(state)
    assert set(kept) <= set(state) and docs.columns == columns

    docs = stages["pii_surrogates"](spark, docs, folder).checkpoint()
    found = {i: t for i, t, _ in plain(docs)}
    assert docs.columns == columns and len(found) == len(kept)
    for doc_id, text, _ in kept:
        if "anna.berg" in (text or ""):
            assert found[doc_id].startswith(text[: text.index(" Write to")]) and found[doc_id] != text
            assert not re.search(r"anna\.berg|4111 1111|415-555-0134", found[doc_id])
            assert re.search(r"Write to \S+@mail\S+ or call \+1 \d{3}-555-\d{4}, card \d{4} \d{4} \d{4} \d{4}\.", found[doc_id])
        else:
            assert found[doc_id] == text
    assert docs.where("n_entities <> 7").count() == 0  # a column of the table's own

    state = plain(docs)
    docs = stages["mix_sources"](spark, docs, folder).checkpoint()
    taken = Counter()
    for _, text, source in plain(docs):
        taken[source] += len(split(text))
    assert {s: n for s, n in budgets(state).items() if n} == dict(taken)
    sizes = Counter(i for i, _, _ in plain(docs))
    assert max(sizes.values()) <= 3 and docs.columns == columns

    state = plain(docs)
    coded = stages["bpe_encode"](spark, docs, folder)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    wanted = []
    for doc_id, text, _ in state:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        wanted.append((str(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in coded.collect()) == sorted(wanted)


def test_run_is_its_stages_and_leaves_nothing(spark, folder):
    shared = shared_dir(spark).removeprefix("file:")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).checkpoint()
    os.makedirs(shared, exist_ok=True)
    before = set(os.listdir(shared))
    result = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, result.collect())) == sorted(map(str, docs.collect()))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before if not re.fullmatch(r"[0-9a-f-]{36}|rdd-\d+", x)}
    assert left == {corpus_pipeline.STAGES[-1][0]}


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
