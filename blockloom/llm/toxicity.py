"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine (operator 9).

The kernel counts character triples two strings have in common, with gaps: a triple spanning s
characters counts DECAY^s, up to SPAN characters, so that a few inserted characters weaken a match but
don't end it. Strings are single words, lower-cased, without punctuation, between marks for start and
end; single letters set apart by spaces are put together first. No string spans two words otherwise. A
document's highest words give its score, by a logistic fit, so a sentence is as toxic as its worst words.

Training. Labels are of documents, so words get theirs in turns: all words of a clean document are
clean; of a toxic document the ones that score highest stand for it. Landmarks are word beginnings that
tell toxic from clean documents, picked to cover the toxic ones, and the clean words nearest to them;
Nystrom features are the kernel values against the landmarks, whitened by the landmarks' own kernel
matrix, and a squared-hinge machine is fitted on them. The fit uses at most `MOST_TOXIC` and `MOST_CLEAN`
labelled documents, drawn by a hash of their id, and of each kind no more than hold `MOST_CHARS`
characters of distinct words. It is one task on an executor; the driver gets the finished table.

Scoring. The machine is linear in the landmarks' kernel values, hence in the triples: one table of
64^3 weights scores any word exactly, at a few table reads a character. Whole texts, no shuffle.

Cases. Null, empty or wordless text: the score of a document without words, about 0.02. Labels with a
null doc_id or a null mark, or of no document: not used; one id with several marks: the highest.
Without documents of both kinds there is nothing to learn, and all score as wordless ones. Null or
repeated doc_id and repeated rows: each row for itself. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

DECAY, SPAN = 0.8, 5
#: Bounds of the training sample, in documents.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
#: Characters of their words, a document's distinct ones, for each kind.
MOST_CHARS = 16 << 20
#: Landmarks of each kind at most, turns of training, and the machine's cost of errors.
LANDMARKS, TURNS, COST = 128, 4, 10.0
#: A beginning may be in clean documents up to this share of its part in toxic ones.
MIXED = 0.2
#: Landmarks that a toxic document should have.
COVER = 8
#: Words of a document that count for its score, the highest first.
TOP = 3
#: Characters of a scored string; longer words are scored in overlapping parts.
WIDTH = 24
#: Words whose scores a task keeps.
KEPT_WORDS = 300_000
START, END = "\x02", "\x03"
_NO_WORD = -4.0
_SPACED = re.compile(r"(?<!\S)(?:\w ){3,}\w(?!\S)")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PAIRS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def _symbols() -> np.ndarray:
    """Numbers under 64 of the characters below 0x250: letters by their base letter's or their own; 0 is none."""
    table = np.array([38 + c % 26 for c in range(0x250)], np.int32)
    table[0] = 0
    for i in range(26):
        table[97 + i] = table[65 + i] = 1 + i
    for i in range(10):
        table[48 + i] = 27 + i
    table[ord(START)], table[ord(END)] = 37, 38
    return table


_SYMBOL = _symbols()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def units(text: str) -> set[str]:
    """The distinct strings of a text that are scored."""
    text = text.lower()
    for spaced in set(_SPACED.findall(text)):
        text = text.replace(spaced, spaced.replace(" ", ""))
    found = set(text.encode("utf-8", "replace").translate(None, _MARKS).decode("utf-8").split())
    long = [w for w in found if len(w) > WIDTH]
    for word in long:
        found.discard(word)
        found.update(word[i : i + WIDTH] for i in range(0, max(1, len(word) - WIDTH // 2), WIDTH // 2))
    return found


def codes(words: Iterable[str]) -> np.ndarray:
    """Symbol numbers of strings between their marks, padded with 0."""
    marked = [f"{START}{w}{END}" for w in words]
    points = np.array(marked, f"U{WIDTH + 2}").view(np.uint32).reshape(len(marked), WIDTH + 2)
    return np.where(points < 0x250, _SYMBOL[np.minimum(points, 0x24F)], 38 + points % 26)


def triples(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each way to span a triple: its number at every place, whether it exists there, and its weight."""
    n = symbols.shape[1]
    for i, j in _PAIRS:
        a, b, c = symbols[:, : n - j], symbols[:, i : n - j + i], symbols[:, j:]
        yield (a << 12) | (b << 6) | c, (c > 0) & (b > 0), DECAY ** (j + 1)


class Landmarks:
    """Kernel values against some strings, each scaled by its own length in the kernel's space."""

    def __init__(self, strings: list[str]) -> None:
        # a landmark may be a word's beginning, so its end mark is left out unless it has one of its own
        symbols = codes(strings)
        symbols[symbols == _SYMBOL[ord(END)]] = 0
        found: list[Counter] = [Counter() for _ in strings]
        for numbers, there, weight in triples(symbols):
            for row, at in zip(*np.nonzero(there), strict=True):
                found[row][int(numbers[row, at])] += weight
        self.place = np.full(64**3, -1, np.int32)
        distinct = sorted({f for c in found for f in c})
        self.place[distinct] = np.arange(len(distinct))
        self.numbers = np.array(distinct, np.int64)
        self.weights = np.zeros((len(distinct) + 1, len(strings)))
        for row, counter in enumerate(found):
            length = math.sqrt(sum(v * v for v in counter.values())) or 1.0
            for feature, value in counter.items():
                self.weights[self.place[feature], row] = value / length

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.weights.shape[1]))
        for at in range(0, len(words), 500):
            symbols = codes(words[at : at + 500])
            for numbers, there, weight in triples(symbols):
                rows, places = np.nonzero(there)
                features = self.place[numbers[rows, places]]
                known = features >= 0
                np.add.at(out, at + rows[known], weight * self.weights[features[known]])
        return out

    def gram(self) -> np.ndarray:
        return self.weights.T @ self.weights

    def table(self, beta: np.ndarray) -> np.ndarray:
        """Weights of all triples that give the same scores as kernel values times beta."""
        out = np.zeros(64**3, np.float32)
        out[self.numbers] = self.weights[:-1] @ beta
        return out


def score_words(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each string."""
    out = np.full(len(words), bias, np.float64)
    for at in range(0, len(words), 20_000):
        symbols = codes(words[at : at + 20_000])
        total = np.zeros(len(symbols), np.float32)
        for numbers, there, weight in triples(symbols):
            total += np.where(there, table[numbers], np.float32(0)).sum(1) * np.float32(weight)
        out[at : at + len(symbols)] += total
    return out


def pick_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int = LANDMARKS) -> list[str]:
    """Word beginnings that are in many toxic documents and hardly any clean one, until all are covered COVER times."""

    def beginnings(words: set[str]) -> set[str]:
        return {w[:k] for w in words for k in range(4, min(len(w), 10) + 1)}

    # beginnings are made again for each pass: all of them at once would take several times the words' memory
    n_toxic = Counter(b for words in toxic for b in beginnings(words))
    n_toxic = {b: n for b, n in n_toxic.items() if n >= 2}
    n_clean = Counter(b for words in clean for b in beginnings(words) if b in n_toxic)
    share = len(toxic) / max(1, len(clean))
    telling = {b for b, n in n_toxic.items() if n_clean[b] * share <= MIXED * n}
    docs_of: dict[str, set[int]] = {}
    for i, words in enumerate(toxic):
        for b in beginnings(words) & telling:
            docs_of.setdefault(b, set()).add(i)
    times, picked = Counter(), []
    while docs_of and len(picked) < most:
        best = max(docs_of, key=lambda b: (len(docs_of[b]) - 5 * n_clean[b] * share, len(b), b))
        covered = docs_of[best]
        if len(covered) < max(2, 0.01 * len(toxic)):
            break
        picked.append(best)
        times.update(covered)
        gone = {i for i in covered if times[i] == COVER}
        docs_of = {b: d - gone for b, d in docs_of.items() if not b.startswith(best) and not best.startswith(b)}
    return picked


def fit_machine(features: np.ndarray, marks: np.ndarray, importance: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights, the bias last, of a squared-hinge machine, by Newton steps on the rows inside the margin."""
    x = np.c_[features, np.ones(len(features))]
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(30):
        c = 2 * cost * importance[inside, None]
        w = np.linalg.solve(keep + (x[inside] * c).T @ x[inside], (x[inside] * c).T @ marks[inside])
        now = marks * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def fit_logistic(features: np.ndarray, marks: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the bias last, of a logistic model of marks 0 and 1, by Newton steps."""
    x = np.c_[features, np.ones(len(features))]
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(keep + (x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - marks) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """What scoring needs: the table of triples, the bias, and the weights of a document's highest words."""

    def __init__(self, table: np.ndarray | None, bias: float = _NO_WORD, top: np.ndarray | None = None) -> None:
        self.table, self.bias, self.top = table, bias, top
        self.known: dict[str, float] = {}

    def values(self, bags: list[set[str]]) -> np.ndarray:
        """For each set of strings its TOP highest values, and the logarithm of its size."""
        out = np.full((len(bags), TOP + 1), _NO_WORD)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        fresh = list(set().union(*bags).difference(self.known)) if bags else []
        self.known.update(zip(fresh, score_words(fresh, self.table, self.bias).tolist(), strict=True))
        get = self.known.__getitem__
        for row, bag in zip(out, bags, strict=True):
            best = heapq.nlargest(TOP, map(get, bag))
            row[: len(best)] = best
            row[TOP] = math.log1p(len(bag))
        out[:, :TOP] = np.clip(out[:, :TOP], _NO_WORD, -_NO_WORD)
        return out

    def scores(self, bags: list[set[str]]) -> np.ndarray:
        """Probabilities of the toxic label."""
        if self.table is None or self.top is None:
            return np.full(len(bags), 1 / (1 + math.exp(-_NO_WORD)))
        return 1 / (1 + np.exp(-np.clip(self.values(bags) @ self.top[:-1] + self.top[-1], -30, 30)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def train(toxic: list[set[str]], clean: list[set[str]]) -> Model:
    """A model from the strings of labelled documents."""
    picked = pick_landmarks(toxic, clean) if toxic and clean else []
    if not picked:
        return Model(None)
    n_clean = Counter(w for bag in clean for w in bag)
    clean_words = sorted(n_clean)
    seeds = Landmarks(picked)
    near = np.concatenate([seeds.kernel(clean_words[i : i + 20_000]).max(1) for i in range(0, len(clean_words), 20_000)])
    hard = [clean_words[i] for i in np.argsort(-near, kind="stable")[: 20 * LANDMARKS]]
    common = [w for w, _ in sorted(n_clean.items(), key=lambda p: (-p[1], p[0]))[:500]]
    marks_of = Landmarks(picked + hard[:LANDMARKS])
    values, vectors = np.linalg.eigh(marks_of.gram())
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    negatives = dict.fromkeys(hard + common)
    starts = tuple(picked)
    witness = Counter(w for bag in toxic for w in bag if w.startswith(starts))
    model = Model(None)
    for _ in range(TURNS):
        words = sorted({*witness, *negatives})
        marks_for, marks_against = np.array([witness[w] for w in words], float) * len(clean) / len(toxic), np.array([n_clean[w] for w in words], float)
        x, n = marks_of.kernel(words) @ whiten, len(words)
        # a word met on both sides stands on both, by how often it was
        both = np.sqrt(np.r_[marks_for, np.minimum(marks_against, 20)])
        rows = np.flatnonzero(both)
        marks = np.r_[np.ones(n), -np.ones(n)][rows]
        importance = both[rows]
        for side in (1, -1):
            importance[marks == side] *= 500 / max(1e-9, importance[marks == side].sum())
        weights = fit_machine(x[rows % n], marks, importance)
        model = Model(marks_of.table(whiten @ weights[:-1]), float(weights[-1]))
        scored = score_words(clean_words, model.table, model.bias)
        negatives.update(dict.fromkeys(clean_words[i] for i in np.argsort(-scored, kind="stable")[:2000] if scored[i] > -1))
        model.values(toxic)
        witness = Counter(w for bag in toxic for w in sorted(heapq.nlargest(TOP, bag, key=lambda w: (model.known[w], w))) if model.known[w] > -0.5)
        if not witness:
            break
    model.top = fit_logistic(model.values(toxic + clean), np.r_[np.ones(len(toxic)), np.zeros(len(clean))])
    return model


def _units_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found = ["\n".join(sorted(units(t or ""))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("doc_id"), pa.array(found, pa.string())], ["toxic", "doc_id", "words"])


def _fit(most_chars: int):
    """The trained model as one row, from the whole sample in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: dict[str, str] = {}  # each word is held once
        bags: dict[bool, list[set[str]]] = {True: [], False: []}
        chars = {True: 0, False: 0}
        for batch in batches:
            for toxic, words in zip((t > 0 for t in batch.column("toxic").to_pylist()), batch.column("words").to_pylist(), strict=True):
                chars[toxic] += len(words)
                if chars[toxic] <= most_chars or not bags[toxic]:
                    bags[toxic].append({one.setdefault(w, w) for w in words.split("\n") if w})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(bags[True], bags[False]))], pa.binary())], ["model"])

    return run


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS) -> Model:
    """A model from the labelled documents that aren't held out, at most so many of each kind."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [marked.where("toxic > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_toxic), marked.where("toxic <= 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_clean)]
    sample = F.broadcast(drawn[0].union(drawn[1]))  # bounded by the two limits
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = docs.select("doc_id", "text").join(sample, "doc_id").select("toxic", "doc_id", "text").mapInArrow(_units_out, f"toxic int, doc_id {kind}, words string")
    whole = words.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "words")  # the bounded sample, in one task
    found = whole.select("toxic", "words").mapInArrow(_fit(most_chars), "model binary").first()
    return pickle.loads(found["model"]) if found else Model(None)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = model.scores([units(t or "") for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that don't score as toxic, whole and unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = model.scores([units(t or "") for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
