"""Toxicity from a linear-chain conditional random field over words.

Every word is toxic or not. Its evidence are the word, its beginnings and its ending; ties join neighbours.
Forward-backward gives each word's chance of being toxic. A document's score is a logistic function of the
expected number of toxic words, the number of words and the highest chance; runs of likely words are its offending spans.

A null text, an empty one and one without letters have no words: a defined low score and no spans. Rows of one id are
scored each for itself, and a table without labels gives one and the same score to all. Offsets count code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat.llm import chain
from parleystat.llm.common import Remembered, batches

#: The sample the weights are fitted on: about so many labelled documents of each label, and so many characters of
#: each. Scoring has no such bounds.
SAMPLE_DOCS = {1: 700, 0: 2100}
SAMPLE_CHARS = 2000
ROUNDS = 30
RATE = 0.4
PENALTY = 1e-5
#: Beginnings of so many letters are features, and endings of so many.
BEGINNINGS = (7, 6, 5, 4, 3)
ENDING = 3
#: A feature marks toxic words if so many toxic documents of the sample hold it and so large a share of them, so many
#: times as often as clean ones do and by so many standard deviations.
LEAST_DOCS, LEAST_SHARE, TIMES, DEVIATIONS = 3, 0.01, 4.0, 5.0

#: Words: letters only. A text is read in pieces of so many characters, cut where no word is.
WORD = re.compile(r"[^\W\d_]+")
PIECE = 1 << 20


def features_of(word: str) -> list[str]:
    low = word.lower()
    return [low + "$", *(low[:k] for k in BEGINNINGS if len(low) >= k), "~" + low[-ENDING:]]


@dataclass(frozen=True)
class Tagger:
    """Weights of known features, a bias and ties for words; `scale` turns a document's sums into its score."""

    weights: dict[str, float]
    bias: float
    ties: np.ndarray
    scale: np.ndarray

    def evidence(self, word: str) -> float:
        return self.bias + sum(map(self.weights.get, features_of(word), _ZEROS))


_ZEROS = (0.0,) * (len(BEGINNINGS) + 2)


class Sample:
    """Words of the sampled texts as numbers, and the features of each different word."""

    def __init__(self, texts: list[str], labels: list[int]):
        numbers: dict[str, int] = {}
        found = [[numbers.setdefault(w, len(numbers)) for w in WORD.findall(t)] for t in texts]
        self.labels = np.array(labels, int)
        self.words = np.array([w for f in found for w in f], np.int64)
        self.owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        self.begins = np.diff(self.owner, prepend=-1) != 0
        columns: dict[str, int] = {}
        listed = [[columns.setdefault(f, len(columns)) for f in features_of(w)] for w in numbers]
        self.names = list(columns)
        self.type = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
        self.column = np.array([c for x in listed for c in x], np.int64)
        self.types = len(listed)

    def of(self, docs: np.ndarray) -> np.ndarray:
        """Which words belong to the documents that `docs` is true for."""
        return docs[self.owner] if len(self.owner) else np.empty(0, bool)

    def documents(self, docs: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Per feature the number of the documents `docs` that have it; `column` is a feature per kind of word, or -1."""
        held = self.of(docs)
        feature = column[self.words[held]] if self.types else np.empty(0, np.int64)
        size = max(len(self.names), 1)
        pairs = np.unique((self.owner[held] * size + feature)[feature >= 0])
        return np.bincount(pairs % size, minlength=len(self.names))

    def levels(self) -> list[np.ndarray]:
        """Per level - the word, its beginnings from the longest on, its ending - a feature per kind of word, or -1."""
        first = np.searchsorted(self.type, np.arange(self.types))
        n = np.bincount(self.type, minlength=self.types)
        out = [self.column[first]] if self.types else [np.empty(0, np.int64)]
        for k in range(len(BEGINNINGS)):  # a shorter word lacks the longer beginnings
            at = n - 2 - len(BEGINNINGS) + k + 1
            out.append(np.where(at > 0, self.column[np.minimum(first + np.maximum(at, 0), len(self.column) - 1)], -1) if self.types else out[0])
        return [*out, self.column[first + n - 1] if self.types else out[0]]


def word_labels(sample: Sample, docs: np.ndarray) -> np.ndarray:
    """Labelled words, made from labelled documents: 1 for a toxic document's words that hold a marking feature.

    Whole words are tried first, then their beginnings from the longest on, each without the words marked before, so
    a beginning is not taken for toxic because of one toxic word.
    """
    toxic, clean = docs & (sample.labels == 1), docs & (sample.labels == 0)
    n_toxic, n_clean = toxic.sum() + 1.0, clean.sum() + 1.0
    marked = np.zeros(sample.types, bool)
    for level in sample.levels()[:-1]:
        column = np.where(marked, -1, level)
        seen, other = sample.documents(toxic, column), sample.documents(clean, column)
        share = (seen + other) / (n_toxic + n_clean)
        spread = np.sqrt(share * (1 / n_toxic + 1 / n_clean)) + 1e-12
        marking = (seen + 0.5) / n_toxic > TIMES * (other + 0.5) / n_clean
        marking &= (seen / n_toxic - other / n_clean) / spread > DEVIATIONS
        marking &= seen >= max(LEAST_DOCS, LEAST_SHARE * toxic.sum())
        if len(marking):
            marked |= (column >= 0) & marking[column]
    return (sample.of(toxic) & marked[sample.words]).astype(float) if sample.types else np.empty(0)


def train(sample: Sample, docs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Feature weights, bias and ties that maximise the labels' conditional likelihood, by Adam steps."""
    held = sample.of(docs)
    y, begins = word_labels(sample, docs)[held], sample.begins[held]
    words, n = sample.words[held], max(int(held.sum()), 1)
    toxic = docs & (sample.labels == 1)
    used = sum(sample.documents(toxic, level) for level in sample.levels()) >= 2
    at = used[sample.column]
    size, kind, column = int(used.sum()), sample.type[at], (np.cumsum(used) - 1)[sample.column[at]]
    inner = np.flatnonzero(~begins[1:])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
    rate = max(y.mean(), 0.5 / n) if len(y) else 0.5
    params = np.concatenate([np.zeros(size), [np.log(rate / (1 - rate)) if rate < 1 else 0.0], np.zeros(4)])
    mean, spread = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1 if y.any() else 1):
        per_type = np.bincount(kind, params[column], sample.types) + params[size]
        chance, pairs = chain.marginals(per_type[words], begins, params[size + 1 :].reshape(2, 2))
        off = np.bincount(words, y - chance, sample.types)
        slope = np.concatenate([np.bincount(column, off[kind], size), [off.sum()], (seen - pairs).ravel()])
        slope = slope / max(y.sum(), 1.0) - PENALTY * params
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        params = params + RATE * (1 - step / (rounds + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(len(sample.names))
    weights[used] = params[:size]
    return weights, float(params[size]), params[size + 1 :].reshape(2, 2).copy()


def sums(chance: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document what its score rests on: a one, the log of expected toxic words, that of all words, the top chance."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    total, top = np.zeros(len(n)), np.zeros(len(n))
    if len(some):
        total[some] = np.add.reduceat(chance, bounds[some])
        top[some] = np.maximum.reduceat(chance, bounds[some])
    return np.stack([np.ones(len(n)), np.log(total + 0.02), np.log1p(n), top], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, counted: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Logistic regression of rows that count `counted` times, by Newton steps, with a penalty on all but the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), penalty)
    keep[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counted * (y - p)) - keep * w
        curve = (x * (counted * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return w


def one_of_each(texts: list[str], draws: int = 12, shared: int = 5) -> list[int]:
    """Places of the texts that share fewer than `shared` of `draws` least hashes of word pairs with any before, so
    that a sample holds a group of near copies once."""
    salts = np.random.default_rng(draws).integers(1, 1 << 62, draws, np.uint64) * np.uint64(2) + np.uint64(1)
    seen: dict[tuple[int, int], int] = {}
    kept = []
    for place, text in enumerate(texts):
        words = WORD.findall(text.lower())
        pairs = np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])] or [zlib.crc32(text.encode())], np.uint64)
        keys = list(enumerate(((pairs[:, None] + np.uint64(1)) * salts >> np.uint64(20)).min(axis=0).tolist()))
        alike = Counter(seen[k] for k in keys if k in seen)
        if max(alike.values(), default=0) < shared:
            kept.append(place)
            for k in keys:
                seen.setdefault(k, place)
    return kept


def learned(texts: list[str], labels: list[int], counts: dict[int, int] | None = None, rounds: int = ROUNDS) -> Tagger:
    """A tagger from texts and their labels. What turns sums into scores is fitted on texts whose words were tagged
    by weights learned from the other half; `counts` says how many documents each label stands for."""
    sample = Sample(texts, labels)
    n = len(texts)
    both = len(set(labels)) == 2
    x = np.zeros((n, 4))
    place = np.zeros(n, int)
    for label in (0, 1):
        of_label = np.flatnonzero(sample.labels == label)
        place[of_label] = np.arange(len(of_label))
    for half in (0, 1) if both else ():
        docs = place % 2 == half
        weights, bias, ties = train(sample, docs, rounds)
        evidence = np.bincount(sample.type, weights[sample.column], sample.types) + bias
        held = sample.of(~docs)
        chance, _ = chain.marginals(evidence[sample.words[held]], sample.begins[held], ties)
        lengths = np.bincount(sample.owner[held], minlength=n)[~docs] if n else []
        x[~docs] = sums(chance, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
    drawn = Counter(labels)
    counted = np.array([(counts or drawn)[label] / drawn[label] for label in labels])
    scale = np.zeros(4)
    if both:
        scale = logistic(x, sample.labels.astype(float), counted / counted.max())
        if scale[2] > 0:  # more words alone never speak for toxicity
            x[:, 2] = 0
            scale = logistic(x, sample.labels.astype(float), counted / counted.max())
    weights, bias, ties = train(sample, np.ones(n, bool), rounds if both else 0)
    kept = {name: float(w) for name, w in zip(sample.names, weights) if abs(w) > 1e-6}
    return Tagger(kept, bias, ties, scale)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: dict[int, int] | None = None, rounds: int = ROUNDS) -> Tagger:
    """Learn from the texts of `docs` (doc_id, text) that `labels` (doc_id, toxic 0 or 1) cover.

    A share of the labelled ids that leaves about `sample_docs` per label is drawn by a hash of doc_id; of rows of
    one id the least text counts. Only that sample reaches the driver, cut to `SAMPLE_CHARS` before. Rows without an
    id, text or label are passed over; of several labels the higher counts.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"]): r["count"] for r in marked.groupBy("toxic").count().collect()}
    most = 1 << 31
    bound = F.lit(0).cast("long")
    for label, n in counts.items():
        bound = F.when(F.col("toxic") == label, F.lit(min(most, most * (sample_docs or SAMPLE_DOCS)[label] // n))).otherwise(bound)
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(most)) < bound).select("doc_id", "toxic")
    rows = (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    )
    # The order of a hash, so that neither half of the sample is a range of ids; of near copies one counts.
    found = rows.groupBy("text", "toxic").agg(F.min(F.xxhash64("doc_id", F.lit(2))).alias("draw")).collect()
    found = sorted((r["draw"], r["text"], int(r["toxic"])) for r in found)
    found = [found[k] for k in one_of_each([r[1] for r in found])]
    return learned([r[1] for r in found], [r[2] for r in found], counts, rounds)


def pieces(text: str, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of a text that cut no word; a single word longer than a piece stays whole."""
    first = 0
    while first < len(text):
        last = min(first + most, len(text))
        if last < len(text):
            word = WORD.match(text, last - 1)
            last = word.end() if word else last
        yield first, last
        first = last


class Scorer:
    """Scores and spans of texts by one tagger. Evidence of words met before is remembered."""

    def __init__(self, tagger: Tagger, remembered: int = 200_000):
        self.tagger = tagger
        self.of_word = Remembered(tagger.evidence, remembered).__getitem__

    def _evidence(self, text: str) -> np.ndarray:
        parts = [WORD.findall(text)] if len(text) <= PIECE else (WORD.findall(text[a:b]) for a, b in pieces(text, PIECE))
        return np.concatenate([np.fromiter(map(self.of_word, found), np.float64, len(found)) for found in parts])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        parts = [self._evidence(t or "") for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        begins = np.zeros(bounds[-1], bool)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        chance, _ = chain.marginals(np.concatenate(parts) if parts else np.empty(0), begins, self.tagger.ties)
        scores = 1 / (1 + np.exp(-np.clip(sums(chance, bounds) @ self.tagger.scale, -30, 30)))
        spans = [[] for _ in texts]
        likely = np.flatnonzero(chance >= 0.5)
        owner = np.searchsorted(bounds, likely, side="right") - 1
        places = defaultdict(list)
        for k, w in zip(owner.tolist(), (likely - bounds[owner]).tolist()):
            places[k].append(w)
        for k, found in places.items():
            spans[k] = _spans(texts[k], found)
        return scores, spans


def _spans(text: str, found: list[int]) -> list[tuple[int, int]]:
    """Start and end of the words numbered `found` (rising); neighbours are one span."""
    out, wanted, last = [], iter(found), -2
    want = next(wanted)
    for number, word in enumerate(WORD.finditer(text)):
        if number == want:
            if number == last + 1:
                out[-1] = (out[-1][0], word.end())
            else:
                out.append(word.span())
            last, want = number, next(wanted, None)
            if want is None:
                break
    return out


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def predict(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """`doc_id, score, spans` of each row, from its whole text alone."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(tagger)

        def rows():
            for part in parts:
                held, size = [], 0
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    held.append((doc_id, text.as_py()))
                    size += len(held[-1][1] or "")
                    if size >= PIECE:
                        yield from scored(held)
                        held, size = [], 0
                yield from scored(held)

        def scored(held):
            scores, spans = scorer([t for _, t in held])
            for (doc_id, _), score, found in zip(held, scores.tolist(), spans):
                yield doc_id, score, [{"start": a, "end": b} for a, b in found]

        yield from batches(rows(), _OUT)

    schema = "doc_id long, score double, spans array<struct<start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)
