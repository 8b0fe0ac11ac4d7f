"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is a set of features of its own and of the lines before and after; a
transition weight ties neighbours together. Forward-backward gives the chance that each line is good, and a
document's score is their mean weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat.llm import byte_text
from parleystat.llm.common import batches

#: The sample the weights are fitted on: about so many labelled documents of each label, and a run of so many lines
#: (and characters) of each. Scoring has no such bounds.
SAMPLE_DOCS = 1500
SAMPLE_LINES = 48
SAMPLE_CHARS = 20_000
ROUNDS = 250
RATE = 0.08
PENALTY = 2e-4

_CLASSES = 7  # upper, lower or beyond ASCII, digit, symbol, exclamation or question mark, sentence punctuation, bar


def _class_table() -> np.ndarray:
    table = np.full(256, 255, np.uint8)
    table[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
    table[ord("A") : ord("Z") + 1] = 0
    table[ord("0") : ord("9") + 1] = 2
    for kind, letters in ((3, "#*$%&<>=+~^_@\\/{}[]"), (4, "!?"), (5, ".,;:"), (6, "|")):
        table[[ord(c) for c in letters]] = kind
    return table


_CLASS = _class_table()
_OWN = 18
FEATURES = 3 * _OWN + 2


@dataclass
class Lines:
    """The lines of some texts: their features, their weights, and where each text's lines start."""

    features: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray


def _per(values: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return values / np.maximum(whole, 1)


def lines_of(texts: list[str | None]) -> Lines:
    """Split at line feeds; a null or empty text is one empty line."""
    data, text_bounds = byte_text.joined(texts, lower=False)
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], feeds[:-1] + 1]) if len(feeds) else np.empty(0, np.int64)
    n = len(feeds)
    bounds = np.searchsorted(starts, text_bounds)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    size = (feeds - starts).astype(np.float64)
    kinds = _CLASS[data]
    count = np.empty((_CLASSES, n))
    for k in range(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(kinds == k)])
        count[k] = sums[feeds] - sums[starts]
    w_start, w_end = byte_text.words(data)
    w_hash = byte_text.span_hashes(data, w_start, w_end)
    w_line = np.searchsorted(feeds, w_start)
    n_words = np.bincount(w_line, minlength=n).astype(np.float64)
    again = np.zeros(n)
    for gap in (1, 2):  # words equal to the one or two places before, in the same line
        same = (w_hash[gap:] == w_hash[:-gap]) & (w_line[gap:] == w_line[:-gap])
        again += np.bincount(w_line[gap:][same], minlength=n)
    short = np.bincount(w_line[(w_end - w_start) <= 2], minlength=n)
    line_hash = byte_text.span_hashes(data, starts, feeds)
    keys = np.stack([owner.astype(np.uint64), line_hash], axis=1) if n else np.empty((0, 2), np.uint64)
    _, first, inverse = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    copies = np.bincount(inverse.reshape(-1), minlength=len(first))[inverse.reshape(-1)] if n else np.empty(0)
    last = data[np.maximum(feeds - 1, starts)] if n else data[:0]
    letters = count[0] + count[1]
    own = np.stack(
        [
            np.log1p(size) / 6,
            np.log1p(n_words) / 4,
            _per(letters, size),
            _per(count[0], letters),
            _per(count[2], size),
            np.minimum(_per(count[3], n_words), 3),
            np.minimum(_per(count[4], n_words), 3),
            np.minimum(_per(count[5], n_words), 2),
            np.minimum(_per(count[6], n_words), 2),
            np.minimum(_per(size, n_words) / 10, 3),
            _per(again, n_words),
            _per(short, n_words),
            (copies > 1).astype(float),
            np.isin(last, [ord(c) for c in ".!?:;\""]).astype(float),
            (n_words <= 3).astype(float),
            (_per(count[0], letters) > 0.6).astype(float),
            (_per(count[3] + count[6], n_words) > 0.25).astype(float),
            (_per(again, n_words) > 0.2).astype(float),
        ],
        axis=1,
    ).astype(np.float32) if n else np.empty((0, _OWN), np.float32)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :_OWN] = own
    if n:
        begins = np.zeros(n, bool)
        begins[bounds[:-1]] = True
        closes = np.zeros(n, bool)
        closes[bounds[1:] - 1] = True
        out[1:, _OWN : 2 * _OWN] = own[:-1] * ~begins[1:, None]
        out[:-1, 2 * _OWN : 3 * _OWN] = own[1:] * ~closes[:-1, None]
        out[:, -2] = begins
        out[:, -1] = 1
    return Lines(out, size + 1, bounds)


@dataclass(frozen=True)
class LineModel:
    """`weights` of the features for good against bad, and `ties[a, b]` between a line's label and the next one's."""

    weights: np.ndarray
    ties: np.ndarray


def _padded(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling number of lines, and how many texts have a line at each place."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    most = int(length.max()) if len(length) else 0
    active = len(length) - np.searchsorted(np.sort(length), np.arange(most), side="right")
    return order, active


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(evidence: np.ndarray, bounds: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per line the chance of good; the expected counts of label pairs; the log of all partition sums.

    All texts advance one line at a time together, so the number of numpy calls follows the longest text.
    """
    order, active = _padded(bounds)
    first = bounds[:-1][order]
    n = len(evidence)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    score = np.stack([np.zeros(n), evidence], axis=1)
    for t, k in enumerate(active):
        at = first[:k] + t
        if t:
            p = ahead[at - 1]
            ahead[at, 0] = _soft(p[:, 0] + ties[0, 0], p[:, 1] + ties[1, 0])
            ahead[at, 1] = _soft(p[:, 0] + ties[0, 1], p[:, 1] + ties[1, 1])
        ahead[at] += score[at]
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        q = behind[at + 1] + score[at + 1]
        behind[at, 0] = _soft(ties[0, 0] + q[:, 0], ties[0, 1] + q[:, 1])
        behind[at, 1] = _soft(ties[1, 0] + q[:, 0], ties[1, 1] + q[:, 1])
    both = ahead + behind
    total = _soft(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    pairs = np.zeros((2, 2))
    if n > 1:
        inner = np.ones(n, bool)
        inner[bounds[1:] - 1] = False
        at = np.flatnonzero(inner)
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] = np.exp(ahead[at, a] + ties[a, b] + score[at + 1, b] + behind[at + 1, b] - total[at]).sum()
    return good, pairs, float(total[bounds[:-1]].sum()) if len(bounds) > 1 else 0.0


def train(lines: Lines, labels: np.ndarray, rounds: int = ROUNDS) -> LineModel:
    """Maximise the conditional likelihood by Adam steps; every line of a labelled text carries its text's label.

    With no texts, or with one label only, the weights stay near zero and so scores near a half.
    """
    y = np.repeat(labels, np.diff(lines.bounds)).astype(np.float64)
    x = lines.features.astype(np.float64)
    pair_seen = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[lines.bounds[1:] - 1] = False
    at = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            pair_seen[a, b] = ((y[at] == a) & (y[at + 1] == b)).sum()
    params = np.zeros(FEATURES + 4)
    mean, spread = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1 if len(labels) else 1):
        weights, ties = params[:FEATURES], params[FEATURES:].reshape(2, 2)
        good, pairs, _ = forward_backward(x @ weights, lines.bounds, ties)
        slope = np.concatenate([x.T @ (y - good), (pair_seen - pairs).ravel()]) / len(y) - PENALTY * params
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.999 * spread + 0.001 * slope**2
        params = params + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return LineModel(params[:FEATURES].copy(), params[FEATURES:].reshape(2, 2).copy())


def scores(texts: list[str | None], model: LineModel) -> np.ndarray:
    """Length-weighted mean chance of a good line, per text."""
    out = np.empty(len(texts))
    for a, b in byte_text.portions(texts):
        lines = lines_of(texts[a:b])
        good, _, _ = forward_backward(lines.features @ model.weights, lines.bounds, model.ties)
        whole = np.add.reduceat(lines.weights, lines.bounds[:-1])
        out[a:b] = np.add.reduceat(lines.weights * good, lines.bounds[:-1]) / whole
    return np.clip(out, 0.0, 1.0)


def fit(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, rounds: int = ROUNDS
) -> LineModel:
    """Learn from the texts of `docs` (doc_id, text) that `labels` (doc_id, quality 0 or 1) cover.

    Labels are counted whole; a share that leaves about `sample_docs` documents of each label is drawn by a hash
    of doc_id, and of a longer document `sample_lines` lines in a row at a place set by the hash (of those, `SAMPLE_CHARS` characters). Only that
    sample reaches the driver. Rows without an id or label are passed over; of several labels the higher counts, of rows that share an id the least sample.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {int(r["quality"]): r["count"] for r in marked.groupBy("quality").count().collect()}
    if not counts:
        return train(lines_of([]), np.empty(0), 0)
    most = 1 << 31
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(most))
    bound = F.lit(0).cast("long")
    for label, n in counts.items():
        bound = F.when(F.col("quality") == label, F.lit(min(most, most * sample_docs // n))).otherwise(bound)
    drawn = marked.where(draw < bound).select("doc_id", "quality")
    lines = F.split("text", "\n", -1)
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size(lines) - sample_lines, F.lit(0)) + 1).cast("int") + 1
    piece = F.substring(F.array_join(F.slice(lines, place, F.lit(sample_lines)), "\n"), 1, SAMPLE_CHARS)
    sample = (
        docs.where(F.col("text").isNotNull())
        .join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min(piece).alias("text"))
    )
    rows = sorted((r["doc_id"], r["quality"], r["text"]) for r in sample.collect())
    parts = [r[2] for r in rows]
    return train(lines_of(parts), np.array([r[1] for r in rows], np.float64), rounds)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def predict(docs: DataFrame, model: LineModel) -> DataFrame:
    """`doc_id, score` of each row, from its whole text alone."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = scores(part.column(1).to_pylist(), model)
            yield from batches(iter(zip(part.column(0).to_pylist(), found.tolist())), _OUT, most=len(found) + 1)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, score double")
