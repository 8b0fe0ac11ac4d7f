"""Alignment of two tokenisations of the same texts: a byte-level BPE (A) and a SentencePiece model (B).

Both tokenise a whole text, and their tokens' bytes are added up. Where both have a token that ends at one place, and
each goes on with a token that starts with a space, the text is cut: these anchors part it into windows of token ids.
A window's alignment follows from its ids alone, so it is remembered by them. How often an id pair is linked is summed
over all texts; pairs met in many texts are looked up in a table whose size has a bound, the others are joined.

A null or empty text, and one whose tokens do not spell a space and the text (a tokenizer normalises it), has no tokens.
Rows with equal ids or texts count each for themselves. Work arrays hold some 64 KB of texts, or one longer text.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat.llm.common import batches, stored
from parleystat.llm.token_files import byte_letters

#: A pair that more than one in so many of all pairs in texts is looked up; so fewer than this many pairs can be.
FREQUENT = 100_000
#: Pairs of (A id, B id) as one number.
_SHIFT = 32
_SPACE = "▁"
#: Between A's and B's ids, which are never negative, in the key of a window.
_BETWEEN = pack("<i", -1)


def align(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two runs of ids over the same bytes, and each id's length: the ends of either's tokens, the places of the A and
    B token that end there or reach beyond, and whether both end there. Each row is one pair of overlapping tokens."""
    a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    ends = np.unique(np.concatenate([a_ends, b_ends]))
    at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, at_a, at_b, (a_ends[at_a] == ends) & (b_ends[at_b] == ends)


class Aligner:
    """Both tokenizers and what they say of texts. One per Python worker.

    It remembers at most twice `remembered` windows: when there are as many, only those used since the last time stay.
    """

    def __init__(self, byte_bpe: str, pattern: str, pieces: str, remembered: int = 300_000):
        import sentencepiece
        import tiktoken

        with open(byte_bpe, encoding="utf-8") as f:
            described = json.load(f)
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        special = {t["content"] for t in described["added_tokens"]}
        # Ids rise with the order of merges, so they serve as ranks; strings of special tokens are plain text.
        ranks = {bytes(letters[c] for c in t): n for t, n in described["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        n, most = self.b.vocab_size(), max(ranks.values(), default=-1) + 1
        spelled = [self.b.id_to_piece(k) for k in range(n)]
        self.b_bytes = [
            bytes([int(s[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) else s.replace(_SPACE, " ").encode("utf-8")
            for k, s in enumerate(spelled)
        ]
        self.a_size, self.a_spaced = np.zeros(most, np.int64), np.zeros(most, bool)
        for spelling, k in ranks.items():
            self.a_size[k], self.a_spaced[k] = len(spelling), spelling[:1] == b" "
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.b_spaced = np.array([s[:1] == _SPACE for s in spelled], bool)
        # An id in a group's text, with what follows it: another id, B's ids, or the next group.
        self.width = max(most, n)
        self.named = [f"{k}{after}" for after in ",|;" for k in range(self.width)]
        self.recent: dict[bytes, tuple[str, bytes, int]] = {}
        self.older: dict[bytes, tuple[str, bytes, int]] = {}
        self.remembered = remembered

    def _windows(self, text: str | None, b_ids: list[int]) -> tuple[int, int, list[bytes]]:
        """Numbers of tokens, and the windows' ids: A's, a -1 and B's."""
        if not text:
            return 0, 0, []
        whole = (" " + text).encode("utf-8")
        a, b = np.array(self.a.encode_ordinary(" " + text), np.int32), np.array(b_ids, np.int32)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # Byte-level tokens are cut from the bytes themselves, so theirs differ from the text's only by their number.
        if a_ends[-1] != len(whole) or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole or not self.b_size[b].all():
            return 0, 0, []
        # Ends before a space-marked token of A, kept where B has such an end at the same place.
        a_cut, b_cut = np.flatnonzero(self.a_spaced[a[1:]]), np.flatnonzero(self.b_spaced[b[1:]])
        a_ends, b_ends = a_ends[a_cut], np.append(b_ends[b_cut], -1)
        at_b = np.searchsorted(b_ends[:-1], a_ends)
        both = np.flatnonzero(b_ends[at_b] == a_ends)
        a_to, b_to = [*(a_cut[both] * 4 + 4).tolist(), 4 * len(a)], [*(b_cut[at_b[both]] * 4 + 4).tolist(), 4 * len(b)]
        a_raw, b_raw = a.tobytes(), b.tobytes()
        spans = zip([0, *a_to], a_to, [0, *b_to], b_to)
        return len(a), len(b), [a_raw[i:x] + _BETWEEN + b_raw[j:y] for i, x, j, y in spans]

    def _aligned(self, windows: list[bytes]) -> list[tuple[str, bytes, int]]:
        """Of each window: its groups as text, its linked id pairs as 64-bit integers, and its number of groups. All
        are aligned in one go, as one run of tokens after the other covers the same bytes in A and in B."""
        ids = np.frombuffer(b"".join([w + _BETWEEN for w in windows]), np.int32)
        parted = np.flatnonzero(ids < 0)
        side = np.cumsum(ids < 0) % 2
        a, b = ids[(side == 0) & (ids >= 0)], ids[(side == 1) & (ids >= 0)]
        starts = np.concatenate([[0], parted[1::2][:-1] + 1])
        n_a, n_b = parted[::2] - starts, parted[1::2] - parted[::2] - 1
        ends, at_a, at_b, shared = align(a, b, self.a_size, self.b_size)
        pairs = (a[at_a].astype(np.int64) << _SHIFT | b[at_b]).tobytes()
        # Which group a token is in, and its place when each group's A ids are written before its B ids.
        last_a, last_b = at_a[shared], at_b[shared]
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        written = np.empty(len(a) + len(b), np.int64)
        before_b = np.concatenate([[0], last_b + 1])
        written[np.arange(len(a)) + before_b[group_a]] = a + self.width * closes_a
        written[np.arange(len(b)) + last_a[group_b] + 1] = b + 2 * self.width * closes_b
        text = list(map(self.named.__getitem__, written.tolist()))
        to_text = np.cumsum(n_a + n_b)
        to_pair = np.searchsorted(at_a, np.cumsum(n_a) - 1, side="right")
        to_group = group_a[np.cumsum(n_a) - 1] + 1
        spans = zip([0, *to_text.tolist()], to_text.tolist(), [0, *(8 * to_pair).tolist()], (8 * to_pair).tolist(), np.diff(to_group, prepend=0).tolist())
        return [("".join(text[i:x]), pairs[j:y], n) for i, x, j, y, n in spans]

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Per text: the number of A tokens, of B tokens and of groups; the groups' digest; a linked pair per link."""
        cut = list(map(self._windows, texts, self.b.encode([t or "" for t in texts], num_threads=1)))
        recent, older = self.recent, self.older
        known = [list(map(recent.get, windows)) for *_, windows in cut]
        new = {}
        for (*_, windows), found in zip(cut, known):
            for k, said in enumerate(found):
                if said is None:
                    w = windows[k]
                    found[k] = said = older.get(w)
                    if said is None:
                        new[w] = None
                    else:
                        recent[w] = said
        if new:
            recent.update(zip(new, self._aligned(list(new))))
        out = []
        for (n_a, n_b, windows), found in zip(cut, known):
            if not windows:
                out.append((0, 0, 0, "", np.empty(0, np.int64)))
                continue
            said = [f or recent[w] for f, w in zip(found, windows)]
            groups, pairs, counts = zip(*said)
            digest = hashlib.sha256("".join(groups)[:-1].encode()).hexdigest()
            out.append((n_a, n_b, sum(counts), digest, np.frombuffer(b"".join(pairs), np.int64)))
        if len(recent) >= self.remembered:
            self.older, self.recent = recent, {}
        return out


@lru_cache(maxsize=2)
def aligner(byte_bpe: str, pattern: str, pieces: str) -> Aligner:
    return Aligner(byte_bpe, pattern, pieces)


_ALIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
)
_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def together(parts: Iterator[pa.RecordBatch], chars: int = 1 << 16) -> Iterator[tuple[list, list]]:
    """Ids and texts of a few rows at a time, of about so many characters, or of one longer text."""
    for part in parts:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def aligned(docs: DataFrame, byte_bpe: str, pattern: str, pieces: str) -> DataFrame:
    """A row per document: its counts, its groups' digest, and its distinct linked pairs with how often each is linked.

    `row` numbers the rows, for ids may repeat.
    """

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_texts = aligner(byte_bpe, pattern, pieces)
        first = TaskContext.get().partitionId() << 40

        def rows():
            number = first
            for doc_ids, texts in together(parts):
                for doc_id, (n_a, n_b, n_groups, digest, links) in zip(doc_ids, align_texts(texts)):
                    links = np.sort(links)
                    opens = np.flatnonzero(np.diff(links, prepend=-1))
                    pairs, times = links[opens], np.diff(opens, append=len(links))
                    yield number, doc_id, n_a, n_b, n_groups, len(links), digest, pairs.tobytes(), times.astype(np.int32).tobytes()
                    number += 1

        gc.disable()  # what is remembered holds no cycles, and looking for some takes a third of the time
        try:
            yield from batches(rows(), _ALIGNED, weigh=lambda r: len(r[7]))
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, f"{_ROW}, pairs binary, times binary")


def _entries(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all cells of a binary column one after the other, and how many each cell has."""
    size = np.dtype(kind).itemsize
    data, bounds = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, kind, (bounds[-1] - bounds[0]) // size, bounds[0]) if data and bounds[-1] > bounds[0] else np.empty(0, kind)
    return values, np.diff(bounds) // size


def pair_counts(found: DataFrame) -> DataFrame:
    """`pair, links, docs` over all documents: how many links hold a pair and how many documents."""
    schema = pa.schema([("pair", pa.int64()), ("links", pa.int64()), ("docs", pa.int64())])

    def summed(held: list) -> tuple[np.ndarray, ...]:
        pairs, links, docs = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        return pairs[first], np.add.reduceat(links[order], first), np.add.reduceat(docs[order], first)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole = [], 0, 0
        for part in parts:
            pairs, times = _entries(part.column(0), np.int64)[0], _entries(part.column(1), np.int32)[0]
            if not len(pairs):
                continue
            held.append((pairs, times.astype(np.int64), np.ones(len(pairs), np.int64)))
            size += len(pairs)
            if size - whole >= 500_000:
                held = [summed(held)]
                whole = size = len(held[0][0])
                if whole >= 1_000_000:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), schema=schema)
                    held, size, whole = [], 0, 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed(held))), schema=schema)

    return (
        found.select("pairs", "times")
        .mapInArrow(scan, "pair long, links long, docs long")
        .groupBy("pair")
        .agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    )


def link_strengths(found: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The rows of `aligned` with `n_best`, links whose pair is its B id's most linked one (ties included), and
    `count_sum`, the corpus-wide counts of all its links added up.

    A pair that holds more than 1/`frequent` of all (document, pair) entries is among the frequent ones. There are fewer
    than `frequent` of them however many documents there are, so each task gets them whole; entries of all other
    pairs, none of which is hot by this very bound, are joined and summed by row.
    """
    found = stored(found, "aligned")
    counts = stored(pair_counts(found), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    tops = counts.groupBy(b.alias("b")).agg(F.max("links").alias("top"))  # at most one row per id of B's vocabulary
    counts = stored(counts.withColumn("b", b).join(F.broadcast(tops), "b").select("pair", "links", "docs", (F.col("links") == F.col("top")).alias("best")), "strengths")
    entries = counts.agg(F.sum("docs")).first()[0] or 0
    is_frequent = F.col("docs") * frequent > entries
    known = sorted(tuple(r) for r in counts.where(is_frequent).select("pair", "links", "best").collect())
    pair, links, best = (np.array(x, np.int64) for x in zip(*known)) if known else (np.empty(0, np.int64),) * 3
    schema = pa.schema([*list(_ALIGNED)[:7], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("rest", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))])
    held = found.sparkSession.sparkContext.broadcast((pair, links, best))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = held.value
        for part in parts:
            pairs, n = _entries(part.column(7), np.int64)
            times = _entries(part.column(8), np.int32)[0].astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(pair, pairs), len(pair) - 1)
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            sums = []
            for weight in (best, links):
                running = np.concatenate([[0], np.cumsum(np.where(hit, times * weight[at], 0) if len(pair) else times * 0)])
                ends = np.cumsum(n)
                sums.append(pa.array(running[ends] - running[ends - n]))
            rest = pa.StructArray.from_arrays([pa.array(pairs[~hit]), pa.array(times[~hit])], fields=list(schema[-1].type.value_type))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(n)))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(bounds), rest)
            yield pa.RecordBatch.from_arrays([*part.columns[:7], *sums, rest.cast(schema[-1].type)], schema=schema)

    split = stored(found.mapInArrow(scan, f"{_ROW}, n_best long, count_sum long, rest array<struct<pair: long, times: long>>"), "split")
    rare = split.select("row", F.explode("rest").alias("e")).select("row", "e.pair", "e.times")
    more = (
        rare.join(counts.where(~is_frequent).select("pair", "links", "best"), "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("links")).alias("more_sum"))
    )
    return split.drop("rest").join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
