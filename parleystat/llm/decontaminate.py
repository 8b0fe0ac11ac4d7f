"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows scans each text once."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleystat.llm.common import slices

WINDOW = 10
#: Characters of benchmark text that one automaton is built from; more text is scanned in further blocks.
BLOCK_CHARS = 16 << 20
#: ASCII letters and digits stay (in lower case), other ASCII characters part words; all other bytes are letters.
_FOLD = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)
)

_WORD = re.compile(rb"[^ ]+")

STATE = "array<struct<first:long,last:long>>"
SPANS = "array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as UTF-8. The class is closed on bytes, because every
    byte of a character beyond ASCII is 0x80 or more."""
    return (text or "").encode("utf-8").translate(_FOLD).split()


def passages(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where word spans (in order, both ends included) are in the original text: start and end in code points, the
    end not included."""
    if not hits:
        return []
    raw = text.encode("utf-8")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]  # folding keeps every byte's place
    out, place, points = [], 0, 0
    for first, last in hits:
        start, end = at[first][0], at[last][1]
        begin = points + len(raw[place:start].decode("utf-8"))
        points, place = begin + len(raw[start:end].decode("utf-8")), end
        out.append((begin, points))
    return out


def windows_of(words: list[bytes], window: int = WINDOW) -> set[tuple[bytes, ...]]:
    """Runs of `window` words; a shorter item is one run, an item without words has none."""
    if not words:
        return set()
    if len(words) < window:
        return {tuple(words)}
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}


class Scanner:
    """An automaton over the windows of some items. Texts are joined by single spaces with one at either end, so a
    match starts and ends at word borders."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        import ahocorasick

        owners: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            for run in windows_of(words_of(text), window):
                owners.setdefault(_joined(run), (len(run), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for run, (n, names) in owners.items():
            self.automaton.add_word(run, (n, tuple(names)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans (first, last) of all matches, and the items they belong to."""
        if self.empty or not words:
            return [], set()
        text = _joined(words)
        hits = list(self.automaton.iter(text))
        if not hits:
            return [], set()
        ends = list(accumulate(len(w) + 1 for w in words))  # where the space after each word is
        spans, items = [], set()
        for end, (n, names) in hits:
            last = bisect_right(ends, end) - 1
            spans.append((last - n + 1, last))
            items.update(names)
        return merged(spans), items


def _joined(words) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about `block_chars` characters. An item without an id takes the empty name."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // block_chars + 1
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [tuple(r) for r in mine.distinct().collect()]


def with_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Per row of `docs`: `doc_id, n_words, hits` (merged word spans, both ends included), `items` (sorted names) and
    `spans` (where each of `hits` is in the text: code points, the end not included).

    The benchmark meets the texts in blocks of bounded size; each block is one more narrow pass over the rows in
    the same tasks, without a shuffle. A null text has no words. Rows that repeat stay.
    """
    empty = {"n_words": F.lit(0).cast("long"), "hits": F.array().cast(STATE), "items": F.array().cast("array<string>"), "spans": F.array().cast(SPANS)}
    out = docs.select("doc_id", "text").withColumns(empty)
    for block in _blocks(benchmark, block_chars):
        out = _pass(out, block, window)
    return out.drop("text")


def _pass(rows: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    scanner = _shared_scanner(rows, items, window)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = scanner()
        for part in parts:
            doc_ids, texts, _, old_hits, old_items, _ = part.columns
            counts, hits, names, places = [], [], [], []
            for text, old, older in zip(texts, old_hits.to_pylist(), old_items.to_pylist()):
                words = words_of(text.as_py())
                spans, found = finder.scan(words)
                counts.append(len(words))
                spans = merged(spans + [(x["first"], x["last"]) for x in old])
                hits.append([{"first": a, "last": b} for a, b in spans])
                places.append([{"start": a, "end": b} for a, b in passages(text.as_py(), spans)])
                names.append(sorted(found.union(older)))
            new = [pa.array(v, part.schema.field(i).type) for i, v in ((2, counts), (3, hits), (4, names), (5, places))]
            yield pa.RecordBatch.from_arrays([doc_ids, texts, *new], schema=part.schema)

    # Arrays that come back from Python may hold nulls as far as Spark knows.
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    return rows.mapInArrow(scan, schema)


def _shared_scanner(rows: DataFrame, items: list[tuple[str, str | None]], window: int) -> Callable[[], Scanner]:
    """What builds the block's automaton once per task; the items reach each executor once."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    return lambda: Scanner(shared.value, window)


def n_hit() -> Column:
    zero = F.lit(0).cast("long")
    return F.aggregate("hits", zero, lambda n, x: n + x["last"] - x["first"] + 1)


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents in which no window of any item occurs, with all their own columns."""
    out = docs
    for block in _blocks(benchmark, block_chars):
        scanner = _shared_scanner(docs, block, window)

        def clean(parts: Iterator[pa.RecordBatch], scanner=scanner) -> Iterator[pa.RecordBatch]:
            finder = scanner()
            for part in slices(parts):
                texts = part.column(part.schema.get_field_index("text"))
                yield part.filter(pa.array([not finder.scan(words_of(t.as_py()))[0] for t in texts], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
