"""Secrets in texts: an Aho-Corasick prefilter, regular expressions anchored at its hits, checksums."""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat.llm.common import batches, slices

BASE = ("assign", "access", "hex")
#: All kinds, in the order that breaks ties.
KINDS = (*BASE, "github", "npm", "jwt", "pem", "google", "stripe", "slack")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(data: str, width: int = 6) -> str:
    """The checksum that ends some access tokens: crc32 in base 62, padded with zeros."""
    value, out = zlib.crc32(data.encode("latin-1")), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(width, "0")


def _checked_tail(m: re.Match) -> bool:
    return crc_base62(m[1][:-6]) == m[1][-6:]


def _json_head(m: re.Match) -> bool:
    """Whether a token's first part is base64 of a JSON object that names its algorithm."""
    head = m[1]
    try:
        value = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(value, dict) and "alg" in value


#: kind: lower-case keywords, the pattern anchored at a hit, what a match must also meet. Patterns run on UTF-8
#: bytes seen as Latin-1 letters, so only their ASCII parts can match.
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.compile(
            r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
            r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        ),
        lambda m: len(m[2]) >= 12,
    ),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checked_tail),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checked_tail),
    "jwt": (("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), _json_head),
    "pem": (
        ("-----begin ",),
        re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s:,-]*?-----END \1-----"),
        lambda m: True,
    ),
    "google": (("aiza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), lambda m: True),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{24,}"), lambda m: True),
    "slack": (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), lambda m: True),
}
#: Hex runs have no keyword. A run is maximal, so leaving out short ones while searching leaves out no long one.
HEX = re.compile(r"[0-9a-f]{16,}")


_RUN = re.compile(r"[A-Za-z0-9_-]+")
_HEAD = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*")
_FOOT = re.compile(r"-----END ([A-Z ]*PRIVATE KEY)-----")


class _Keys:
    """Where keys in their armour end, in time linear in the text: feet are listed once, and the run of letters that a
    body may have is walked once for all heads in it."""

    def __init__(self, seen: str):
        self.seen, self.run = seen, (0, -1)
        self.feet: dict[str, list[tuple[int, int]]] = {}
        for m in _FOOT.finditer(seen):
            self.feet.setdefault(m[1], []).append(m.span())

    def end(self, start: int) -> int | None:
        """The end of the key whose head is at `start`: behind the next foot of its name, if only a body is between."""
        head = _HEAD.match(self.seen, start)
        feet = self.feet.get(head[1]) if head else None
        if not feet:
            return None
        begin = head.end()
        if not self.run[0] <= begin <= self.run[1]:
            self.run = begin, _BODY.match(self.seen, begin).end()
        k = bisect_left(feet, (begin, 0))
        return feet[k][1] if k < len(feet) and feet[k][0] <= self.run[1] else None


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, (keywords, _, _) in RULES.items():
        for word in keywords:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end in code points) of a text, by start and then kind.

    Per kind, matches are leftmost and do not overlap; a match that fails its check still uses up its text. The time
    is linear in the text also where many hits fail.
    Spans of different kinds may overlap.
    """
    raw = text.encode("utf-8")
    seen = raw.decode("latin-1")
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(seen)]
    used, keys = dict.fromkeys(RULES, 0), None
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _automaton().iter(raw.lower().decode("latin-1")))
    for start, kind in hits:
        if start < used[kind]:
            continue
        if kind == "pem":
            keys = keys or _Keys(seen)
            if (end := keys.end(start)) is not None:
                used[kind] = end
                found.append((kind, start, end))
            continue
        m = RULES[kind][1].match(seen, start)
        if m is None:
            if kind == "jwt" and (run := _RUN.match(seen, start)):  # what fails for one hit of a run fails for all
                used[kind] = run.end()
            continue
        used[kind] = m.end()
        if RULES[kind][2](m):
            found.append((kind, start, m.end()))
    if not found:
        return []
    if len(raw) != len(text):  # byte places to code points
        places, at, points = {}, 0, 0
        for place in sorted({p for _, s, e in found for p in (s, e)}):
            points += len(raw[at:place].decode("utf-8"))
            places[place], at = points, place
        found = [(k, places[s], places[e]) for k, s, e in found]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_spans(docs: DataFrame) -> DataFrame:
    """`doc_id` and the `spans` of each row's whole text. A null or empty text has none; rows that repeat stay."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    spans = [{"kind": k, "start": s, "end": e} for k, s, e in find(text.as_py() or "")]
                    yield doc_id, spans

        yield from batches(rows(), pa.schema([("doc_id", pa.int64()), ("spans", _SPAN)]))

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(scan, f"doc_id long, spans {SPANS}")


def redact(text: str | None) -> str | None:
    """The text with every secret replaced by its kind in brackets; spans that overlap go as one."""
    spans = find(text) if text else []
    if not spans:
        return text
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with their secrets redacted and `n_chars` brought up to date where it is a column."""
    schema = docs.schema

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            at = part.schema.get_field_index("text")
            texts = [redact(t.as_py()) for t in part.column(at)]
            columns = list(part.columns)
            columns[at] = pa.array(texts, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    clean = docs.mapInArrow(scan, schema)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(schema["n_chars"].dataType), F.col("n_chars")))
